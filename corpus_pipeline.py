"""Documents to token ids in five stages, each an operator of recordloom.llm on all rows that the stage before kept.

Quality: rows that the ranking scores below CUT go. Near duplicates: of documents that links of five-word shingles (similarity of 0.8 or more) join, the one of least doc_id stays (null ids last).
Repeats: every byte that a string of 200 bytes covers which also starts elsewhere goes (characters go whole); the rest stays, and n_chars follows it. Decontamination: documents with a
window of ten words of a benchmark item go. Encoding: ids by byte-level BPE, decoded again to check them.

Each stage: ids may be null or repeat: rows go by themselves, told apart by a hash of id and text; of rows that repeat both, one stays if it has words (their other columns are any one's). Null texts count as empty: they are scored, have no shingles, windows or ids. Very long texts are read whole, in one task each.
Ties of the quality cut stay. An empty table gives an empty table. Extra columns pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import bpe, jaccard, positional, ranking, suffixdedup
from recordloom.llm.shared import fresh, row_key, text_batches, text_or_empty, written

#: Least quality score; bytes of a repeated string; words of a benchmark window.
CUT, REPEATED_BYTES, WINDOW_WORDS = 0.3, 200, 10


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = ranking.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), CUT)
    name = fresh(docs, "_quality")
    return ranking.score(docs, model, tuple(docs.columns), name).where(F.col(name) >= CUT).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.without_linked(docs, words=5, percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = tuple(c for c in docs.columns if c not in ("text", "n_chars"))

    def kept(data, removed):
        texts = [suffixdedup.kept_text(d, r) for d, r in zip(data, removed)]
        return [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]

    return suffixdedup.without_repeats(docs, REPEATED_BYTES, others, kept, "text string, n_chars long", ("text", "n_chars")).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key, out = fresh(docs, "_key"), fresh(docs, "_gone")
    found = positional.contamination(docs.select(row_key().alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), WINDOW_WORDS)
    gone = written(found.where("contaminated").select(F.col("doc_id").alias(out)).distinct(), "contaminated")
    return docs.withColumn(key, row_key()).join(gone, F.col(key) == F.col(out), "left_anti").drop(key)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    own = docs.select("doc_id", "lang", "source", text_or_empty().alias("text"))
    coded = bpe.encode_documents(own, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, keep=("lang", "source", "text"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.col("text")).alias("round_trip"))


def _in_batches(stage):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        text_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [(f.__name__, _in_batches(f)) for f in (quality, near_duplicates, repeats, decontaminate, encode)]

#: Not expressible: the first stage fits a model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
