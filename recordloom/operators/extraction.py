"""Parsing of extraction answers, merging of proposals, conforming to records."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prices in USD for a token, the confidence cap of a conflict, and the confidence of an answer without one.
PRICE_IN, PRICE_OUT, CONFLICT_CAP, DEFAULT_CONFIDENCE, LOW_CONFIDENCE = 3e-6, 15e-6, 0.5, 0.5, 0.7
# Fixed value: a line that is a key and its value.
KEY_VALUE = r"^([^:]+):\s*(.+)$"


def cost(tokens_in: Column, tokens_out: Column) -> Column:
    return tokens_in * PRICE_IN + tokens_out * PRICE_OUT


def estimated_tokens(n_chars: Column, extra: int) -> Column:
    return F.floor(n_chars / 4).cast("long") + extra


def prompt(schema: Column, content: Column) -> Column:
    return F.format_string("Fields:\n%s\n\nText:\n%s", schema, content)


def key_values(elements: DataFrame) -> DataFrame:
    """Proposals of elements that are a key and its value: document_id, ordinal, path, value, confidence."""
    kv = elements.where(F.col("kind") == "kv_pair")
    key = F.regexp_replace(F.lower(F.trim(F.regexp_extract("text", KEY_VALUE, 1))), r"\s+", "_")
    return kv.select("document_id", "ordinal", F.concat(F.lit("/"), key).alias("path"), F.trim(F.regexp_extract("text", KEY_VALUE, 2)).alias("value"), F.lit(DEFAULT_CONFIDENCE).alias("confidence"))


def parsed_answers(answers: DataFrame, answer: str = "answer", any_object: bool = False) -> DataFrame:
    """One row for each name of a JSON object: path, value (JSON), confidence, source_text. An object with a key ``value`` gives that and its confidence; anything else is the value.
    ``any_object``: every object counts as such, its value may be missing. Texts that aren't objects give no row; see ``failed_answers``."""
    keep = [c for c in answers.columns if c != answer]
    whole = F.try_parse_json(answer)
    src = answers.withColumn("_j", F.when(F.schema_of_variant(whole).startswith("OBJECT"), whole)).where("_j is not null")
    members = src.sparkSession.tvf.variant_explode(F.col("_j").outer()).select(F.col("key").alias("name"), F.col("value").alias("v"))
    src = src.lateralJoin(members)
    is_object = F.schema_of_variant("v").startswith("OBJECT")
    inner = F.variant_get("v", "$.value", "variant")
    has = is_object if any_object else is_object & F.schema_of_variant("v").rlike(r"[<,] ?value:")
    return src.select(
        *keep, F.concat(F.lit("/"), F.col("name")).alias("path"), F.to_json(F.when(has, inner).otherwise(F.col("v"))).alias("value"),
        F.coalesce(F.when(has, F.try_variant_get("v", "$.confidence", "double")), F.lit(DEFAULT_CONFIDENCE)).alias("confidence"), F.when(has, F.try_variant_get("v", "$.source_text", "string")).alias("source_text"),
    )


def failed_answers(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """Answers that aren't JSON objects, with a reason: for quarantine."""
    whole = F.try_parse_json(answer)
    return answers.where(whole.isNull() | ~F.schema_of_variant(whole).startswith("OBJECT")).withColumn("reason", F.when(whole.isNull(), "not_json").otherwise("not_an_object"))


def merged_proposals(proposals: DataFrame, keys: list[str], order: list[str], by: list[str] | None = None) -> DataFrame:
    """One row for each key: the value of highest confidence (ties: first in ``order``, then the least value). Different values (null is one) are a conflict: confidence is capped, and all values are kept.
    With ``by``, a part of the keys, rows are dealt once by it, and what later goes by it (records, gates, reviews) needs no further shuffle; its rows meet in one task, which sorts them and may spill. Without, equal keys are combined before the shuffle."""
    dealt = proposals.repartition(*by) if by else proposals
    # least of the struct: highest confidence first, nulls last
    best = F.min(F.struct(F.col("confidence").isNull(), -F.coalesce("confidence", F.lit(0.0)), *order, F.col("value").alias("_value"), F.col("confidence").alias("_confidence")))
    # a conflict shows in the least and greatest value, so that the sets are made only where they are read
    grouped = dealt.groupBy(*keys).agg(
        best.alias("_b"), F.count("*").alias("n_proposals"), F.array_sort(F.collect_set("value")).alias("candidates"), F.min("value").alias("_least"), F.max("value").alias("_most"), F.count("value").alias("_known")
    )
    conflict = F.col("_least").isNotNull() & ((F.col("_least") != F.col("_most")) | (F.col("_known") < F.col("n_proposals")))
    return grouped.select(*keys, F.col("_b._value").alias("value"), F.when(conflict, F.least("_b._confidence", F.lit(CONFLICT_CAP))).otherwise(F.col("_b._confidence")).alias("confidence"), "n_proposals", conflict.alias("is_conflict"), "candidates")


def record_json(path: str = "path", value: str = "value") -> Column:
    """Aggregate: a JSON object of path to value, in the order of paths; null values stay."""
    return F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(path).alias("k"), F.col(value).alias("v"))))), {"ignoreNullFields": "false"})


def conformed(fields: DataFrame, keys: list[str], threshold: float = LOW_CONFIDENCE) -> DataFrame:
    """One record for each document: its fields as JSON, mean confidence, number of fields and of those below the threshold."""
    return fields.groupBy(*keys).agg(record_json().alias("record_json"), F.avg("confidence").alias("quality_score"), F.count("*").alias("field_count"), F.count_if(F.col("confidence") < threshold).alias("low_confidence_count"))


def record_statistics(fields: DataFrame, keys: list[str], stamp: str, threshold: float = LOW_CONFIDENCE) -> DataFrame:
    """The warehouse's record table: counts, mean confidence, first and last extraction, cost. Records without any confidence are left out."""
    return fields.groupBy(*keys).agg(
        F.count("*").alias("field_count"), F.avg("confidence").alias("avg_confidence"), F.sum(F.when(F.col("confidence") < threshold, 1).otherwise(0)).alias("low_confidence_count"),
        F.min(stamp).alias("first_extracted"), F.max(stamp).alias("last_extracted"), F.sum(F.coalesce("cost", F.lit(0.0))).alias("total_cost"),
    ).where("avg_confidence is not null")


def flattened(results: DataFrame) -> DataFrame:
    """Field rows of results (document_id, fields: array of struct path, value, confidence, bbox): values that are null stay null."""
    f = results.select("document_id", F.explode_outer("fields").alias("f")).where("f is not null")
    return f.select(F.concat_ws(":", "document_id", "f.path").alias("field_id"), "document_id", F.col("f.path").alias("path"), F.col("f.value").alias("value"), F.col("f.confidence").alias("confidence"), F.to_json("f.bbox").alias("source_bbox"))


def gold_records(fields: DataFrame, silver_version: int, stamp: str, run_id: str | None, threshold: float = LOW_CONFIDENCE) -> DataFrame:
    """The whole record of each document: its hash and schema, the record as JSON, quality, and what it was made from and when (silver_version, conformed_at, run_id)."""
    keys = ["document_id", "content_hash", "schema_name", "schema_version"]
    records = conformed(fields, keys, threshold).where("quality_score is not null")
    return records.select(*keys, "record_json", "quality_score", "field_count", "low_confidence_count", F.lit(silver_version).cast("long").alias("silver_version"), F.lit(stamp).cast("timestamp").alias("conformed_at"), F.lit(run_id).cast("string").alias("run_id"))


def status_counts(results: DataFrame) -> DataFrame:
    """Documents, tokens and cost of each status of an extraction's results."""
    return results.groupBy("status").agg(F.count("*").alias("documents"), F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"), F.round(F.coalesce(F.sum(cost(F.col("tokens_in"), F.col("tokens_out"))), F.lit(0.0)), 6).alias("cost"))


def paced(docs: DataFrame, fn: Callable[[Iterator], Iterator], schema: str, order: list[str], rpm: float, tpm: float) -> tuple[DataFrame, DataFrame]:
    """An injected extractor held to limits: documents (with ``tokens``) get the second at which the limits let them through, and batches reach ``fn`` ordered by it, each with its column start_s to wait for. Second: those that no bucket can hold, for quarantine."""
    from recordloom.operators.budget import oversize, token_slots

    slots = token_slots(docs, order, rpm, tpm)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return slots.repartitionByRange(parts, "start_s", *order).sortWithinPartitions("start_s", *order).mapInPandas(fn, schema), oversize(docs, tpm)


def paced_calls(docs: DataFrame, key: str, ask: Callable[[dict], str], lanes: int, folder: str, rpm: float, tpm: float, minute: float = 60.0) -> tuple[DataFrame, DataFrame]:
    """An injected call for each document (``key`` and ``tokens``, other columns are handed on) that is held to its limits while it runs: key, answer, asked_at (null if it had been answered before).

    ``lanes`` tasks run at once, as one barrier stage (there must be as many cores), begin by one clock, and have an equal share of the limits each: in no ``minute`` does a lane make more than its share of calls or ask for more than its share of tokens. An answer is
    written to ``folder`` (shared), under its key, before the next call; a task that is run again, or a later run, takes it from there and asks nothing twice. Second: documents that need more tokens than a lane has, for quarantine."""
    lanes = max(1, min(lanes, int(rpm)))
    share_calls, share_tokens = int(rpm) // lanes, tpm / lanes
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        from pyspark import BarrierTaskContext

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        begin = max(map(float, BarrierTaskContext.get().allGather(repr(time.time()))))
        made: deque = deque()  # (time, tokens) of the calls of the last minute
        for b in batches:
            keys, answers, asked = [], [], []
            for row in b.to_pylist():
                file = f"{path}/{hashlib.sha256(repr(row[key]).encode()).hexdigest()}"
                if (info := store.get_file_info(file)).type == fs.FileType.File:
                    with store.open_input_file(file) as f:
                        answer, at = f.read().decode(), None
                    if info.mtime_ns > (time.time() - minute) * 1e9:  # of an attempt before this one
                        made = deque(sorted([*made, (info.mtime_ns / 1e9, row["tokens"])]))
                else:
                    while True:
                        now = max(time.time(), begin)
                        while made and made[0][0] <= now - minute:
                            made.popleft()
                        if len(made) < share_calls and sum(n for _, n in made) + row["tokens"] <= share_tokens:
                            break
                        time.sleep(max(0.001, made[0][0] + minute - now))
                    time.sleep(max(0.0, begin - time.time()))
                    at = time.time()
                    made.append((at, row["tokens"]))
                    answer = ask(row)
                    part = f"{file}.{uuid.uuid4().hex}"  # an attempt that is given up may still write
                    with store.open_output_stream(part) as f:
                        f.write(answer.encode())
                    store.move(part, file)
                keys.append(row[key])
                answers.append(answer)
                asked.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(key).type), pa.array(answers, pa.string()), pa.array(asked, pa.float64())], [key, "answer", "asked_at"])

    small = F.col("tokens") <= share_tokens
    dealt = docs.where(small).repartition(lanes, key).sortWithinPartitions(key)
    return dealt.mapInArrow(run, f"`{key}` {kind}, answer string, asked_at double", barrier=True), docs.where(~small).withColumn("reason", F.lit("oversize_request"))


def extract_with(docs: DataFrame, fn: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """An injected extractor over batches of rows; pace them by the slots of ``operators.budget``."""
    return docs.mapInPandas(fn, schema)
