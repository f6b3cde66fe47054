import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from recordloom.llm import bpe, positional


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    import random

    r = random.Random(3)
    sentence = lambda k: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(k))
    passage, item = sentence(60), sentence(25)
    rows = [(i, sentence(120) + ".", "en", "s", 1, "e") for i in range(30)]
    rows += [(100 + i, f"BUY!! NOW!! {i} " * 30, "en", "s", 1, "e") for i in range(20)]
    rows += [(200, rows[0][1] + " tail", "en", "s", 1, "e"), (201, sentence(50) + " " + passage + " " + sentence(50), "en", "s", 1, "e"), (202, sentence(40) + " " + passage, "en", "s", 1, "e"), (203, sentence(50) + " " + item, "en", "s", 1, "e")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i in [*range(30), *range(100, 120)]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), passage


def test_stages(spark, folder):
    d, passage = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in cp.STAGES[:-1]:
        out = cp.written(stage(spark, kept[-1], d), name)
        assert out.columns == columns
        kept.append(out)
    ids = [{r.doc_id for r in k.collect()} for k in kept]
    assert ids[1] == ids[0] - set(range(100, 120))
    assert ids[2] == ids[1] - {200}
    assert ids[3] == ids[2]
    cut = {r.doc_id: r for r in kept[3].where(F.col("doc_id").isin(201, 202)).collect()}
    assert all(passage not in r.text and r.n_chars == len(r.text) for r in cut.values())
    assert ids[4] == ids[3] - {203}
    last = cp.STAGES[-1][1](spark, kept[-1], d).collect()
    coder = bpe.coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    text = {r.doc_id: r.text for r in kept[-1].collect()}
    assert {r.doc_id for r in last} == ids[4] and all(r.round_trip and list(r.ids) == coder.encode(text[r.doc_id]) for r in last)
    assert positional.words("Ab1 é") == ["ab1", "é"]


def test_empty(spark, folder):
    d, _ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        docs = cp.written(stage(spark, docs, d), name)
    assert docs.count() == 0
