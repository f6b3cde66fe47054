"""The quality query on the test tables: scores against a local computation, and accuracy on labels that were held out."""

import os
import zlib

import numpy as np
import pytest

from recordloom.llm import ranking
from recordloom.llm.queries import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = {r.doc_id: r for r in queries()["op5_pairwise_ranking"](spark, SF).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(out) == set(texts)
    known = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i in known if zlib.crc32(str(i).encode()) % 5 == 0 and i in out]
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in out)
    assert len(held) > 50 and np.mean([out[i].predicted == known[i] for i in held]) > 0.95
    model = ranking.fit(docs, labels)
    local = model.scores(np.array([ranking.features(texts[i] or "") for i in sorted(texts)]))
    assert np.allclose(local, [out[i].score for i in sorted(texts)])
    # labels of held-out rows teach nothing
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality", "toxic")
    assert np.allclose(model.weights, ranking.fit(docs, flipped).weights)


def test_repeated_ids_bring_one_text(spark):
    rows = [(i, f"Plain words, number {i}.") for i in range(40)] + [(100 + i, f"BUY!! {i}") for i in range(40)]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    again = docs.unionByName(docs).unionByName(spark.createDataFrame([(0, "zzz")] * 50, docs.schema))
    assert np.allclose(ranking.fit(docs, labels).weights, ranking.fit(again, labels).weights)
