"""The pipeline's stages remove rows, not ids: null and repeated ids."""

import random

import corpus_pipeline as cp
from recordloom.llm import jaccard


def test_null_and_repeated_ids(spark, tmp_path):
    r = random.Random(8)
    text = lambda k=40: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(k))
    a, b, c, d, e, f, g, h = (text() for _ in range(8))
    rows = [(5, a), (None, a), (None, b), (None, c), (7, a + " more"), (7, d), (8, e), (8, e + " more"), (None, f), (None, f + " more"), (9, g), (9, g), (10, ""), (10, "")]
    docs = spark.createDataFrame([(*x, k) for k, x in enumerate(rows)], "doc_id long, text string, row long")
    out = jaccard.without_linked(docs)
    assert out.columns == docs.columns
    kept = sorted(((x.doc_id, x.text) for x in out.collect()), key=str)
    fixed = [(5, a), (None, b), (None, c), (7, d), (9, g), (10, ""), (10, "")]
    assert all(x in kept for x in fixed) and kept.count((9, g)) == 1 and kept.count((10, "")) == 2
    assert len(kept) == len(fixed) + 2 and sum(x in kept for x in rows[6:8]) == 1 and sum(x in kept for x in rows[8:10]) == 1
    spark.createDataFrame([(1, " ".join(h.split()[:20]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, h), (None, b), (3, "x " + h), (3, d), (4, h), (None, None)]
    out = cp.decontaminate(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert sorted(((x.doc_id, x.text) for x in out.collect()), key=str) == sorted([(None, b), (3, d), (None, None)], key=str)


def test_stages_with_clashing_names_nulls_and_long_texts(spark, tmp_path):
    r = random.Random(9)
    text = lambda k=120: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(k)) + "."
    passage, item, long = text(60), text(20), text(60_000)
    texts = [*(text() for _ in range(30)), *(f"BUY!! NOW!! {i} " * 30 for i in range(15)), text() + passage, text() + passage, text() + " " + item, None, "", long, long + " more"]
    ids = [*range(len(texts) - 7), 5, None, None, 7, None, 90, 91]
    names = ["row", "_text", "text_", "_spans", "kept", "_gone", "__gone", "_key", "_quality", "_label", "spans", "score"]
    rows = [(i, t, "en", "s", len(t or ""), *[f"{n}{k}" for n in names]) for k, (i, t) in enumerate(zip(ids, texts))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    spark.createDataFrame([(i, int(i < 30), 0) for i in range(45)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema)
    of = {r_[5]: (r_[0], r_[1]) for r_ in rows}
    for name, stage in cp.STAGES[:-1]:
        out = cp.written(stage(spark, docs, str(tmp_path)), name)
        assert out.columns == docs.columns and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
        for x in out.collect():
            k = x.row.removeprefix("row")
            assert x.doc_id == of[x.row][0] and all(x[n] == f"{n}{k}" for n in names)
            assert name == "repeats" or x.text == of[x.row][1] or passage not in (x.text or "")
        docs = out
    left = {x.row: x.text for x in docs.collect()}
    gone = [k for k in range(len(texts)) if f"row{k}" not in left]
    at = texts.index(long)
    assert {*range(30, 45)} <= set(gone) and texts.index(None) - 1 in gone and (at in gone) != (at + 1 in gone)
    assert not set(gone) & {*range(30), 45, 46} and all(passage not in (left[f"row{k}"] or "") for k in (45, 46))
    last = cp.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(last) == len(left) and all(x.round_trip for x in last)
