"""Proximity matches against brute force, with repeated terms, and through Spark."""

import random

import numpy as np

from recordloom.llm import positional


def brute(words, terms, slack):
    """start: the least end of a match."""
    out = {}

    def walk(start, at, k):
        if k == len(terms):
            out[start] = min(out.get(start, at), at)
            return
        for j in range(at + 1, min(len(words), at + slack + 2)):
            if words[j] == terms[k]:
                walk(start, j, k + 1)

    for i, w in enumerate(words):
        if w == terms[0]:
            walk(i, i, 1)
    return out


def test_brute_force():
    r = random.Random(6)
    assert positional.find({"a": np.array([0]), "b": np.array([1, 2]), "c": np.array([4])}, ["a", "b", "c"], 1).tolist() == [0]
    for _ in range(2000):
        docs = [[r.choice("aaabbcd") for _ in range(r.randint(0, 14))] for _ in range(3)]
        lists = {t: np.array([(d << 32) + i for d, w in enumerate(docs) for i, x in enumerate(w) if x == t], np.int64) for t in "abcd"}
        terms, slack = [r.choice("abcde") for _ in range(r.randint(1, 5))], r.randint(0, 3)
        starts, lengths = positional.matches(lists, terms, slack)
        assert dict(zip(starts.tolist(), (starts + lengths - 1).tolist())) == {(d << 32) + i: (d << 32) + e for d, w in enumerate(docs) for i, e in brute(w, terms, slack).items()}


def test_contamination_with_slack(spark):
    texts = ["a b b x c", "c b a", "x a y b c x a b", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c"), (2, "b c")], "item_id long, text string")
    for slack in (0, 1):
        for block in (1, 50):
            out = {r.doc_id: (r.n_hit, r.n_items) for r in positional.contamination(docs, items, block_windows=block, slack=slack).collect()}
            for i, t in enumerate(texts):
                own = [brute((t or "").split(), x, slack) for x in (["a", "b", "c"], ["b", "c"])]
                hit = {k for found in own for s, e in found.items() for k in range(s, e + 1)}
                assert out[i] == (len(hit), sum(map(bool, own)))


def test_blocks_are_written_one_by_one(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    items = spark.createDataFrame([(k, t) for k, t in enumerate("abcdefgh")], "item_id long, text string")
    search, done = positional.search, []
    monkeypatch.setattr(positional, "shared_folder", lambda _: str(tmp_path))
    monkeypatch.setattr(positional, "search", lambda *a: done.append(len([*tmp_path.glob("hits/_SUCCESS")])) or search(*a))
    out = positional.contamination(docs, items, block_windows=3).first()
    assert done == [0, 1, 1] and (out.n_hit, out.n_items) == (7, 7)
