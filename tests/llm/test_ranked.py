"""Ranked search against a search that scores every document for every item."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from recordloom.llm import ranked
from recordloom.llm.positional import words

SCHEMA = "doc_id long, text string, term string, n long, items string, score long"


def brute(docs, items, k):
    own = [(i, Counter(words(t or ""))) for i, t in docs]
    size = [sum(c.values()) for _, c in own]
    n_docs, n_terms = sum(n > 0 for n in size), sum(size)
    df = Counter(w for _, c in own for w in c)
    out = []
    for item, text in items:
        terms = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) for w in set(words(text or "")) if df[w]}
        found = []
        for (i, c), n in zip(own, size):
            score = sum(w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * (50 + 50 * n * n_docs // n_terms))) for t, w in terms.items() if c[t])
            if score:
                found.append((score, i))
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, r + 1, i, s) for r, (s, i) in enumerate(found[:k])]
    return out


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "Überall", "x1"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda n: " ".join(r.choices(vocabulary, weights, k=n))
    docs = [(i, text(r.choice([1, 5, 30, 200]))) for i in range(300)]
    docs += [(None, "w1 w2"), (300, None), (301, ""), (302, "..."), (303, "w59 " * 3000), *[(400 + i, docs[0][1]) for i in range(80)], docs[3], docs[3]]
    items = [(1, text(12)), (2, "W1, w1; w2"), (3, None), (4, "absent"), (5, " ".join(vocabulary)), (6, docs[0][1]), (7, "w58 w59 w0"), (None, "w3 w50")]
    return docs, items


@pytest.mark.parametrize(("k", "shard"), [(5, 300), (50, 2_000_000), (1, 2000)])
def test_against_all_scores(spark, k, shard):
    docs, items = corpus(k)
    d = spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in docs], SCHEMA).repartition(3)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, item string")
    out = [tuple(r) for r in ranked.rank(d, b, k, shard_words=shard, block_terms=40).collect()]
    assert sorted(out, key=str) == sorted(brute(docs, items, k), key=str)


def test_empty(spark):
    docs, items = corpus(1)
    d = spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in docs[:5]], SCHEMA)
    b = spark.createDataFrame(items, "item_id long, text string")
    assert ranked.rank(d.limit(0), b).count() == ranked.rank(d, b.limit(0)).count() == ranked.rank(d.selectExpr("doc_id", "cast(null as string) as text"), b).count() == 0


def test_limit_on_accumulators(monkeypatch):
    """The list of a term that comes after the limit makes no accumulator, and the survivors' scores are whole."""
    r = np.random.default_rng(2)
    rare, often = np.sort(r.choice(1000, 30, replace=False)), np.arange(1000)
    terms = [(9000, rare, r.integers(100, 900, 30)), (50, often, r.integers(1, 900, 1000))]
    own, score = ranked.best_in_shard(terms, 1000, 10)
    assert set(own) <= set(rare) and len(own) < 1000
    whole = np.zeros(1000, np.int64)
    for w, docs, x in terms:
        whole[docs] += w * x
    assert (whole[own] == score).all() and set(np.argsort(-whole, kind="stable")[:10]) <= set(own)
