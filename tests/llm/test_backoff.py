"""Stupid backoff of any order against brute force."""

import math
import random
from collections import Counter

import pytest

from recordloom.llm import backoff


def brute(texts, counted, order, least, own_out):
    """(n_words, n_backoff, log_score) of each text."""
    runs = lambda x: Counter(tuple(x[i : i + k]) for k in range(1, order + 1) for i in range(len(x) - k + 1))
    words = [(t or "").lower().split() for t in texts]
    base = words if counted is None else [t.lower().split() for t in counted]
    seen, n = sum(map(runs, base), Counter()), sum(map(len, base))
    out = []
    for x in words:
        own = runs(x) if own_out else Counter()
        c = lambda run, own=own: seen[run] - own[run]

        def score(run, c=c, x=x):
            if len(run) == 1:
                return math.log(max(c(run), 1) / max(n - len(x) * own_out, 1)), 0
            if c(run) >= least:
                return math.log(c(run) / c(run[:-1])), 0
            s, back = score(run[1:])
            return s + math.log(0.4), back + 1

        own_scores = [score(tuple(x[max(0, k - order + 1) : k + 1])) for k in range(len(x))]
        out.append((len(x), sum(b > 0 for _, b in own_scores), sum(s for s, _ in own_scores)))
    return out


@pytest.mark.parametrize(("order", "least", "own_out", "other"), [(2, 1, False, False), (3, 1, True, False), (3, 2, False, False), (4, 2, True, False), (3, 1, False, True), (1, 1, True, False)])
def test_orders(spark, monkeypatch, order, least, own_out, other):
    monkeypatch.setattr(backoff, "BLOCK_BYTES", 150)
    r = random.Random(order)
    make = lambda k: [" ".join(r.choice("aabbcdEfgh") for _ in range(r.randint(0, 12))) for _ in range(k)]
    texts, counted = [None, "", " \n", "a " * 3000, *make(40)], make(30) if other else None
    texts += texts[-2:]
    docs = spark.createDataFrame([(i, t, i, "w") for i, t in enumerate(texts)], "doc_id long, text string, block long, row string")
    others = spark.createDataFrame([(t,) for t in counted], "text string") if other else None
    out = {x.doc_id: x for x in backoff.scores(docs, least=least, order=order, own_out=own_out, counted=others).collect()}
    want = brute(texts, counted, order, least, own_out)
    for i, (n, back, s) in enumerate(want):
        assert (out[i].n_words, out[i].n_backoff) == (n, back) and abs(out[i].log_score - s) < 1e-4
        assert (out[i].mean_log_score is None) == (n == 0)
    assert any(b for _, b, _ in want) == (own_out or other or least > 1) or order == 1


def test_repeated_and_null_ids(spark):
    rows = [(None, "a b c"), (None, "a b d"), (1, "a b c"), (1, "a b c"), (1, "x")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = sorted((-1 if x.doc_id is None else x.doc_id, x.n_words, x.n_backoff, round(x.log_score, 4)) for x in backoff.scores(docs, own_out=True).collect())
    want = brute([t for _, t in rows], None, 3, 1, True)
    assert got == sorted((-1 if i is None else i, n, b, round(s, 4)) for (i, _), (n, b, s) in zip(rows, want))
    assert backoff.scores(docs.limit(0)).count() == backoff.scores(docs.limit(0), counted=docs).count() == 0
    assert backoff.scores(docs, counted=docs.limit(0)).count() == 5
