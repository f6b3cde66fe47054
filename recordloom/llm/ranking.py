"""Operator 5: a quality classifier learnt as a Bradley-Terry ranking.

A pair of labelled documents, one of label 1 and one of label 0, is a comparison that the first has won. The probability of that is the logistic
function of the difference of their scores, and a score is linear in the features of a text; so logistic loss on differences of features gives the
weights (Newton steps). The threshold is the quantile of the training scores that parts the labels best (balanced accuracy); a score is given out as the logistic function of its
distance from there, shifted so that the threshold stands at ``cut``.

Features are shares of a text: classes of characters and of neighbouring runs of classes, repeated words and lines, lengths of words and lines. Labels, language,
source and id are never among them. Fitting takes at most ``most`` rows of each label, chosen by a hash of doc_id, so its cost doesn't follow the input; features and scores are computed
for all rows.

Results: a null text counts as empty and is scored like one. Without labels of both kinds every score is the share of label 1 (0.5 without any). Null ids are never held out and
never labelled. Repeated rows get a row each; of several labels for an id the lowest counts, of several texts the least is learnt from. Very long texts are read whole. Other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty

#: Labelled rows of each kind, and pairs of them, that a fit takes at most.
MOST_ROWS, PAIRS = 8000, 40_000

_CLASSES = 12


def _byte_classes() -> np.ndarray:
    c = np.full(256, 11, np.uint8)
    c[ord("A") : ord("Z") + 1] = 0
    c[ord("a") : ord("z") + 1] = 1
    c[128:] = 1
    c[ord("0") : ord("9") + 1] = 2
    for chars, k in ((" \t", 3), ("\n\r", 4), (".", 5), (",", 6), ("!", 7), ("?", 8), ("'\"", 9), ("|", 10)):
        for x in chars:
            c[ord(x)] = k
    return c


_CLASS_OF = _byte_classes()
N_FEATURES = _CLASSES + _CLASSES * _CLASSES + 10


def features(text: str) -> np.ndarray:
    """Shares and mean lengths; zeros for an empty text but for the last, which marks it."""
    out = np.zeros(N_FEATURES)
    data = text.encode("utf-8", "surrogatepass")
    words = text.split()
    if not words:
        out[-1] = 1
        return out
    kinds = _CLASS_OF[np.frombuffer(data, np.uint8)]
    out[:_CLASSES] = np.bincount(kinds, minlength=_CLASSES) / len(kinds)
    runs = kinds[np.concatenate([[True], kinds[1:] != kinds[:-1]])]
    pairs = np.bincount(runs[:-1].astype(np.int64) * _CLASSES + runs[1:], minlength=_CLASSES * _CLASSES)
    out[_CLASSES : _CLASSES + _CLASSES * _CLASSES] = pairs / max(1, len(runs) - 1)
    n, distinct = len(words), set(words)
    lines = [x for x in text.split("\n") if x.strip()]
    same = sum(map(eq, words, words[1:]))
    bigrams = len(set(zip(words, words[1:])))
    out[-10:] = (
        len(distinct) / n, same / n, math.log(n) / 10, min(len(data) / n, 40) / 10, len(set(lines)) / len(lines), math.log(1 + n / len(lines)) / 5,
        bigrams / max(1, n - 1), sum(map(len, distinct)) / len(distinct) / 10, sum(len(w) <= 3 for w in words) / n, 0,
    )
    return out


@dataclass(frozen=True)
class Ranking:
    weights: tuple[float, ...]
    threshold: float
    quantile: float
    cut: float
    constant: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = x @ np.asarray(self.weights) - self.threshold + math.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_pairs(good: np.ndarray, bad: np.ndarray, cut: float, pairs: int = PAIRS, ridge: float = 1e-3, steps: int = 12) -> Ranking:
    """Weights from comparisons of rows of ``good`` with rows of ``bad``, then the threshold."""
    draw = np.random.default_rng(5)
    n = min(pairs, len(good) * len(bad))
    x = np.concatenate([good, bad])
    scale = np.maximum(x.std(0), 1e-3)
    d = (good[draw.integers(len(good), size=n)] - bad[draw.integers(len(bad), size=n)]) / scale
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ (1 - p) / n - ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / n + ridge * np.eye(len(w))
        w = w + np.linalg.solve(hess, grad)
    w = w / scale
    scores = np.concatenate([good @ w, bad @ w])
    label = np.concatenate([np.ones(len(good)), np.zeros(len(bad))])
    order = np.argsort(scores, kind="stable")
    scores, label = scores[order], label[order]
    below_bad, below_good = np.cumsum(1 - label), np.cumsum(label)
    balance = below_bad[:-1] / len(bad) + 1 - below_good[:-1] / len(good)
    balance[scores[1:] == scores[:-1]] = -1
    at = int(np.argmax(balance))
    return Ranking(tuple(w), float(scores[at] + scores[at + 1]) / 2, (at + 1) / len(scores), cut)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, cut: float = 0.3, most: int = MOST_ROWS) -> Ranking:
    """Learn from labelled rows that aren't held out."""
    own = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_label")).where(~held_out())
    sample = None
    for label in (0, 1):
        part = own.where(F.col("_label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        sample = part if sample is None else sample.unionByName(part)
    # of rows that repeat an id the least text counts, so that no id brings more than one
    src = docs.select("doc_id", text_or_empty().alias("_text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "_label").agg(F.min("_text").alias("_text")).select("_label", "_text")

    def run(batches):
        for b in batches:
            x = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["_label", "value"])

    rows = src.mapInArrow(run, f"_label {src.schema['_label'].dataType.simpleString()}, value array<double>").orderBy("_label", "value").collect()
    x, y = np.array([r.value for r in rows]).reshape(-1, N_FEATURES), np.array([r._label for r in rows])
    if not len(y) or y.min() == y.max():
        return Ranking((), 0.0, 0.0, cut, float(y.mean()) if len(y) else 0.5)
    return fit_pairs(x[y == 1], x[y == 0], cut)


def score(docs: DataFrame, model: Ranking, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The kept columns and a score of every row."""
    def run(batches):
        for b in batches:
            x = np.array([features(t or "") for t in b.column(at).to_pylist()]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(model.scores(x) if len(x) else [], pa.float64())], [*keep, name])

    # a kept text is not sent twice
    at = keep.index("text") if "text" in keep else len(keep)
    src = docs.select(*keep) if "text" in keep else docs.select(*keep, text_or_empty().alias("_score_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[: len(keep)])
    return src.mapInArrow(run, f"{fields}, {name} double")


def classify(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels, cut))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
