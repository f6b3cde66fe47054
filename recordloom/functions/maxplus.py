"""Scans over a global order where a row acts on a small state by greatest values and sums: each row is a matrix of the (max, +) algebra, and matrices of neighbouring rows multiply, whatever the grouping.

So ranges of rows are reduced apart, the few products give each range the state that it begins with, and the rows of a range get theirs from there."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions.prefix import pinned

NEVER = -np.inf


def product(later: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """Of stacks of matrices: what acts like ``earlier`` and then ``later``."""
    return (later[..., :, :, None] + earlier[..., None, :, :]).max(-2)


def running_products(m: np.ndarray) -> np.ndarray:
    """Of a stack: the product of each matrix with all before it, by doubling."""
    out, step = m.copy(), 1
    while step < len(out):
        out[step:] = product(out[step:], out[:-step])
        step *= 2
    return out


def applied(m: np.ndarray, state: np.ndarray) -> np.ndarray:
    return (m + state).max(-1)


def scanned(df: DataFrame, order: list[str], matrices: Callable[[pa.RecordBatch], np.ndarray], first: list[float], by: list[str] | None = None, partitions: int | None = None, name: str = "state") -> DataFrame:
    """The rows with ``name``, the state (array of doubles) before each of them. ``matrices`` gives a batch's matrices (rows x n x n); ``first`` is the state that the order begins with, anew for each value of ``by``; ``order`` must be unique within it.

    A range tells two products at most (of its first and of its last value of ``by``), so what the driver sees is bounded by the number of ranges."""
    by, n = by or [], partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    keys = [*by, *(c for c in order if c not in by)]
    ranged = pinned(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys))
    start = np.asarray(first, float)

    def groups(b: pa.RecordBatch) -> list[tuple[tuple, int, int]]:
        """Runs of equal values of ``by``: value, first row, row after the last."""
        if not by:
            return [((), 0, b.num_rows)]
        values = list(zip(*(b.column(c).to_pylist() for c in by)))
        cuts = [0, *(k for k in range(1, len(values)) if values[k] != values[k - 1]), len(values)]
        return [(values[s], s, e) for s, e in zip(cuts, cuts[1:])]

    def reduced(batches: Iterator[pa.RecordBatch]):
        import pickle

        from pyspark import TaskContext

        own: list[list] = []  # [value, product]: of the first and of the latest
        for b in batches:
            if not b.num_rows:
                continue
            m = matrices(b)
            for value, s, e in groups(b):
                part = running_products(m[s:e])[-1]
                if own and own[-1][0] == value:
                    own[-1][1] = product(part, own[-1][1])
                else:
                    own = [*own[:1], [value, part]]
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([pickle.dumps(own)], pa.binary())], ["part", "own"])

    import pickle

    found = sorted((r.part, pickle.loads(r.own)) for r in ranged.mapInArrow(reduced, "part int, own binary").collect())
    begins, value, state = {}, None, start
    for part, own in found:
        (head, whole), last = own[0], own[-1]
        begins[part] = (head, state if head == value else start)
        state = applied(whole, begins[part][1]) if len(own) == 1 else applied(last[1], start)
        value = last[0]

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        at, now = begins.get(TaskContext.get().partitionId(), (None, start))
        for b in batches:
            if not b.num_rows:
                continue
            m, out = matrices(b), np.empty((b.num_rows, len(start)))
            for value, s, e in groups(b):
                if value != at:
                    at, now = value, start
                after = applied(running_products(m[s:e]), now)
                out[s], out[s + 1 : e] = now, after[:-1]
                now = after[-1]
            flat = pa.array(out.ravel(), pa.float64())
            states = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(start), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*b.columns, states], [*b.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return ranged.select(*df.columns).mapInArrow(run, f"{fields}, `{name}` array<double>")
