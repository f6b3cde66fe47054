"""Operator 6: Stupid-backoff scores as joins with n-gram count tables.

Counts of the runs of 1 to ``order`` words come from all counted documents. A run found in the counts scores count(run) / count(run without its last word); else ``alpha`` is taken and the run
without its first word is looked for, down to the word itself, count / number of words. A document's first words have shorter contexts, which is not backing off. The logarithms are summed for each document.

Relations. Documents are dealt to blocks by a hash of the row. The runs of a block are exploded and counted there (equal runs are one), and make up a relation of (hash range, block, hashes, counts): a row
holds the sorted hashes that the block has in one range, as differences of as few bytes as they need. Rows of one hash range meet in a task, which holds that part of the count table: it sums the counts
by hash and joins them to the rows again, one count for each hash. The counts of a block go back to its documents, which are exploded again, scored and summed. So the runs are shuffled once, and each
range and block is bounded: there are as many as the input's size asks for, and a hot run comes once from each block.

``own_out`` leaves each document's own occurrences out of all counts, so that a document is judged by the others; a word that occurs nowhere else then counts once. ``counted`` are other documents to
count instead of ``docs``. Runs of two words or more with fewer than ``least`` counts are not found (1 keeps all that were seen).

Words are lower-cased runs without white space (A-Z only). Runs are told apart by a hash of 64 bits. Results: null or empty texts have no words, score 0 and mean null. Repeated rows are documents of their own and
get a row each. Empty tables give none. Very long texts make a block of their own at most. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .shared import shuffle_partitions, text_or_empty

ALPHA, LEAST, ORDER = 0.4, 1, 3
#: Bytes of text in a block and, for the ranges of hashes, bytes of text whose runs make up a range.
BLOCK_BYTES, RANGE_BYTES = 12 << 20, 8 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RUNS = "block long, bucket long, n int, low binary, top binary, counts binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _zip(values: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=1).compress(values, asbytes=True)


def _unzip(values: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(values, size, asbytes=True)


class Runs:
    """The runs of a block of texts: for each length the hash of the run that ends at each word, and whether the document has so many words before it."""

    def __init__(self, texts: pa.ChunkedArray, order: int):
        words = [_unzip(t[8:], int.from_bytes(t[:8], "little")).translate(_LOWER).split() for t in texts.to_pylist()]
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        coded = pa.array(list(chain.from_iterable(words)), pa.binary()).dictionary_encode()
        own = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))[coded.indices.to_numpy()]
        self.place = np.arange(len(own)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.keys = [_mix(own)]
        for _ in range(1, order):
            before = np.concatenate([np.zeros(1, np.uint64), self.keys[-1][:-1]])[: len(own)]
            self.keys.append(_mix(before * np.uint64(0x9E3779B97F4A7C15) + own))

    def all(self) -> np.ndarray:
        return np.concatenate([k[self.place >= i] for i, k in enumerate(self.keys)])


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _pack(hashes: np.ndarray, counts: np.ndarray | None) -> tuple:
    """n, the low bytes of the differences, their highest bytes (compressed), counts (compressed)."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    first, steps[0] = int(steps[0]), 0
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(hashes), first.to_bytes(8, "little") + planes[:-1].tobytes(), _zip(planes[-1].tobytes()), None if counts is None else _packed_counts(counts)


def _unpack(n: int, low: bytes, top: bytes) -> np.ndarray:
    planes = np.frombuffer(low, np.uint8, offset=8).reshape(-1, n)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, : len(planes)] = planes.T
    steps[:, len(planes)] = np.frombuffer(_unzip(top, n), np.uint8)
    return np.cumsum(steps.view("<u8")[:, 0]) + np.uint64(int.from_bytes(low[:8], "little"))


def _packed_counts(counts: np.ndarray) -> bytes:
    """A byte for each count; those of 255 or more follow in full."""
    return _zip(np.minimum(counts, 255).astype(np.uint8).tobytes()) + counts[counts >= 255].astype("<i8").tobytes() + int((counts >= 255).sum()).to_bytes(8, "little")


def _unpacked_counts(n: int, counts: bytes) -> np.ndarray:
    end = len(counts) - 8 - 8 * int.from_bytes(counts[-8:], "little")
    out = np.frombuffer(_unzip(counts[:end], n), np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(counts[end:-8], "<i8")
    return out


def _zipped(docs: DataFrame) -> DataFrame:
    """The last column, a text, as its length in bytes and its compressed bytes: it is shuffled once."""

    def run(batches):
        codec = pa.Codec("zstd", compression_level=3)
        for b in batches:
            texts = [len(t).to_bytes(8, "little") + codec.compress(t, asbytes=True) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.binary())], b.schema.names)

    return docs.mapInArrow(run, StructType([*docs.schema.fields[:-1], StructField("text", BinaryType())]))


def _runs(docs: DataFrame, order: int, buckets: int, asks: bool, adds: bool) -> DataFrame:
    """A row for each block and range of hashes. Rows without block ask for no counts, rows without counts add none."""

    def run(table: pa.Table) -> pa.Table:
        hashes, counts = np.unique(Runs(table["text"], order).all(), return_counts=True)
        found, starts = np.unique(_bucket(hashes, buckets), return_index=True)
        ends = [*starts[1:], len(hashes)]
        rows = [_pack(hashes[a:b], counts[a:b] if adds else None) for a, b in zip(starts, ends)]
        block = table["block"][0].as_py() if asks else None
        names = ["n", "low", "top", "counts"]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.binary(), pa.binary(), pa.binary()])] if rows else [pa.array([], t) for t in [pa.int32(), pa.binary(), pa.binary(), pa.binary()]]
        return pa.Table.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array(found, pa.int64()), *columns], ["block", "bucket", *names])

    return docs.groupBy("block").applyInArrow(run, _RUNS)


def _counted(table: pa.Table) -> pa.Table:
    """One range of the count table, joined to the rows that ask for it."""
    rows = table.to_pylist()
    parts = [_unpack(r["n"], r["low"], r["top"]) for r in rows]
    hashes, at = np.unique(np.concatenate(parts), return_inverse=True)
    added = np.concatenate([np.zeros(r["n"], np.int64) if r["counts"] is None else _unpacked_counts(r["n"], r["counts"]) for r in rows])
    total = np.zeros(len(hashes), np.int64)
    np.add.at(total, at, added)
    out, end = [], 0
    for r in rows:
        start, end = end, end + r["n"]
        if r["block"] is not None:
            out.append((r["block"], r["bucket"], r["n"], _packed_counts(total[at[start:end]])))
    columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, [pa.int64(), pa.int64(), pa.int32(), pa.binary()])]
    return pa.Table.from_arrays(columns, ["block", "bucket", "n", "counts"])


def _own(at: np.ndarray, document: np.ndarray, documents: int, seen: np.ndarray) -> np.ndarray:
    """How often each run occurs in its own document."""
    own = np.ones(len(at), np.int64)
    many = np.flatnonzero(seen[at] > 1)
    _, back, n = np.unique(at[many].astype(np.int64) * documents + document[many], return_inverse=True, return_counts=True)
    own[many] = n[back]
    return own


def scores(docs: DataFrame, alpha: float = ALPHA, least: int = LEAST, order: int = ORDER, own_out: bool = False, counted: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_backoff (words whose run was backed off), log_score, mean_log_score (natural logarithms)."""
    spark = docs.sparkSession
    text = text_or_empty()
    scored = docs.select("doc_id", text.alias("text"), F.xxhash64(F.col("doc_id").cast("string"), text, F.spark_partition_id()).alias("row"))
    others = counted.select(text.alias("text"), F.xxhash64(text, F.spark_partition_id()).alias("row")) if counted is not None else None
    sizes = [F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size"), F.coalesce(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))), F.lit(0)).alias("words")]
    size = scored.agg(*sizes).first()
    whole = others.agg(*sizes).first() if others is not None else size
    words = int(whole.words)
    buckets = max(shuffle_partitions(spark), -(-int(size["size"] + (whole["size"] if others is not None else 0)) // RANGE_BYTES))

    def blocks(df: DataFrame, of) -> DataFrame:
        block = F.pmod("row", F.lit(max(1, -(-int(of["size"]) // BLOCK_BYTES)))).cast("long")
        return _zipped(df.select(*(c for c in df.columns if c not in ("row", "text")), block.alias("block"), "text"))

    scored = blocks(scored, size)
    runs = _runs(scored, order, buckets, asks=True, adds=others is None)
    if others is not None:
        runs = runs.unionByName(_runs(blocks(others, whole), order, buckets, asks=False, adds=True))
    answers = runs.groupBy("bucket").applyInArrow(_counted, "block long, bucket long, n int, counts binary")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        r = Runs(left["text"], order)
        ids, n_docs = left["doc_id"], left.num_rows
        hashes, at = np.unique(r.all(), return_inverse=True)
        rows = sorted(right.to_pylist(), key=lambda x: x["bucket"])
        counts = np.concatenate([np.zeros(0, np.int64), *(_unpacked_counts(x["n"], x["counts"]) for x in rows)])
        if len(counts) != len(hashes):
            raise ValueError("the runs of a block and their counts differ: documents changed between two reads")
        seen, document = np.bincount(at, minlength=len(hashes)), np.repeat(np.arange(n_docs), r.lengths)
        found, end = [], 0
        for i in range(order):  # for each length, the counts of the run that ends at each word
            has = r.place >= i
            start, end = end, end + int(has.sum())
            c = np.zeros(len(has), np.int64)
            c[has] = counts[at[start:end]] - (_own(at[start:end], document[has], n_docs, seen) if own_out else 0)
            found.append(c)
        total = np.maximum(words - r.lengths * own_out, 1)[document]
        s, back, open_ = np.zeros(len(document)), np.zeros(len(document), np.int64), np.ones(len(document), bool)
        for i in range(order - 1, 0, -1):
            context = np.concatenate([np.zeros(1, np.int64), found[i - 1][:-1]])[: len(document)]
            has = open_ & (r.place >= i)
            hit = has & (found[i] >= max(least, 1))
            s[hit] += np.log(found[i][hit] / context[hit])
            back += has & ~hit
            open_ &= ~hit
        s[open_] += np.log(np.maximum(found[0][open_], 1) / total[open_])
        s += back * np.log(alpha)
        sums = np.bincount(document, s, n_docs).astype(np.float64)
        backed = np.bincount(document, back > 0, n_docs).astype(np.int64)
        return pa.Table.from_arrays([ids.combine_chunks(), pa.array(r.lengths), pa.array(backed), pa.array(sums)], ["doc_id", "n_words", "n_backoff", "log_score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = scored.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, f"doc_id {kind}, n_words long, n_backoff long, log_score double")
    return out.select("doc_id", "n_words", "n_backoff", F.round("log_score", 6).alias("log_score"), F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 6)).alias("mean_log_score"))
