"""Operator 2: exact removal of repeated byte strings with distributed suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. Strings are judged on the input.

Dealing. Each string of that length has an anchor: of the GRAM-byte grams inside it the one of least hash, the leftmost of equals. Equal strings have equal anchors, so all starts of a string are dealt to
the bucket of its anchor's gram. The strings of one anchor place start in a row and make up a segment of the text. Segments are first told by a hash: those that occur twice are repeated throughout. A task
settles equal segments among its own documents before anything is shuffled and sends one of them on, so a hot passage arrives once from each task. Of the others only those can hold repeated strings that share
more than half of one, on the left or right of the anchor, with another segment. Only their bytes travel.

Suffix arrays. A bucket's segments are one text, read as tokens that end at certain bytes, so that their order is that of their bytes. The suffixes that start at tokens are sorted by ``grouping.suffix_array`` and
their common prefixes measured. A string that starts inside a token is repeated if another one starts with the same part of a token and goes on with a suffix whose common prefix with its own reaches far enough;
for each length of such a part that is a run of the suffix array. Memory: a task holds the segments of a bucket, whose number follows ``spark.sql.shuffle.partitions``.

Results: see ``repeated_spans``; columns that are kept may have any names; null texts count as empty; texts shorter than ``length`` keep every byte. Rows are told apart by a hash of id and text: rows that repeat both are copies of each other. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .grouping import suffix_array
from .jaccard import _mixed, _powers
from .shared import release_shuffles, shuffle_partitions, text_or_empty, without_collector, written

GRAM = 20
#: Entries (48 bytes each) that a task settles among themselves at a time.
SETTLED_ENTRIES = 500_000
#: Buckets for each shuffle partition, and the rows (8 bytes each) up to which a list of them is broadcast.
BUCKETS_EACH, BROADCAST_ROWS = 4, 1_000_000
_PIECE = 1 << 22
_ENTRY = np.dtype([("segment", "<u8"), ("left", "<u8"), ("right", "<u8"), ("row", "<i8"), ("start", "<i8"), ("size", "<i4"), ("copies", "<i4")])
_ENDS = np.zeros(256, bool)
_ENDS[[0x20, 9, 10, 13]] = True
_ENDS[[x for x in range(128, 256) if x % 8 == 0]] = True


def anchors(data: bytes, length: int) -> tuple[np.ndarray, ...]:
    """Segments of a text: start, end, hash, hashes of the left and right more-than-half of a string at its anchor (0: not inside), and the gram's hash."""
    parts = []
    for base in range(0, max(0, len(data) - length + 1), _PIECE):
        own = data[base : base + _PIECE + length - 1]
        n, reach = len(own), length - GRAM + 1
        up, down = _powers(n + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((np.frombuffer(own, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:-1])])
        grams = _mixed((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
        best = (grams & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while width < reach:
            step = min(width, reach - width)
            best = np.minimum(best[:-step], best[step:])
            width += step
        place = (best & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        place = place[first]
        end = np.concatenate([first[1:], [len(best)]]) - 1 + length
        half = (length - GRAM) // 2
        view = memoryview(own)
        segment = np.fromiter((xxhash.xxh3_64_intdigest(view[s:e]) for s, e in zip(first.tolist(), end.tolist())), np.uint64, len(first))

        def of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            a, b = np.clip(a, 0, n), np.clip(b, 0, n)
            return _mixed((sums[b] - sums[a]) * down[a]) | np.uint64(1)

        left = np.where(place - half >= first, of(place - half, place + GRAM), np.uint64(0))
        right = np.where(place + GRAM + half <= end, of(place, place + GRAM + half), np.uint64(0))
        parts.append((first + base, end + base, segment, left, right, grams[place]))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else tuple(np.zeros(0, t) for t in (np.int64, np.int64, *[np.uint64] * 4))


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans [start, end) as disjoint ones that don't touch, in order."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(spans) - 1]])
    return np.stack([spans[new, 0], reach[last]], 1)


def _by_row(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(row, its merged spans) of each row."""
    order = np.argsort(rows, kind="stable")
    rows, spans = rows[order], np.stack([starts[order], ends[order]], 1)
    cuts = np.flatnonzero(np.diff(rows)) + 1
    for part, own in zip(np.split(rows, cuts), np.split(spans, cuts)):
        if len(part):
            yield int(part[0]), merged(own)


def repeated_starts(segments: list[bytes], copies: list[int], length: int) -> list[np.ndarray]:
    """For each segment, the starts in it of strings that occur elsewhere in the segments (or in its copies)."""
    bounds = np.cumsum([0] + [len(s) for s in segments])
    text = b"".join(segments)
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    stop = np.zeros(n, bool)
    stop[bounds[1:] - 1] = True
    token_end = np.flatnonzero(_ENDS[data] | stop) + 1
    token_start = np.concatenate([[0], token_end[:-1]])
    tokens = [text[a:b] for a, b in zip(token_start.tolist(), token_end.tolist())]
    numbers = {t: i + 1 for i, t in enumerate(sorted(set(tokens)))}
    # a separator, the least symbol, after each segment
    symbol = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
    last = np.searchsorted(token_end, bounds[1:])
    sequence = np.insert(symbol, last + 1, 0)
    origin = np.insert(np.arange(len(tokens)), last + 1, -1)
    found = origin[suffix_array(sequence)]
    order = found[found >= 0]
    at = token_start[order]
    segment_of = np.searchsorted(bounds, at, side="right") - 1
    left = bounds[segment_of + 1] - at
    up, down = _powers(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1])])
    common = np.zeros(len(at), np.int64)  # with the suffix before, up to ``length`` bytes
    most = np.minimum(np.minimum(left[1:], left[:-1]), length)
    low, high = np.zeros(len(most), np.int64), most.copy()
    while (low < high).any():
        mid = (low + high + 1) // 2
        a, b = at[:-1], at[1:]
        same = (sums[a + mid] - sums[a]) * down[a] == (sums[b + mid] - sums[b]) * down[b]
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    common[1:] = low
    rank = np.empty(len(tokens), np.int64)
    rank[order] = np.arange(len(order))
    # strings, by the length of the part of a token that they start with
    sizes = bounds[1:] - bounds[:-1]
    inside = np.ones(n, bool)
    for b, size in zip(bounds[1:], sizes):
        inside[b - min(size, length - 1) : b] = False
    starts = np.flatnonzero(inside)
    token = np.searchsorted(token_start, starts, side="right")  # the first token that starts later, as only bytes of the string tell
    part = np.where(token < len(tokens), token_start[np.minimum(token, len(tokens) - 1)], n) - starts
    part = np.minimum(part, length)
    head = (sums[starts + part] - sums[starts]) * down[starts]
    repeated = np.zeros(len(starts), bool)
    by_part = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[by_part])) + 1
    for own in np.split(by_part, cuts):
        if not len(own):
            continue
        p = int(part[own[0]])
        run = np.cumsum(common < length - p)[rank[token[own]]].astype(np.uint64) if p < length else np.zeros(len(own), np.uint64)
        key = _mixed(_mixed(head[own]) + run)
        _, where, count = np.unique(key, return_inverse=True, return_counts=True)
        repeated[own] = count[where] > 1
    which = np.searchsorted(bounds, starts, side="right") - 1
    repeated |= np.asarray(copies)[which] > 1
    cuts = np.searchsorted(which, np.arange(1, len(segments)))
    return [s - b for s, b in zip(np.split(starts[repeated], np.searchsorted(np.flatnonzero(repeated), cuts)), bounds)]


_SPANS = "row long, spans binary"


def _dealt(src: DataFrame, length: int, buckets: int) -> DataFrame:
    """bucket, row, data: entries of segments for a bucket, or (row not null) spans that a task found among its own documents."""

    def settled(parts):
        entries, bucket = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        _, first, where, count = np.unique(entries["segment"], return_index=True, return_inverse=True, return_counts=True)
        twice = count[where] > 1
        rows = [(row % buckets, row, spans.astype("<i8").tobytes()) for row, spans in _by_row(entries["row"][twice], entries["start"][twice], (entries["start"] + entries["size"])[twice])]
        sent, bucket = entries[first], bucket[first]
        sent["copies"] = np.minimum(count, 2)
        order = np.argsort(bucket, kind="stable")
        sent, bucket = sent[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for k, own in zip(np.split(bucket, cuts), np.split(sent, cuts)):
            if len(own):
                rows.append((int(k[0]), None, own.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "row", "data"])

    def run(batches):
        parts, held = [], 0
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                start, end, segment, left, right, gram = anchors(text.encode("utf-8", "surrogatepass"), length)
                e = np.zeros(len(start), _ENTRY)
                e["segment"], e["left"], e["right"], e["row"], e["start"], e["size"], e["copies"] = segment, left, right, row, start, end - start, 1
                parts.append((e, (gram % np.uint64(buckets)).astype(np.int64)))
                held += len(e)
            if held >= SETTLED_ENTRIES:
                yield settled(parts)
                parts, held = [], 0
        if parts:
            yield settled(parts)

    return src.mapInArrow(run, "bucket long, row long, data binary")


def _met(dealt: DataFrame) -> DataFrame:
    """row, spans, wanted, bucket: spans of segments that occur twice; and entries whose bytes must be compared, by row."""

    def settled(bucket: int, held: list[bytes]):
        e = np.frombuffer(b"".join(held), _ENTRY)
        _, first, where, total = np.unique(e["segment"], return_index=True, return_inverse=True, return_counts=True)
        copies = np.bincount(where, weights=e["copies"]).astype(np.int64)
        twice = copies[where] > 1
        for row, spans in _by_row(e["row"][twice], e["start"][twice], (e["start"] + e["size"])[twice]):
            yield row, spans.astype("<i8").tobytes(), None, None
        one = e[first]
        wanted = np.zeros(len(one), bool)
        for side in ("left", "right"):
            _, where, count = np.unique(one[side], return_inverse=True, return_counts=True)
            single = np.bincount(where, weights=copies == 1) > 0
            wanted |= (one[side] > 0) & (count[where] > 1) & single[where]
        chosen, copies = one[wanted], copies[wanted]
        order = np.argsort(chosen["row"], kind="stable")
        chosen, copies = chosen[order], copies[order]
        cuts = np.flatnonzero(np.diff(chosen["row"])) + 1
        for own, c in zip(np.split(chosen, cuts), np.split(copies, cuts)):
            if len(own):
                yield int(own["row"][0]), None, np.stack([own["start"], own["size"], np.minimum(c, 2)], 1).astype("<i8").tobytes(), bucket

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.int64())], ["row", "spans", "wanted", "bucket"])

    def run(batches):
        held, current = [], None
        for b in batches:
            rows = []
            for bucket, row, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if row is not None:
                    rows.append((row, data, None, None))
                    continue
                if bucket != current and held:
                    rows += settled(current, held)
                    held = []
                current = bucket
                held.append(data)
            yield out(rows)
        if held:
            yield out(list(settled(current, held)))

    n = shuffle_partitions(dealt.sparkSession)
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, f"{_SPANS}, wanted binary, bucket long")


def _compared(texts: DataFrame, length: int) -> DataFrame:
    """row, spans of the entries that ``texts`` (row, text, wanted, bucket) asks for: a suffix array for each bucket."""

    def cut(batches):
        for b in batches:
            rows = []
            for row, text, wanted, bucket in zip(*(b.column(i).to_pylist() for i in range(4))):
                data = text.encode("utf-8", "surrogatepass")
                for start, size, copies in np.frombuffer(wanted, "<i8").reshape(-1, 3).tolist():
                    rows.append((bucket, row, start, copies, data[start : start + size]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["bucket", "row", "start", "copies", "segment"])

    def sort(batches):
        held, current = [], None

        def settled():
            found = repeated_starts([h[3] for h in held], [h[2] for h in held], length)
            rows = np.concatenate([np.full(len(x), h[0], np.int64) for x, h in zip(found, held)])
            starts = np.concatenate([x + h[1] for x, h in zip(found, held)])
            return [(row, spans.astype("<i8").tobytes()) for row, spans in _by_row(rows, starts, starts + length)]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["row", "spans"])

        for b in without_collector(batches):  # the suffix array's lists hold no cycles
            rows = []
            for bucket, *entry in zip(*(b.column(i).to_pylist() for i in range(5))):
                if bucket != current and held:
                    rows += settled()
                    held = []
                current = bucket
                held.append(entry)
            yield out(rows)
        if held:
            yield out(settled())

    segments = texts.mapInArrow(cut, "bucket long, row long, start long, copies long, segment binary").dropDuplicates(["row", "start"])
    n = shuffle_partitions(texts.sparkSession)
    return segments.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(sort, _SPANS)


def _sources(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    text = text_or_empty()
    return docs.select(F.xxhash64(F.col("doc_id").cast("string"), text).alias("row"), text.alias("text"), F.struct(*keep).alias("kept") if keep else F.lit(0).alias("kept"))


def repeated_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """row, spans (binary, pairs of int64): the bytes to remove; one row for each bucket that found some."""
    spark = docs.sparkSession
    src = _sources(docs, ()).where(F.octet_length("text") >= length).select("row", "text")
    found = written(_met(_dealt(src, length, BUCKETS_EACH * shuffle_partitions(spark))), "segments_met")
    release_shuffles(spark)
    wanted = found.where("wanted is not null").select("row", "wanted", "bucket")
    rows = written(wanted.select("row").distinct(), "rows_wanted")
    few = rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = src.join(F.broadcast(rows), "row", "left_semi") if few else src
    compared = written(_compared(texts.join(wanted.hint("shuffle_hash"), "row").select("row", "text", "wanted", "bucket"), length), "segments_compared")
    release_shuffles(spark)
    return found.where("spans is not null").select("row", "spans").unionByName(compared)


def without_repeats(docs: DataFrame, length: int = 200, keep: tuple[str, ...] = ("doc_id",), finish=None, schema: str = "data binary, removed array<array<long>>", more: tuple[str, ...] = ("data", "removed")) -> DataFrame:
    """The kept columns, data (the text's bytes), and removed (its maximal removed runs, as [start, end)); or, with ``finish``, what it makes of the lists of both, in the columns of ``schema``."""
    spans = repeated_spans(docs, length).groupBy("row").agg(F.collect_list("spans").alias("spans"))
    joined = _sources(docs, keep).join(spans.hint("shuffle_hash"), "row", "left").select("kept", "text", "spans")

    def run(batches):
        for b in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            spans = [merged(np.frombuffer(b"".join(s or ()), "<i8").reshape(-1, 2)).tolist() for s in b.column("spans").to_pylist()]
            made = finish(texts, spans) if finish else [pa.array(texts, pa.binary()), pa.array(spans, pa.list_(pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([b.column("kept"), *made], ["kept", *more])

    return joined.mapInArrow(run, StructType([joined.schema["kept"], *StructType.fromDDL(schema)])).select("kept.*", *more)


def kept_text(data: bytes, removed: list[list[int]]) -> str:
    """What is left as text: a character of which a byte went goes whole."""
    return kept_bytes(data, removed).decode("utf-8", "ignore")


def kept_bytes(data: bytes, removed: list[list[int]]) -> bytes:
    out, at = [], 0
    for s, e in removed:
        out.append(data[at:s])
        at = e
    return b"".join([*out, data[at:]])


def digests(docs: DataFrame, length: int = 200) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def digested(data, removed):
        return [
            pa.array(map(len, data), pa.int64()), pa.array([sum(e - s for s, e in r) for r in removed], pa.int64()), pa.array(map(len, removed), pa.int64()),
            pa.array([hashlib.sha256(kept_bytes(d, r)).hexdigest() for d, r in zip(data, removed)], pa.string()),
        ]

    return without_repeats(docs, length, ("doc_id",), digested, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", ("n_bytes", "n_removed", "n_spans", "kept_sha256"))
