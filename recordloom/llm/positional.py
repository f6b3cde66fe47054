"""Operator 9: benchmark decontamination with a distributed positional inverted index.

The index is dealt by documents: each shard holds, for every term of some documents, the sorted places at which it stands (counted through the shard's words; kept as differences). It is written as a table of one row for each shard and
term. Test windows are dealt by their rarest term, and meet the index's lists of it by a join: a shard is asked for the windows whose rarest term it has, takes their terms from the rarest list there, shifts each list by
the term's offset, and intersects; an empty intersection or an absent term ends it. Windows come in blocks of at most BLOCK_WINDOWS, which bounds what each task is sent; none pass through the driver. Of the index a block reads the lists of its own terms only.

With ``slack``, proximity: terms of a window in order with at most so many other words between neighbours. Places are carried from the rarest term to the last, and back to the first; every
start counts, with its shortest match, all words of which are hit.

Results: null texts have no words. An item without words is never found; items with a null id mark words but are not
counted. Repeated rows get a row each. A very long text makes its shard as long. Empty tables give no rows, or no hits. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_folder, text_or_empty, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = {i: i + 32 for i in range(65, 91)}
#: Words of a shard, unless one document has more; windows sent to tasks at a time.
SHARD_WORDS, BLOCK_WINDOWS = 1_000_000, 50_000


def words(text: str, pattern: str = WORD) -> list[str]:
    return re.findall(pattern, text.translate(_UPPER))


def windows_of(items: DataFrame, length: int) -> DataFrame:
    """item_id, terms: each run of ``length`` words of an item, or all of a shorter one."""
    def run(batches):
        for b in batches:
            ids, terms = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words(t)
                for k in range(max(1, len(w) - length + 1) if w else 0):
                    ids.append(i)
                    terms.append(w[k : k + length])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(terms, pa.list_(pa.string()))], ["item_id", "terms"])

    return items.select(F.col("item_id").cast("string"), text_or_empty().alias("_text")).mapInArrow(run, "item_id string, terms array<string>")


def build_index(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """shard, term, places (differences of sorted places, int32), n (how many); a row with null term has the shard's doc_ids and n_words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        part, seq, n = TaskContext.get().partitionId(), 0, 0
        ids, found, id_type = [], [], None

        def closed():
            coded = pa.array(list(chain.from_iterable(found)), pa.string()).dictionary_encode()
            by_name = pc.sort_indices(coded.dictionary).to_numpy()
            rank = np.empty(len(by_name), np.int64)
            rank[by_name] = np.arange(len(by_name))
            code = rank[coded.indices.to_numpy()]
            place = np.argsort(code, kind="stable")
            ends = np.cumsum(np.bincount(code, minlength=len(by_name)))
            steps = np.diff(place, prepend=0)
            steps[ends[:-1]] = place[ends[:-1]]  # a list's first place stands whole
            offsets = np.concatenate([[0], ends]).astype(np.int32) * 4
            m = len(by_name)
            lists = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(offsets), pa.py_buffer(steps.astype("<i4"))])
            terms = coded.dictionary.take(pa.array(by_name))
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{part}-{seq}"] * (m + 1), pa.string()), pa.concat_arrays([terms, pa.nulls(1, pa.string())]), pa.concat_arrays([lists, pa.nulls(1, pa.binary())]),
                 pa.concat_arrays([pa.nulls(m, pa.list_(id_type)), pa.array([ids], pa.list_(id_type))]), pa.concat_arrays([pa.nulls(m, pa.list_(pa.int64())), pa.array([list(map(len, found))], pa.list_(pa.int64()))]),
                 pa.array(np.append(np.diff(ends, prepend=0), len(code)), pa.int64())],
                ["shard", "term", "places", "doc_ids", "n_words", "n"],
            )

        for b in batches:
            id_type = b.column(0).type
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(doc_id)
                found.append(words(text))
                n += len(found[-1]) + 1
                if n >= shard_words:
                    yield closed()
                    seq, n, ids, found = seq + 1, 0, [], []
        if ids:
            yield closed()

    src = docs.select("doc_id", text_or_empty().alias("_text"))
    return src.mapInArrow(run, f"shard string, term string, places binary, doc_ids array<{kind}>, n_words array<long>, n long")


def _within(own: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The places of ``own`` in any of the ranges [low, high]."""
    a, b = np.searchsorted(own, low), np.searchsorted(own, high, side="right")
    n = b - a
    return own[np.unique(np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum()))]


def matches(lists: dict[str, np.ndarray], terms: list[str], slack: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Starts of a window (document << 32 | word) and lengths in words: exact phrases, or terms in order at most ``slack`` other words apart each. Of the matches from one start, the shortest."""
    own = [lists.get(t, _NONE) for t in terms]
    rarest = min(range(len(own)), key=lambda i: len(own[i]))
    if not slack:
        starts = own[rarest] - rarest
        for places, offset in sorted(((own[i], i) for i in range(len(own)) if i != rarest), key=lambda x: len(x[0])):
            if not len(starts):
                break
            at = np.searchsorted(places, starts + offset)
            at[at == len(places)] = 0
            starts = starts[places[at] == starts + offset]
        return starts, np.full(len(starts), len(terms), np.int64)
    # all places that a chain from the rarest term reaches, to the last term; then those from which the last is reached, back to the first
    for i in range(rarest + 1, len(own)):
        own[i] = _within(own[i], own[i - 1] + 1, own[i - 1] + slack + 1)
    ends = own[-1]
    for i in range(len(own) - 2, -1, -1):
        after = own[i + 1]
        own[i] = _within(own[i], after - slack - 1, after - 1)
        ends = ends[np.searchsorted(after, own[i], side="right")]  # the nearest place after has the least end
    return own[0], ends - own[0] + 1


def find(lists: dict[str, np.ndarray], terms: list[str], slack: int = 0) -> np.ndarray:
    """The starts of ``matches``."""
    return matches(lists, terms, slack)[0]


_NONE = np.zeros(0, np.int64)


def asked_terms(apart: DataFrame, counts: DataFrame) -> DataFrame:
    """term, windows: every term of the windows (window, terms) that documents have, all of them; at a window's rarest term stands the window itself. A window with a term that no document has is left out."""
    each = apart.select("window", F.explode("terms").alias("term")).distinct().join(counts, "term", "left")
    rarest = each.groupBy("window").agg(F.min(F.struct("n", "term")).alias("_r"), F.count_if(F.col("n").isNull()).alias("_absent")).where("_absent = 0").select("window", F.col("_r.term").alias("term"))
    held = apart.join(rarest, "window")
    at_rarest = held.groupBy("term").agg(F.collect_list(F.struct("window", "terms")).alias("windows"))
    return held.select(F.explode("terms").alias("term")).distinct().join(at_rarest, "term", "left")


def search(index: DataFrame, asked: DataFrame, slack: int = 0) -> DataFrame:
    """shard, doc (in the shard), window, start, length: every occurrence of a block's windows, see ``matches``. A shard is asked for the windows whose rarest term it has. asked: see ``asked_terms``; at most BLOCK_WINDOWS windows and their terms are broadcast."""

    def run(own: pa.Table) -> pa.Table:
        shard = own.column("shard")[0].as_py()
        rows = own.select(["term", "places", "n_words", "windows"]).to_pylist()
        first = np.cumsum([0, *next(r["n_words"] for r in rows if r["term"] is None)])

        def decoded(places: bytes) -> np.ndarray:  # document << 32 | word
            at = np.cumsum(np.frombuffer(places, "<i4"))
            doc = np.searchsorted(first, at, side="right") - 1
            return doc << 32 | at - first[doc]

        packed, lists = {r["term"]: r["places"] for r in rows if r["term"] is not None}, {}
        docs, numbers, starts, lengths = [_NONE], [_NONE], [_NONE], [_NONE]
        for w in chain.from_iterable(r["windows"] or () for r in rows):
            if all(t in packed for t in w["terms"]):
                for t in w["terms"]:
                    if t not in lists:
                        lists[t] = decoded(packed[t])
                found, length = matches(lists, w["terms"], slack)
                docs.append(found >> 32)
                starts.append(found & 0xFFFFFFFF)
                numbers.append(np.full(len(found), w["window"], np.int64))
                lengths.append(length)
        docs = np.concatenate(docs)
        return pa.table({"shard": pa.array([shard] * len(docs), pa.string()), "doc": docs, "window": np.concatenate(numbers), "start": np.concatenate(starts), "length": np.concatenate(lengths)})

    asked = F.broadcast(asked.withColumn("_asked", F.lit(True)))
    own = index.select("shard", "term", "places", "n_words").join(asked, "term", "left").where("_asked or term is null")
    return own.drop("_asked").groupBy("shard").applyInArrow(run, "shard string, doc long, window long, start long, length long")


def contamination(docs: DataFrame, items: DataFrame, length: int = 10, block_windows: int = BLOCK_WINDOWS, slack: int = 0) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and hits (runs of hit words as [start, end))."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    owned = windows_of(items, length)
    owned = written(owned.select("item_id", "terms", F.xxhash64("terms").alias("window")), "windows")
    apart = written(owned.groupBy("terms").agg(F.min("window").alias("window")), "apart")
    index = written(build_index(docs), "index", compression="zstd")
    wanted = apart.select(F.explode("terms").alias("term")).distinct()
    counts = index.where("term is not null").select("term", "n").join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))
    n_blocks = max(1, -(-apart.count() // block_windows))
    counts = written(counts, "counts")
    path = f"{shared_folder(docs.sparkSession)}/hits"
    for k in range(n_blocks):
        found = search(index, asked_terms(apart.where(F.pmod(F.hash("terms"), F.lit(n_blocks)) == k), counts), slack)
        found.write.mode("append").parquet(path)
    hits = docs.sparkSession.read.schema(found.schema).parquet(path)
    items_of = owned.where("item_id is not null").select("window", "item_id").distinct()
    by_item = hits.select("shard", "doc", "window").distinct().join(items_of, "window").groupBy("shard", "doc").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    spans = hits.groupBy("shard", "doc").agg(F.collect_set(F.struct("start", "length")).alias("spans"))
    found = spans.join(by_item, ["shard", "doc"], "left")

    def covered(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            n_hit, runs = [], []
            for spans in b.column("spans").to_pylist():
                out: list[list[int]] = []
                for s in sorted((x["start"], x["start"] + x["length"]) for x in spans or ()):
                    if out and s[0] <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], s[1])
                    else:
                        out.append(list(s))
                n_hit.append(sum(e - s for s, e in out))
                runs.append(out)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("shard", "doc", "items")), pa.array(n_hit, pa.int64()), pa.array(runs, pa.list_(pa.list_(pa.int64())))], ["shard", "doc", "items", "n_hit", "hits"])

    found = found.select("shard", "doc", "items", "spans").mapInArrow(covered, "shard string, doc long, items array<string>, n_hit long, hits array<array<long>>")
    meta = index.where("term is null").select("shard", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("doc", "_d")).select("shard", F.col("doc").cast("long"), F.col("_d.doc_ids").cast(kind).alias("doc_id"), F.col("_d.n_words").alias("n_words"))
    none = F.array().cast("array<string>")
    return meta.join(found, ["shard", "doc"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), F.coalesce("hits", F.array().cast("array<array<long>>")).alias("hits"),
    )


def digests(docs: DataFrame, items: DataFrame, slack: int = 0) -> DataFrame:
    return contamination(docs, items, slack=slack).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
