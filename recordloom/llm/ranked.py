"""Operator 11: ranked lexical search, term at a time with a limit on accumulators.

The index is dealt by documents: a shard holds, for every term of some documents, which of them hold it and how often. Its rows are written as a table. The terms of the items meet it by term (blocks of at most
BLOCK_TERMS item terms, a broadcast of that size), and the lists go to their shards' tasks.

In a shard an item's terms are taken from the rarest of the corpus on; each adds its part to the accumulators of its documents. What a term can add at most in the shard is known from its list. Once the rest can't lift a
new document to the kth partial score (or to the kth score that the task has from shards before), no accumulator is made any more: the survivors alone, those that can still reach it, are looked up in the
remaining lists, and their scores are whole. A task keeps k rows for each item over all its shards; Spark ranks these.

Score: sum over an item's terms of w * ((10^9 tf) div (1000 tf + 20 m)), w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 50 + (50 n N) div L; see ``rank``.

Results: null texts have no terms and are never found. Equal scores go by ascending doc_id, null ids last; repeated rows each take a rank. Items are rows: equal or null item_ids are searched apart. An item without
terms, or whose terms no document has, has no rows. A very long text makes its shard as long. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .positional import words
from .shared import shuffle_partitions, text_or_empty, written

#: Words of a shard, unless one document has more; item terms, and items, that meet the index at a time.
SHARD_WORDS, BLOCK_TERMS, BLOCK_ITEMS = 2_000_000, 200_000, 10_000
_STEP_WORDS = 200_000


def build_index(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """shard, term, n (documents that hold it), docs (their numbers in the shard) and times (both little-endian uint32); a row with null term has the shard's doc_ids and n_words, and in n its documents with terms, in total all their terms."""

    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        ids, lengths, chunks, loose = [], [], [], []

        def coded():
            chunks.append(pa.array(list(chain.from_iterable(loose)), pa.string()).dictionary_encode())
            loose.clear()

        def closed():
            coded()
            whole = pa.chunked_array(chunks).unify_dictionaries()
            code = np.concatenate([c.indices.to_numpy() for c in whole.chunks]).astype(np.int64)
            terms = whole.chunk(0).dictionary
            n_docs, size = len(ids), np.asarray(lengths, np.int64)
            key, times = np.unique(code * n_docs + np.repeat(np.arange(n_docs), size), return_counts=True)
            term, doc = key // n_docs, key % n_docs
            n = np.bincount(term, minlength=len(terms))
            offsets = pa.py_buffer((np.concatenate([[0], np.cumsum(n)]) * 4).astype(np.int32))
            packed = lambda x: pa.Array.from_buffers(pa.binary(), len(terms), [None, offsets, pa.py_buffer(x.astype("<u4"))])
            m, one = len(terms), pa.nulls(1, pa.binary())
            longs = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{part}-{seq}"] * (m + 1), pa.string()), pa.concat_arrays([terms, pa.nulls(1, pa.string())]), pa.array(np.append(n, (size > 0).sum()), pa.int64()), pa.concat_arrays([packed(doc), one]), pa.concat_arrays([packed(times), one]),
                 pa.concat_arrays([pa.nulls(m, longs), pa.array([ids], longs)]), pa.concat_arrays([pa.nulls(m, longs), pa.array([lengths], longs)]), pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array([int(size.sum())])])],
                ["shard", "term", "n", "docs", "times", "doc_ids", "n_words", "total"],
            )

        held = total = 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = words(text)
                ids.append(doc_id)
                lengths.append(len(own))
                loose.append(own)
                held, total = held + len(own), total + len(own) + 1
                if held >= _STEP_WORDS:
                    coded()
                    held = 0
                if total >= shard_words:
                    yield closed()
                    ids, lengths, chunks, held, total, seq = [], [], [], 0, 0, seq + 1
        if ids:
            yield closed()

    src = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("_text"))
    return src.mapInArrow(run, "shard string, term string, n long, docs binary, times binary, doc_ids array<long>, n_words array<long>, total long")


def terms_of(items: DataFrame) -> DataFrame:
    """item, term: the distinct terms of each numbered item."""

    def run(batches):
        for b in batches:
            own = [(i, w) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for w in dict.fromkeys(words(t))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int64()), pa.array([w for _, w in own], pa.string())], ["item", "term"])

    return items.select("item", text_or_empty().alias("_text")).mapInArrow(run, "item long, term string")


def best_in_shard(terms: list[tuple[int, np.ndarray, np.ndarray]], n_docs: int, k: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a shard, and their whole scores, among which are all that are in the item's k highest and reach ``least``. terms: weight, documents, what each adds for a weight of 1; the rarest first."""
    most = np.array([w * int(x.max()) for w, _, x in terms], np.int64)
    rest = most[::-1].cumsum()[::-1] - most  # what the terms after can add
    scores, i = np.zeros(n_docs, np.int64), 0
    reached = 0
    for i, (w, docs, x) in enumerate(terms):
        scores[docs] += w * x
        reached += int(most[i])
        if rest[i] < max(least, reached):  # no partial score is above ``reached``
            kth = int(np.partition(scores, -k)[-k]) if n_docs >= k else 0
            bar = max(least, kth)
            if rest[i] < bar:
                break
    else:
        bar = least
    rest_i = int(rest[i])
    own = np.flatnonzero((scores > 0) & (scores + rest_i >= bar))
    score = scores[own]
    for n, (w, docs, x) in enumerate(terms[i + 1 :], i + 1):
        if not len(own):
            break
        at = np.searchsorted(docs, own)
        at[at == len(docs)] = 0
        score += np.where(docs[at] == own, w * x[at], 0)
        if len(own) > 2 * k and rest[n] < bar:  # fewer survivors as the rest shrinks
            bar = max(bar, int(np.partition(score, -k)[-k]))
            on = score + rest[n] >= bar
            own, score = own[on], score[on]
    return own, score


def _highest(score: np.ndarray, ids: np.ndarray, null: np.ndarray, k: int):
    if len(score) > 4 * k:
        on = score >= np.partition(score, -k)[-k]
        score, ids, null = score[on], ids[on], null[on]
    order = np.lexsort((ids, null, -score))[:k]
    return score[order], ids[order], null[order]


def search(index: DataFrame, asked: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item, doc_id, score: of each task's shards the k best documents of every item of a block. asked: term, items (array of item and weight)."""

    def run(batches):
        best: dict[int, tuple] = {}
        shard, rows = None, []

        def searched():
            head = next(r for r in rows if r["term"] is None)
            lengths = head["n_words"]
            m20 = np.array([20 * (50 + 50 * n * n_docs // max(1, n_terms)) for n in lengths], np.int64)
            ids = np.array([x or 0 for x in head["doc_ids"]], np.int64)
            null = np.array([x is None for x in head["doc_ids"]], bool)
            of_item: dict[int, list] = {}
            for r in rows:
                if r["term"] is not None:
                    docs, tf = (np.frombuffer(r[c], "<u4").astype(np.int64) for c in ("docs", "times"))
                    x = 1_000_000_000 * tf // (1000 * tf + m20[docs])
                    for a in r["items"]:
                        of_item.setdefault(a["item"], []).append((a["weight"], docs, x))
            for item, terms in of_item.items():
                terms.sort(key=lambda t: -t[0])
                before = best.get(item)
                own, score = best_in_shard(terms, len(ids), k, int(before[0][-1]) if before and len(before[0]) == k else 0)
                found = score > 0
                own, score = own[found], score[found]
                now = score, ids[own], null[own]
                best[item] = _highest(*(np.concatenate(x) for x in zip(before, now)), k) if before else _highest(*now, k)

        for b in batches:
            for r in b.to_pylist():
                if r["shard"] != shard and rows:
                    searched()
                    rows = []
                shard = r["shard"]
                rows.append(r)
        if rows:
            searched()
        for item, (score, ids, null) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item), pa.int64()), pa.array(ids, pa.int64(), mask=null), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    own = index.select("shard", "term", "docs", "times", "doc_ids", "n_words").join(F.broadcast(asked), "term", "left").where("items is not null or term is null")
    dealt = own.repartition(shuffle_partitions(index.sparkSession), "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "item long, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = 50, shard_words: int = SHARD_WORDS, block_terms: int = BLOCK_TERMS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score of the k highest documents of each item with a score above 0. N, L: documents with terms, and all their terms; n, tf, df as usual."""
    numbered = written(items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()), "items")
    index = written(build_index(docs, shard_words), "index", compression="zstd")
    n_docs, n_terms = index.where("term is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    own = written(terms_of(numbered), "terms")
    held = index.where("term is not null").select("term", "n").join(own.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2 * n_docs + 2) / (2 * F.col("df") + 1)))
    weighted = written(own.join(held.select("term", weight.alias("weight")), "term").where("weight > 0"), "weights")
    total, n_items = weighted.agg(F.count("*"), F.count_distinct("item")).first()
    n_blocks = max(1, -(-total // block_terms), -(-n_items // block_items))
    found = None
    for b in range(n_blocks):
        block = weighted.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == b).groupBy("term").agg(F.collect_list(F.struct("item", "weight")).alias("items"))
        part = search(index, block, n_docs, n_terms, k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
