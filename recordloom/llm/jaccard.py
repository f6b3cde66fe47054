"""Operator 4: Jaccard join of word n-gram sets by vertical partitioning.

All n-grams have a global order, by their 64-bit hash; it is cut into FRAGMENTS of equal ranges. A document's set falls into one segment for each fragment; for a candidate pair the
overlaps of equal fragments are counted apart and summed. Documents with equal sets form one class and only classes are joined, so copies cost nothing.

Candidates. (1) Of each class the first n-grams of the order are taken, so many that linked classes must have a tenth of a set in common among them; a class that has fewer n-grams in
common there with any other is done. (2) Of the classes left, n-grams of one class only can't overlap; a class that they make up too much of is done too. (3) Classes are compared with some
hubs of those that share a least rehashed n-gram, typical ones and any; what links gives first components. (4) What may still link are classes of different components: these are joined on the prefix by ascending frequency, under the filters of length,
position and parity signature. N-grams whose classes are all in one component are left out, so a group of near copies that hubs have joined already makes no pairs.
No step has a cap: (4) finds every link between
components whatever the hubs have joined; (3) only spares it work.

Results: see ``link_documents``. Null or empty texts have no n-gram and link with nothing. Very long texts are hashed whole. Ids may repeat: each row is a document. Other columns are not read.
Sets and classes are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .files import remove
from .shared import fresh, release_shuffles, row_key, text_or_empty, written, written_at

FRAGMENTS, ROUNDS, KEYS, HUBS = 4, 2, 3, 48
#: Classes (16 bytes each) up to which the list of those left is broadcast to the scan of texts; beyond it, the join shuffles.
BROADCAST_CLASSES = 500_000
_CHUNK = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _BASE_INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of all texts, and the number of words before each text's first (one more than texts)."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    space = _SPACE[data]
    edge = np.diff(space.astype(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    ends = ends[ends > 0] if len(ends) and ends[0] == 0 else ends
    up, down = _powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1])])
    hashes = _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    first = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(starts, first)


def shingle_sets(texts: list[str], k: int):
    """The sorted distinct hashes of each text's runs of k words, or of all its words if it has fewer."""
    chunk, size = [], 0
    for t in [*texts, None]:
        if t is not None:
            chunk.append(t.encode("utf-8", "surrogatepass"))
            size += len(chunk[-1])
        if chunk and (t is None or size >= _CHUNK):
            words, first = word_hashes(chunk)
            runs = words[: max(0, len(words) - k + 1)].copy()
            for i in range(1, k):
                runs = _mixed(runs * _BASE + words[i : i + len(runs)])
            for a, b in zip(first, first[1:]):
                if b - a >= k:
                    yield np.unique(runs[a : b - k + 1])
                elif b > a:
                    one = np.array([b - a], np.uint64)
                    for w in words[a:b]:
                        one = _mixed(one * _BASE + w)
                    yield one
                else:
                    yield np.zeros(0, np.uint64)
            chunk, size = [], 0


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of n that links."""
    return -(-percent * n // 100)


def _sets(docs: DataFrame, k: int, percent: int, whole: bool) -> DataFrame:
    """doc_id, key, n, class, grams: the first n-grams of the order, or all."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            n, cls, grams = [], [], []
            for s in shingle_sets(b.column(2).to_pylist(), k):
                m = len(s)
                n.append(m)
                cls.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))
                grams.append(s.view(np.int64) if whole else s[: m - needed(m, percent) + -(-m // 10)].view(np.int64))
            offsets = np.cumsum([0, *map(len, grams)], dtype=np.int32)
            values = pa.array(np.concatenate(grams) if grams else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values)], ["doc_id", "key", "n", "class", "grams"])

    return docs.select("doc_id", row_key().alias("key"), text_or_empty().alias("_text")).mapInArrow(run, f"doc_id {kind}, key long, n long, class long, grams array<long>")


def _common(grams: DataFrame) -> DataFrame:
    """The n-grams of (class, gram) that more than one class has, and how many rows."""
    return grams.groupBy("gram").agg(F.min("class").alias("_a"), F.max("class").alias("_b"), F.count("*").alias("df")).where("_a < _b").select("gram", "df")


def _verified(pairs: DataFrame, segments: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: overlaps are counted for each fragment and summed."""
    left = segments.select(F.col("class").alias("a"), "fragment", F.col("grams").alias("_x"))
    right = segments.select(F.col("class").alias("b"), "fragment", F.col("grams").alias("_y"))
    part = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", F.size(F.array_intersect("_x", "_y")).alias("_o"))
    total = part.groupBy("a", "b").agg(F.sum("_o").alias("_o"))
    of = lambda x: sizes.select(F.col("class").alias(x), F.col("n").alias(f"n_{x}"))
    return total.join(of("a"), "a").join(of("b"), "b").where(f"100 * _o >= {percent} * (n_a + n_b - _o)").select("a", "b")


def _rehashed(k: int):
    return lambda x: F.xxhash64(x["gram"], F.lit(k))


def _may_link(percent: int) -> str:
    """Filters that no linked pair fails. The sets' sizes; and n-grams that only one of them has: at least those that no other class has, and an odd number in each place of the signature where the parities differ."""
    differ = "alone_x + alone_y + " + " + ".join(f"bit_count(s{i}_x ^ s{i}_y)" for i in range(4))
    return f"100 * least(n_x, n_y) >= {percent} * greatest(n_x, n_y) and {differ} <= n_x + n_y - 2 * ceil({percent} * (n_x + n_y) / {100 + percent})"


def class_links(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key, n, class) of all documents, and (node, root): the components of linked classes."""
    spark = docs.sparkSession
    sets, sets_at = written_at(_sets(docs, words, percent, False), "prefixes")
    rows = written(sets.select("doc_id", "key", "n", "class"), "rows")
    one, one_at = written_at(sets.where("n > 0").groupBy("class").agg(F.min("n").alias("n"), F.first("grams").alias("grams"), F.min("doc_id").alias("doc_id")), "classes")
    grams = one.select("class", "n", F.explode("grams").alias("gram"))
    common = written(_common(grams.select("class", "gram")).select("gram"), "common_prefix_grams")
    left = grams.join(common, "gram").groupBy("class", "n").count().where(f"count >= greatest(1, ceil(n * {percent} / 1000))")
    left = written(left.select("class", "n"), "left")
    # the texts of the classes left are read again, for their whole sets
    ids = written(one.join(left.select("class"), "class", "left_semi").select("doc_id").distinct(), "ids")
    few = left.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES
    texts = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    nulls = ids.where("doc_id is null").limit(1).count()
    for done in (sets_at, one_at):  # prefixes take most of the room so far, and what follows reads whole sets
        remove(done)
    release_shuffles(spark)
    if nulls:  # classes of rows without an id
        texts = texts.unionByName(docs.where("doc_id is null"))
    whole = _sets(texts, words, percent, True).where("n > 0").join(F.broadcast(left.select("class")) if few else left.select("class"), "class", "left_semi")
    whole = written(whole.dropDuplicates(["class"]).select("class", "n", "grams"), "sets")
    grams = whole.select("class", "n", F.explode("grams").alias("gram"))
    common = written(_common(grams.select("class", "gram")), "common_grams")
    at = F.pmod(F.xxhash64("gram"), F.lit(256)).cast("int")
    word, bit = F.floor(at / 64), at % 64
    kept = grams.join(common, "gram").groupBy("class", "n").agg(
        F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("order"), F.avg("df").alias("typical"),
        *(F.coalesce(F.bit_xor(F.when(word == i, F.call_function("shiftleft", F.lit(1).cast("long"), bit))), F.lit(0).cast("long")).alias(f"s{i}") for i in range(4)),
    )
    kept = written(kept.where(f"100 * size(order) >= {percent} * n"), "kept")
    release_shuffles(spark)
    sizes = kept.select("class", "n")
    step = (1 << 64) // FRAGMENTS
    fragment = F.floor(F.col("g.gram") / F.lit(float(step)))
    segments = kept.select("class", F.explode("order").alias("g")).select("class", fragment.alias("fragment"), F.col("g.gram").alias("gram")).groupBy("class", "fragment").agg(F.collect_list("gram").alias("grams"))
    segments = written(segments, "segments")
    signed = ["class", "n", (F.col("n") - F.size("order")).alias("alone"), "s0", "s1", "s2", "s3"]
    of = lambda df, x: df.select(*(F.col(c).alias(f"{c}_{x}") for c in df.columns))
    joined = None
    for r in range(ROUNDS):
        # classes of a key have about one size; the next round's bounds of sizes lie between
        size = F.floor(F.log("n") / -math.log(percent / 100) + r / ROUNDS) if percent < 100 else F.col("n")
        keys = F.array(*(F.xxhash64(size, F.array_min(F.transform("order", _rehashed(k)))) for k in range(r * KEYS, (r + 1) * KEYS)))
        root = kept.withColumn("root", F.col("class")) if joined is None else kept.join(joined, F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class"))
        keyed = written(root.select(*signed, "typical", "root", keys.alias("keys")), "keyed")
        keyed = keyed.select("*", F.explode(F.sequence(F.lit(0), F.lit(HUBS - 1))).alias("hub")).withColumn("key", F.get("keys", F.col("hub") % KEYS)).drop("keys")
        # in the first round the first hubs of a key are its most typical classes, all others are any
        rank = F.when((F.col("hub") < KEYS) & F.lit(r == 0), F.col("typical")).otherwise(F.lit(0.0))
        columns = ["class", "n", "alone", "s0", "s1", "s2", "s3", "root"]
        hub = keyed.groupBy("hub", "key").agg(F.max(F.struct(rank, F.xxhash64("class", "hub", F.lit(r)), *columns)).alias("h"))
        hub = written(hub.select("hub", "key", *(F.col(f"h.{c}") for c in columns)), "hubs")
        pairs = of(keyed.drop("typical"), "x").join(of(hub, "y"), (F.col("key_x") == F.col("key_y")) & (F.col("hub_x") == F.col("hub_y")))
        pairs = pairs.where(f"root_x <> root_y and {_may_link(percent)}").select(F.least("class_x", "class_y").alias("a"), F.greatest("class_x", "class_y").alias("b"))
        links = written(_verified(pairs.distinct(), segments, sizes, percent), "hub_links")
        joined = components(links if joined is None else joined.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))
    reach = F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - F.col("alone")).cast("int")
    names = ["class", "n", "alone", "s0", "s1", "s2", "s3", "root"]
    rooted = kept.join(joined, F.col("class") == F.col("node"), "left").select(*signed, F.coalesce("root", "class").alias("root"), "order")
    prefix = rooted.select(*names, F.posexplode(F.slice("order", F.lit(1), reach)).alias("_p", "_g"))
    prefix = written(prefix.select(*names, F.col("_g.gram").alias("gram"), (F.col("_p") + F.col("alone")).alias("place")), "frequency_prefixes")
    apart = written(prefix.groupBy("gram").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a <> _b").select("gram"), "grams_apart")
    prefix = written(prefix.join(apart, "gram", "left_semi"), "open_prefixes")
    x, y = of(prefix, "x"), of(prefix, "y")
    open_ = x.join(y, F.col("gram_x") == F.col("gram_y")).where(
        f"class_x < class_y and root_x <> root_y and {_may_link(percent)} and (100 + {percent}) * least(n_x - place_x, n_y - place_y) >= {percent} * (n_x + n_y)"
    )
    rest = written(_verified(open_.select(F.col("class_x").alias("a"), F.col("class_y").alias("b")).distinct(), segments, sizes, percent), "prefix_links")
    return rows, components(joined.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(rest))


def _linked_rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Per row: doc_id, key, n, least: the least (id is null, doc_id, key) that links reach, null for rows without n-grams."""
    rows, joined = class_links(docs, words, percent)
    least = rows.where("n > 0").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("_least"))
    rooted = least.join(joined, F.col("class") == F.col("node"), "left").select("class", "_least", F.coalesce("root", "class").alias("root"))
    rooted = written(rooted, "rooted")
    of_root = written(rooted.groupBy("root").agg(F.min("_least").alias("least")), "of_root")
    of_class = written(rooted.join(of_root, "root").select("class", "least"), "of_class")
    full = rows.where("n > 0").join(of_class, "class", "left").select("doc_id", "key", "n", "least")
    return full.unionByName(rows.where("n = 0").select("doc_id", "key", "n"), allowMissingColumns=True)


def link_documents(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id: the least doc_id that links reach (100 * overlap >= percent * union); null if all reached are null."""
    rows = _linked_rows(docs, words, percent)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def without_linked(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` but those that link to one of a lower (doc_id, key); null ids come last. Rows are told apart by their key (id and text), so
    ids may be null or repeat; of rows that repeat an id and a text with n-grams one stays, and rows without n-grams all stay."""
    links = written(_linked_rows(docs, words, percent).where("n > 0").select("key", F.col("least.key").alias("least")), "row_links")
    key, out = fresh(docs, "_key"), fresh(docs, "_gone")
    gone = links.where("key <> least").select(F.col("key").alias(out)).distinct()
    few = gone.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES
    kept = docs.withColumn(key, row_key()).join(F.broadcast(gone) if few else gone, F.col(key) == F.col(out), "left_anti")
    again = links.where("key = least").groupBy("key").count().where("count > 1").select(F.col("key").alias(key))
    if again.limit(1).count():
        again = written(again, "repeated_rows")
        kept = kept.join(again, key, "left_anti").unionByName(kept.join(again, key, "left_semi").dropDuplicates([key])).select(*docs.columns, key)
    return kept.drop(key)
