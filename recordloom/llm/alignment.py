"""Operator 12: alignment of two tokenizers' tokens by lockstep vectorised merging.

A step of the merge looks at one A token and one B token that share bytes: they are linked; the one that ends first is passed, and where both end the text is cut. One NumPy state vector holds the two
pointers of all documents of a batch, so a step is a few operations on arrays whatever the number of documents; documents that are done are compacted away. A document of more than LANE tokens of A goes on in
further lanes, each of which finds its first B token by binary search, so that a long document doesn't make the others wait.

How often a pair of ids is linked in the corpus: documents stand in blocks of about BLOCK_LINKS links. A block says each of its distinct pairs once, with its own count; Spark sums them by pair, takes the highest
of each B id, and joins the sums back to the blocks' pairs. A document keeps its links as places in its block's sorted list of pairs, so that the sums meet the documents by block (never bigger than a block).

Results: null and empty texts, and texts whose joined tokens aren't the text with a space before it, have no tokens. Repeated rows each have a row and count each. Ids may be null or of any type. A very long text
is in memory whole, and its block is as long. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretoken import pieces
from .shared import release_shuffles, text_or_empty, without_collector, written
from .wavelet import Encoder, _byte_letters

#: A tokens of a lane; links of a block, unless one document has more; distinct pieces whose ids a worker keeps; characters encoded at a time.
LANE, BLOCK_LINKS, KEPT_PIECES, STEP_CHARS = 512, 8_000_000, 400_000, 3_000_000
_WORD = re.compile(" +[^ ]*")


class Pieces:
    """Ids of texts whose pieces are encoded apart: each distinct piece is asked for once while it is kept."""

    def __init__(self, cut, ask):
        self._cut, self._ask, self._kept = cut, ask, {}

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's end."""
        cut = [self._cut(t) for t in texts]
        coded = pa.array(list(chain.from_iterable(cut)), pa.string()).dictionary_encode()
        names, kept = coded.dictionary.to_pylist(), self._kept
        if len(kept) > KEPT_PIECES:
            kept.clear()
        new = [p for p in names if p not in kept]
        kept.update(zip(new, self._ask(new)))
        found = [kept[p] for p in names]
        table, sizes = np.frombuffer(b"".join(found), np.uint32), np.fromiter((len(x) // 4 for x in found), np.int64, len(found))
        at = coded.indices.to_numpy()
        lengths, starts = sizes[at], (np.cumsum(sizes) - sizes)[at]
        ends = np.cumsum(lengths)
        ids = table[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)]
        return ids, np.concatenate([[0], ends])[np.cumsum([len(c) for c in cut])]


class ByteLevel:
    """Tokenizer A: a byte-level BPE of the tokenizers library. Strings of special tokens are plain text."""

    def __init__(self, path: str, pattern: str):
        own = Encoder(path, pattern)
        own.tokenizer.encode_special_tokens = True
        self.encode = Pieces(lambda t: pieces(t, pattern) if own.by_model else [t], own._ask_pieces)
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        letters = {letter: byte for byte, letter in _byte_letters().items()}
        self.tokens = [b""] * (1 + max(vocabulary.values()))
        for word, k in vocabulary.items():
            self.tokens[k] = bytes(map(letters.get, word)) if all(c in letters for c in word) else word.encode()


class PieceModel:
    """Tokenizer B: a BPE of the sentencepiece library. Pieces hold U+2581 (a space) at their start only, or nothing else, so no merge crosses the start of a word and words are encoded apart; a model of another kind gets whole texts."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self._space = np.asarray([m.piece_to_id("▁")], np.uint32).tobytes()
        apart = not any(re.search("[^▁]▁", x) for x in names) and "".join(m.id_to_piece(i) for i in m.encode(" a  b ")) == "▁▁a▁▁b▁"
        self.encode = Pieces(_WORD.findall if apart else lambda t: [t], self._ask)
        byte = re.compile("<0x([0-9A-F]{2})>")
        self.tokens = [bytes.fromhex(x[1]) if (x := byte.fullmatch(p)) else p.replace("▁", " ").encode() for p in names]

    def _ask(self, new: list[str]) -> list[bytes]:
        """Of pieces that begin with a space, which the library adds itself."""
        return [self._space if p == " " else np.asarray(x, np.uint32).tobytes() for p, x in zip(new, self._model.encode([p[1:] for p in new], num_threads=1))]


@lru_cache(2)
def _tokenizers(path_a: str, pattern: str, path_b: str):
    a, b = ByteLevel(path_a, pattern), PieceModel(path_b)
    size = [np.fromiter(map(len, x.tokens), np.int64, len(x.tokens)) for x in (a, b)]
    kinds = [pa.array(x.tokens, pa.binary()) for x in (a, b)]
    # decimal ids with what may follow: a token of the group, the other side, the next group
    shown = pa.array([f"{k}{c}" for k in range(max(len(a.tokens), len(b.tokens))) for c in ",|;"], pa.large_string())
    return a, b, size, kinds, shown


def merged(end_a: np.ndarray, end_b: np.ndarray, docs: np.ndarray, lane: int = LANE):
    """The merge of a batch. end_a, end_b: bytes of the batch up to the end of each token; docs: A tokens up to the end of each document, where both sides end. Gives the places of linked tokens of A and of B, and which tokens of each side end at a cut."""
    starts = np.concatenate([[0], docs[:-1]])
    lanes = -(-(docs - starts) // lane)
    first = np.repeat(starts, lanes) + lane * (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    last = np.minimum(first + lane, np.repeat(docs, lanes))
    i, j = first, np.searchsorted(end_b, np.concatenate([[0], end_a])[first], side="right")
    cut_a, cut_b = np.zeros(len(end_a), bool), np.zeros(len(end_b), bool)
    links_a, links_b = [], []
    while len(i):
        links_a.append(i)
        links_b.append(j)
        a, b = end_a[i], end_b[j]
        both = a == b
        cut_a[i[both]] = True
        cut_b[j[both]] = True
        i, j = i + (a <= b), j + (b <= a)
        if (i == last).any():
            on = i < last
            i, j, last = i[on], j[on], last[on]
    none = np.zeros(0, np.int64)
    return np.concatenate(links_a or [none]), np.concatenate(links_b or [none]), cut_a, cut_b


def _shown(ids_a, ids_b, cut_a, cut_b, shown):
    """All tokens as text, group by group, first the A then the B tokens of each, and where each token's text ends."""
    ends_a, ends_b = np.flatnonzero(cut_a) + 1, np.flatnonzero(cut_b) + 1
    out = np.empty(len(ids_a) + len(ids_b), np.int64)
    out[np.arange(len(ids_a)) + np.concatenate([[0], ends_b])[np.cumsum(cut_a) - cut_a]] = ids_a.astype(np.int64) * 3 + cut_a
    out[np.arange(len(ids_b)) + ends_a[np.cumsum(cut_b) - cut_b]] = ids_b.astype(np.int64) * 3 + 2 * cut_b
    text = shown.take(pa.array(out))
    _, offsets, data = text.buffers()
    return memoryview(data) if data else memoryview(b""), np.frombuffer(offsets, np.int64)[: len(out) + 1]


class Batch:
    """Texts encoded twice: ids and cumulative numbers of tokens for each document, without those whose tokens don't give the text back."""

    def __init__(self, texts: list[str], tools):
        a, b, size, kinds, self.shown = tools
        spaced = [" " + t if t else "" for t in texts]
        data = [t.encode() for t in spaced]
        whole = np.frombuffer(b"".join(data), np.uint8)
        ends = np.cumsum([len(d) for d in data])
        ids, docs = zip(*(x.encode(spaced) for x in (a, b)))
        said = [np.frombuffer(k.take(pa.array(i)).buffers()[2] or b"", np.uint8) for k, i in zip(kinds, ids)]
        at = [np.concatenate([[0], np.cumsum(s[i])])[d] for s, i, d in zip(size, ids, docs)]
        if not all(np.array_equal(x, ends) and np.array_equal(s[: len(whole)], whole) for x, s in zip(at, said)):
            ok = np.array([all(s[(x[k - 1] if k else 0) : x[k]].tobytes() == d for x, s in zip(at, said)) for k, d in enumerate(data)], bool)
            lengths = [np.diff(d, prepend=0) for d in docs]
            ids = [i[np.repeat(ok, n)] for i, n in zip(ids, lengths)]
            docs = [np.cumsum(n * ok) for n in lengths]
        self.a, self.b = ids
        self.docs_a, self.docs_b = docs
        ends_a, ends_b = (np.cumsum(s[i]) for s, i in zip(size, ids))
        self.link_a, self.link_b, self.cut_a, self.cut_b = merged(ends_a, ends_b, self.docs_a)
        self.doc_of = np.repeat(np.arange(len(texts)), np.diff(self.docs_a, prepend=0))

    def groups(self) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(self.cut_a)])[self.docs_a], prepend=0)

    def hashes(self) -> list[str]:
        text, offsets = _shown(self.a, self.b, self.cut_a, self.cut_b, self.shown)
        ends = offsets[self.docs_a + self.docs_b]
        return [hashlib.sha256(text[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(np.concatenate([[0], ends[:-1]]), ends)]

    def pairs(self) -> np.ndarray:
        """A's id over B's, of each link."""
        return self.a[self.link_a].astype(np.int64) << 32 | self.b[self.link_b].astype(np.int64)


def _steps(batches, chars: int):
    """Ids and texts, cut into lists of about so many characters."""
    for b in batches:
        part, held, first = [], 0, 0
        for k, t in enumerate(b.column(1).to_pylist()):
            part.append(t)
            held += len(t)
            if held >= chars or k + 1 == b.num_rows:
                yield b.column(0).slice(first, len(part)), part
                part, held, first = [], 0, k + 1


def alignments(docs: DataFrame, path_a: str, pattern: str, path_b: str) -> DataFrame:
    """Per document: doc_id, a and b (ids), links and cuts (places of an A and a B token that share bytes, and that end together)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def listed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, pa.int32()))

    def run(batches):
        tools = _tokenizers(path_a, pattern, path_b)
        for ids, texts in _steps(batches, STEP_CHARS):
            x = Batch(texts, tools)
            order = np.lexsort((x.link_b, x.link_a))
            first_a, first_b = np.concatenate([[0], x.docs_a]), np.concatenate([[0], x.docs_b])
            link_doc, cuts = x.doc_of[x.link_a[order]], np.flatnonzero(x.cut_a)
            cut_doc = x.doc_of[cuts]
            number = lambda doc: np.cumsum(np.bincount(doc, minlength=len(texts)))
            columns = [
                listed(x.a, x.docs_a), listed(x.b, x.docs_b), listed(x.link_a[order] - first_a[link_doc], number(link_doc)), listed(x.link_b[order] - first_b[link_doc], number(link_doc)),
                listed(cuts - first_a[cut_doc], number(cut_doc)), listed(np.flatnonzero(x.cut_b) - first_b[cut_doc], number(cut_doc)),
            ]
            yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "a", "b", "la", "lb", "ca", "cb"])

    whole = docs.select("doc_id", text_or_empty().alias("_text")).mapInArrow(run, f"doc_id {kind}, a array<int>, b array<int>, la array<int>, lb array<int>, ca array<int>, cb array<int>")
    zipped = lambda x, y: F.transform(F.arrays_zip(x, y), lambda z: F.struct(z[x].alias("a"), z[y].alias("b")))
    return whole.select("doc_id", "a", "b", zipped("la", "lb").alias("links"), zipped("ca", "cb").alias("cuts"))


_DOC = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, times binary"


def _aligned(docs: DataFrame, path_a: str, pattern: str, path_b: str, block_links: int) -> DataFrame:
    """Rows of documents (block, doc_id, counts, the distinct pairs as places in the block's list and how often each), and one row for each block: pairs (sorted) and times."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        tools, part, seq = _tokenizers(path_a, pattern, path_b), TaskContext.get().partitionId(), 0
        codec = zstandard.ZstdCompressor(level=1)
        held, links = [], 0

        def closed():
            # the distinct pairs of each step's documents, then of the block
            block = np.unique(np.concatenate([own for _, _, own, _, _, _ in held]))
            times = np.zeros(len(block), np.int64)
            for ids, columns, own, doc, place, n in held:
                at = np.searchsorted(block, own)
                np.add.at(times, at, np.bincount(place, n, len(own)).astype(np.int64))
                ends = np.searchsorted(doc, np.arange(len(ids) + 1))
                spots = at[place]
                packed = lambda x: codec.compress(x.astype("<u4").tobytes())
                places = [packed(np.diff(spots[s:e], prepend=0)) for s, e in zip(ends, ends[1:])]
                counts = [packed(n[s:e]) for s, e in zip(ends, ends[1:])]
                m = len(ids)
                name = pa.array([f"{part}-{seq}"] * m, pa.string())
                yield pa.RecordBatch.from_arrays([name, ids, *columns, pa.array(places, pa.binary()), pa.array(counts, pa.binary()), pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.list_(pa.int64()))], names)
            empty = [pa.nulls(1, t) for t in (held[0][0].type, *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([f"{part}-{seq}"], pa.string()), *empty, pa.array([block], pa.list_(pa.int64())), pa.array([times], pa.list_(pa.int64()))], names)

        names = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times", "block_pairs", "block_times"]
        for ids, texts in _steps(without_collector(batches), STEP_CHARS):
            x = Batch(texts, tools)
            own, code = np.unique(x.pairs(), return_inverse=True)
            width = max(1, len(own))
            key, n = np.unique(x.doc_of[x.link_a] * width + code, return_counts=True)
            per_doc = np.bincount(x.doc_of[x.link_a], minlength=len(texts))
            columns = [pa.array(v, pa.int64()) for v in (np.diff(x.docs_a, prepend=0), np.diff(x.docs_b, prepend=0), x.groups(), per_doc)]
            held.append((ids, [*columns, pa.array(x.hashes(), pa.string())], own, key // width, key % width, n))
            links += len(code)
            if links >= block_links:
                yield from closed()
                held, links, seq = [], 0, seq + 1
        if held:
            yield from closed()

    src = docs.select("doc_id", text_or_empty().alias("_text"))
    return src.mapInArrow(run, f"block string, doc_id {kind}, {_DOC}, block_pairs array<long>, block_times array<long>")


def digests(docs: DataFrame, path_a: str, pattern: str, path_b: str, block_links: int = BLOCK_LINKS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    own = written(_aligned(docs, path_a, pattern, path_b, block_links), "aligned", compression="zstd")
    said = own.where("block_pairs is not null").select("block", F.explode(F.arrays_zip("block_pairs", "block_times")).alias("_p")).select("block", F.col("_p.block_pairs").alias("pair"), F.col("_p.block_times").alias("n"))
    counts = written(said.groupBy("pair").agg(F.sum("n").alias("count")), "pairs")
    # a row for each id of B
    highest = counts.groupBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("_b")).agg(F.max("count").alias("_most"))
    judged = counts.join(highest, F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)) == F.col("_b")).select("pair", "count", (F.col("count") == F.col("_most")).alias("best"))
    answers = said.select(F.col("block").alias("_to"), "pair").join(judged, "pair")
    rows = own.where("block_pairs is null").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times")
    release_shuffles(spark)

    def run(mine: pa.Table, told: pa.Table) -> pa.Table:
        order = pc.sort_indices(told["pair"])
        count, best = (np.asarray(told[c].take(order).to_numpy(), kind) for c, kind in (("count", np.int64), ("best", bool)))
        codec, sums, bests = zstandard.ZstdDecompressor(), [], []
        distinct = lambda data: np.frombuffer(codec.decompress(data), "<u4").astype(np.int64)
        for places, times in zip(mine["places"].to_pylist(), mine["times"].to_pylist()):
            at, n = np.cumsum(distinct(places)), distinct(times)
            sums.append(int((count[at] * n).sum()))
            bests.append(int(n[best[at]].sum()))
        return mine.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"]).append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64())).append_column("groups_sha256", mine["groups_sha256"])

    out = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.groupBy("block").cogroup(answers.groupBy("_to")).applyInArrow(run, out)
