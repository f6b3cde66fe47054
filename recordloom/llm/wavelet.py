"""Operator 10: token ids in wavelet-matrix shards, with access, counting and occurrence lookup from one compressed file.

A shard file holds the ids of consecutive documents as bit-planes from the highest bit to the lowest. Each plane has the
bits of all ids in the order that stable sorting by the higher bits, zeros first, gives. A plane is cut into chunks of CHUNK bits, each compressed on its own; the index has each chunk's place in the
file and the number of ones before it (rank), and the number of zeros of the plane. That answers access, rank and select with one or two chunks a plane, each of which is a range read of the file.

Documents are dealt by ranges of doc_id (ties by a hash of the text, nulls first), so a task holds consecutive ones; it closes a
shard when SHARD_IDS are reached, so memory doesn't follow the partition. Names of files are new for each attempt of a task, and only the manifest
of finished tasks says which count. Starts are prefix sums over the manifest: of partitions, then of a partition's shards.

Results: null text counts as empty (its row has only the end id). Repeated rows and ids follow each other; ids may be of any type that can be sorted. A very long text is cut into pieces in parts and may make its shard longer than SHARD_IDS.
Empty tables write no file. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .files import open_input, read_bytes, write_bytes
from .pretoken import pieces
from .shared import shared_folder, shuffle_partitions, text_or_empty, written

MAGIC = b"RLWM0002"
#: Bits of a chunk.
CHUNK = 1 << 16
#: Ids in a shard, unless a single document has more.
SHARD_IDS = 2_000_000
#: Distinct pieces whose ids a worker keeps; characters of texts encoded at a time.
KEPT_PIECES, STEP_CHARS = 600_000, 4_000_000


def shard_parts(ids: np.ndarray, bits: int, doc_ids: pa.Array, lengths: np.ndarray):
    """The file's parts: magic, sizes of head and documents, head (JSON), documents (Arrow: doc_id, n), index (places and ones before each chunk), chunks."""
    n, level = len(ids), ids.astype(np.uint16 if bits <= 16 else np.uint32)
    zeros, chunks, ones = [], [], []
    codec = pa.Codec("zstd", compression_level=1)
    for k in range(bits - 1, -1, -1):
        one = (level & level.dtype.type(1 << k)).astype(bool)
        packed = np.packbits(one, bitorder="little")
        parts = [packed[i : i + CHUNK // 8] for i in range(0, len(packed), CHUNK // 8)]
        ones.append(np.cumsum([0, *(int(np.bitwise_count(x).sum()) for x in parts)]))
        chunks += [codec.compress(x.tobytes(), asbytes=True) for x in parts]
        low, high = level[~one], level[one]
        zeros.append(len(low))
        level = np.concatenate([low, high])
    docs = pa.BufferOutputStream()
    table = pa.table({"doc_id": doc_ids, "n": pa.array(lengths, pa.int64())})
    with pa.ipc.new_stream(docs, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    docs = docs.getvalue().to_pybytes()
    head = json.dumps({"n": n, "bits": bits, "zeros": zeros}).encode()
    yield MAGIC + struct.pack("<QQ", len(head), len(docs)) + head + docs
    yield np.cumsum([0, *map(len, chunks)]).astype("<u8").tobytes() + np.concatenate(ones or [np.zeros(0)]).astype("<u8").tobytes()
    yield from chunks


class Shard:
    """One file. ``read`` (from, size) gives bytes of it: the head and the index are read at once, chunks when they are asked for."""

    def __init__(self, read: Callable[[int, int], bytes], kept_chunks: int = 64):
        self._read = read
        first = read(0, 24)
        if first[:8] != MAGIC:
            raise ValueError("not a shard")
        head_size, docs_size = struct.unpack_from("<QQ", first, 8)
        head = json.loads(read(24, head_size))
        self.n, self.bits, self.zeros = head["n"], head["bits"], head["zeros"]
        self.chunks = -(-self.n // CHUNK)
        self._docs, at = (24 + head_size, docs_size), 24 + head_size + docs_size
        places = self.bits * self.chunks + 1
        index = np.frombuffer(read(at, 8 * (places + self.bits * (self.chunks + 1))), "<u8").astype(np.int64)
        self.places, self.ones = index[:places] + at + 8 * len(index), index[places:].reshape(self.bits, self.chunks + 1)
        self._chunk = lru_cache(kept_chunks)(self._load)

    @classmethod
    def open(cls, uri: str) -> Shard:
        file = open_input(uri)

        def read(at: int, size: int) -> bytes:
            file.seek(at)
            return file.read(size)

        return cls(read)

    @classmethod
    def of(cls, data: bytes) -> Shard:
        return cls(lambda at, size: data[at : at + size])

    def documents(self) -> pa.Table:
        """doc_id and n (ids) of each document, in order."""
        return pa.ipc.open_stream(self._read(*self._docs)).read_all()

    def _load(self, level: int, chunk: int) -> np.ndarray:
        k = level * self.chunks + chunk
        size = -(-min(CHUNK, self.n - chunk * CHUNK) // 8)
        return np.frombuffer(pa.Codec("zstd").decompress(self._read(int(self.places[k]), int(self.places[k + 1] - self.places[k])), size, asbytes=True), np.uint8)

    def all(self) -> np.ndarray:
        """Every id in order: the planes are undone from the lowest bit up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            plane = np.concatenate([self._load(level, c) for c in range(self.chunks)] or [np.zeros(0, np.uint8)])
            one = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            up = np.empty(self.n, kind)
            up[~one] = out[: self.zeros[level]]
            up[one] = out[self.zeros[level] :] | kind(1 << (self.bits - 1 - level))
            out = up
        return out

    def _rank(self, level: int, at: int) -> int:
        """Ones of a plane before a place."""
        chunk, inside = divmod(at, CHUNK)
        if not inside:
            return int(self.ones[level][chunk])
        part = self._chunk(level, chunk)[: -(-inside // 8)]
        return int(self.ones[level][chunk]) + int(np.bitwise_count(part).sum()) - (int(part[-1] >> (inside % 8)).bit_count() if inside % 8 else 0)

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level in range(self.bits):
            inside = at % CHUNK
            bit = int(self._chunk(level, at // CHUNK)[inside // 8] >> (inside % 8)) & 1
            ones = self._rank(level, at)
            value = value << 1 | bit
            at = self.zeros[level] + ones if bit else at - ones
        return value

    def _down(self, value: int, at: int):
        """The place that follows ``at`` through the planes by the bits of an id."""
        for level in range(self.bits):
            ones = self._rank(level, at)
            at = self.zeros[level] + ones if value >> (self.bits - 1 - level) & 1 else at - ones
        return at

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """How often the id occurs from start to before end."""
        start, end = max(0, start), self.n if end is None else min(end, self.n)
        if value < 0 or value >> self.bits or start >= end:
            return 0
        return self._down(value, end) - self._down(value, start)

    def select(self, value: int, k: int) -> int:
        """The place of the k-th occurrence, from 0; -1 if there are fewer."""
        if k < 0 or k >= self.count(value):
            return -1
        at = self._down(value, 0) + k
        for level in range(self.bits - 1, -1, -1):
            one = value >> (self.bits - 1 - level) & 1
            at = self._select(level, one, at - self.zeros[level] if one else at)
        return at

    def _select(self, level: int, bit: int, k: int) -> int:
        before = self.ones[level] if bit else np.minimum(np.arange(self.chunks + 1) * CHUNK, self.n) - self.ones[level]
        chunk = int(np.searchsorted(before, k, side="right")) - 1
        part = np.unpackbits(self._chunk(level, chunk), count=min(CHUNK, self.n - chunk * CHUNK), bitorder="little")
        return chunk * CHUNK + int(np.flatnonzero(part == bit)[k - int(before[chunk])])


def _byte_letters() -> dict[int, str]:
    """The letters of byte-level vocabularies: printable bytes of Latin-1 stand for themselves, the others for U+0100 and up."""
    own = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in own)}


class Encoder:
    """The tokenizers library, asked once for each distinct piece; texts that hold an added token go to it whole. Of a byte-level tokenizer the library's model is asked, which comes after its cutting into pieces."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.pattern = Tokenizer.from_file(path), pattern
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bits = max(self.tokenizer.get_vocab_size(with_added_tokens=True) - 1, 2).bit_length()
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        cutter = parts["pre_tokenizer"] or {}
        self.by_model = parts["normalizer"] is None and cutter.get("type") == "ByteLevel" and not cutter["add_prefix_space"]
        self._letters = _byte_letters()
        self._kept: dict[str, bytes] = {}

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ask_pieces(self, new: list[str]) -> list[bytes]:
        if not self.by_model:
            return self._ask(new)
        tokenize, letters = self.tokenizer.model.tokenize, self._letters
        return [struct.pack(f"<{len(t)}I", *(x.id for x in t)) for t in (tokenize(p.encode().decode("latin-1").translate(letters)) for p in new)]

    def _part(self, texts: list[str]) -> list[np.ndarray]:
        cut = [[] if any(a in t for a in self.added) else pieces(t, self.pattern) for t in texts]
        coded = pa.array(list(chain.from_iterable(cut)), pa.string()).dictionary_encode()
        names, kept = coded.dictionary.to_pylist(), self._kept
        if len(kept) > KEPT_PIECES:
            kept.clear()
        new = [p for p in names if p not in kept]
        kept.update(zip(new, self._ask_pieces(new)))
        found = [kept[p] for p in names]
        table, sizes = np.frombuffer(b"".join(found), np.uint32), np.fromiter((len(x) // 4 for x in found), np.int64, len(found))
        at = coded.indices.to_numpy()
        lengths, starts = sizes[at], (np.cumsum(sizes) - sizes)[at]
        ends = np.cumsum(lengths)
        ids = table[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)]
        ends = np.concatenate([[0], ends])[np.cumsum([len(c) for c in cut])]
        out = np.split(ids, ends[:-1])
        return [np.frombuffer(self._ask([t])[0], np.uint32) if t and not c else x for t, c, x in zip(texts, cut, out)]

    def batch(self, texts: list[str]):
        """The ids of each text."""
        part, held = [], 0
        for t in texts:
            part.append(t)
            held += len(t)
            if held >= STEP_CHARS:
                yield from self._part(part)
                part, held = [], 0
        if part:
            yield from self._part(part)


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def write_shards(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int = 2, folder: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the shards and return their manifest: part, seq, path, n_docs, n_ids, start."""
    folder = folder or f"{shared_folder(docs.sparkSession)}/shards"
    end = np.asarray([end_id], np.uint32)

    def run(batches):
        from pyspark import TaskContext

        own, part = encoder(tokenizer_path, pattern), TaskContext.get().partitionId()
        held, doc_ids, lengths, total, seq, kind = [], [], [], 0, 0, None

        def closed():
            path = f"{folder}/{part:06d}-{seq:06d}-{uuid.uuid4().hex}.wm"
            write_bytes(path, shard_parts(np.concatenate(held), max(own.bits, end_id.bit_length()), pa.array(doc_ids, kind), lengths))
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "path": [path], "n_docs": [len(lengths)], "n_ids": [total]}, pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        for b in batches:
            kind = b.column(0).type
            for doc_id, ids in zip(b.column(0).to_pylist(), own.batch(b.column(1).to_pylist())):
                held += [ids, end]
                doc_ids.append(doc_id)
                lengths.append(len(ids) + 1)
                total += lengths[-1]
                if total >= shard_ids:
                    yield closed()
                    held, doc_ids, lengths, total, seq = [], [], [], 0, seq + 1
        if lengths:
            yield closed()

    text = text_or_empty()
    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie")]
    src = docs.select("doc_id", text.alias("_text"), F.xxhash64(text).alias("_tie"))
    n = shuffle_partitions(docs.sparkSession)
    dealt = src.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "_text")
    manifest = written(dealt.mapInArrow(run, "part int, seq int, path string, n_docs long, n_ids long"), "manifest")
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("_all"))
    before = parts.select("part", F.coalesce(F.sum("_all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.withColumn("_inside", inside).join(before, "part").select("part", "seq", "path", "n_docs", "n_ids", (F.col("_before") + F.col("_inside")).alias("start"))


def read_documents(manifest: DataFrame, doc_id_type) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32."""

    def run(batches):
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                shard = Shard.of(read_bytes(path))
                ids, docs = shard.all().astype("<u4"), shard.documents().combine_chunks()
                lengths = docs["n"].to_numpy()
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends, lengths)]
                yield pa.RecordBatch.from_arrays([docs["doc_id"].chunk(0).cast(id_type), pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    id_type = to_arrow_type(doc_id_type)
    n = shuffle_partitions(manifest.sparkSession)
    return manifest.select("path", "start").repartition(n).mapInArrow(run, f"doc_id {doc_id_type.simpleString()}, start long, n_tokens long, ids_crc32 long")


def digests(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int = 2) -> DataFrame:
    """Write the documents' ids to shards and read them back, per document."""
    return read_documents(write_shards(docs, tokenizer_path, pattern, end_id), docs.schema["doc_id"].dataType)
