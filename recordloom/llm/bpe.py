"""Operator 8: byte-level BPE encoding and decoding by a lazily determinised finite-state transducer.

Encoding. A sequence of tokens is the BPE encoding of its bytes if and only if each two neighbours are: encoding the
bytes of the pair gives back the pair. So the encoding of a prefix is that of a shorter prefix and one more token, and
the last token of each prefix is found from the last tokens of the shorter ones. The transducer reads bytes. Its state is
the last token it has emitted and the bytes read since. After a byte, the prefixes that some longer token may still
start from are its open positions; the tokens before the last boundary that all of them have in common cannot change
any more and are emitted. As tokens have a greatest length, that lookahead is bounded. States and arcs are made when
a text first needs them and kept up to a bound; beyond it, bytes without an arc are stepped through in the same way without keeping what they lead to. A match that is a token is that token, whatever merges lead to it,
as in the libraries. Ids of matches seen lately are kept.

Decoding. An incremental UTF-8 state machine: its state is the at most three bytes of an unfinished character. It is put together with the tokens as inputs, an arc for each state and token that has been met: the characters
given out, and the next state. Faulty bytes become U+FFFD, one for each part that could have begun a character.

Results: null text counts as empty: no tokens, and the hashes of nothing. Repeated rows give a row each. Other columns of the input
are not read. Very long texts are streamed through the transducer match by match.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .pretoken import pieces
from .shared import release_memory, text_or_empty, without_collector

#: Arcs of the transducer, pieces, and arcs of the decoder that a worker keeps.
KEPT_ARCS, KEPT_PIECES, KEPT_DECODED = 250_000, 300_000, 200_000


class Transducer:
    def __init__(self, ranks: dict[bytes, int], kept_arcs: int = KEPT_ARCS):
        self.ranks = ranks
        self.token = {v: k for k, v in ranks.items()}
        self.open = {k[:n] for k in ranks for n in range(1, len(k))}
        self.kept_arcs = kept_arcs
        self.bytes_by_arcs = self.bytes_beyond = 0  # counters
        self._pairs: dict[tuple[int, int], bool] = {}
        self.arcs = 0
        self._states: dict[tuple[int, bytes], tuple] = {}
        self.root = self._state(-1, b"", (), ())

    def _state(self, before: int, pending: bytes, ends: tuple[int, ...], opens: tuple[int, ...]) -> tuple:
        """A state: its arcs, the last emitted token, the pending bytes, ends[i] the last token of the first i + 1 of
        them, and the boundaries that a longer token may still start from."""
        key = (before, pending)
        if key not in self._states:
            self._states[key] = ({}, before, pending, ends, opens)
        return self._states[key]

    def merged(self, data: bytes) -> list[int]:
        """The definition: merge the neighbours of least rank until none is left. Used on pairs of tokens only."""
        parts, none, get = [data[i : i + 1] for i in range(len(data))], 1 << 60, self.ranks.get
        rank = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while rank and (least := min(rank)) != none:
            i = rank.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del rank[i]
            if i:
                rank[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(rank):
                rank[i] = get(parts[i] + parts[i + 1], none)
        return [self.ranks[p] for p in parts]

    def _stable(self, a: int, b: int) -> bool:
        if a < 0:
            return True
        if (a, b) not in self._pairs:
            if len(self._pairs) > 8 * self.kept_arcs:
                self._pairs.clear()
            self._pairs[a, b] = self.merged(self.token[a] + self.token[b]) == [a, b]
        return self._pairs[a, b]

    def _tokens(self, ends, n: int) -> list[int]:
        """The encoding of the first n pending bytes."""
        out = []
        while n:
            out.append(ends[n - 1])
            n -= len(self.token[ends[n - 1]])
        return out[::-1]

    def _arc(self, state: tuple, byte: int) -> tuple[tuple[int, ...], tuple]:
        arcs, before, pending, ends, opens = state
        data, n = pending + bytes((byte,)), len(pending) + 1
        opens = (*opens, n - 1)
        for s in opens:  # a token that ends here starts at an open boundary
            t = self.ranks.get(data[s:])
            if t is not None and self._stable(ends[s - 1] if s else before, t):
                break
        else:
            raise ValueError("the ranks lack a single byte")
        ends = (*ends, t)
        opens = tuple(s for s in opens if data[s:] in self.open)
        live = {*opens, n}
        while len(live) > 1:  # the last boundary that all open ones have in common
            last = max(live)
            live.remove(last)
            live.add(last - len(self.token[ends[last - 1]]))
        cut = live.pop()
        out = self._tokens(ends, cut)
        arc = (tuple(out), self._state(out[-1] if out else before, data[cut:], ends[cut:], tuple(s - cut for s in opens)))
        arcs[byte] = arc
        self.arcs += 1
        return arc

    def _beyond(self, state: tuple, data: bytes, at: int) -> list[int]:
        """The encoding from ``state`` on by the steps that make arcs, without keeping them."""
        _, before, pending, ends, opens = state
        data, n, ends, opens = pending + data[at:], len(pending), list(ends), list(opens)
        get, longer, known = self.ranks.get, self.open, self._pairs
        for n in range(n + 1, len(data) + 1):
            opens.append(n - 1)
            for s in opens:
                if (t := get(data[s:n])) is not None:
                    a = ends[s - 1] if s else before
                    ok = known.get((a, t))
                    if ok or ok is None and self._stable(a, t):
                        break
            ends.append(t)
            opens = [s for s in opens if data[s:n] in longer]
        return self._tokens(ends, n)

    def encode(self, data: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        out: list[int] = []
        state = self.root
        for at, byte in enumerate(data):
            arc = state[0].get(byte)
            if arc is None:
                if self.arcs >= self.kept_arcs:
                    self.bytes_by_arcs += at
                    self.bytes_beyond += len(data) - at
                    return out + self._beyond(state, data, at)
                arc = self._arc(state, byte)
            emitted, state = arc
            if emitted:
                out += emitted
        self.bytes_by_arcs += len(data)
        return out + self._tokens(state[3], len(state[3]))


class Utf8Machine:
    """UTF-8 as a state machine over bytes: a state is the bytes of an unfinished character (b"" at first)."""

    @staticmethod
    def step(state: bytes, byte: int) -> tuple[str, bytes]:
        """Characters given out and the next state."""
        if not state:
            if byte < 0x80:
                return chr(byte), b""
            return ("", bytes((byte,))) if 0xC2 <= byte <= 0xF4 else ("\ufffd", b"")
        lead = state[0]
        # the second byte of some first ones has a narrower range: no overlong forms, surrogates or places beyond U+10FFFF
        low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF)) if len(state) == 1 else (0x80, 0xBF)
        if not low <= byte <= high:
            out, state = Utf8Machine.step(b"", byte)
            return "\ufffd" + out, state
        size = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        if len(state) + 1 < size:
            return "", state + bytes((byte,))
        code = lead & (0x7F >> size)
        for b in (*state[1:], byte):
            code = code << 6 | b & 0x3F
        return chr(code), b""

    @staticmethod
    def run(state: bytes, data: bytes) -> tuple[str, bytes]:
        out = []
        for byte in data:
            given, state = Utf8Machine.step(state, byte)
            out.append(given)
        return "".join(out), state


class TokenDecoder:
    """The machine with tokens as inputs; arcs are made when they are first met."""

    def __init__(self, bytes_of: list[bytes], kept: int = KEPT_DECODED):
        self.bytes_of, self.kept = bytes_of, kept
        self._from_start: dict[int, str] = {}  # arcs from and to the state b""
        self._arcs: dict[tuple[bytes, int], tuple[str, bytes]] = {}

    def _arc(self, state: bytes, token: int) -> tuple[str, bytes]:
        arc = self._arcs.get((state, token))
        if arc is None:
            arc = Utf8Machine.run(state, self.bytes_of[token])
            if not state and not arc[1]:
                self._from_start[token] = arc[0]
            elif len(self._arcs) < self.kept:
                self._arcs[state, token] = arc
        return arc

    def stream(self, ids, step: int = 65536):
        """The text in parts, as whole characters become known."""
        state, whole = b"", self._from_start
        for i in range(0, len(ids), step):
            part = ids[i : i + step]
            out = [] if state else list(map(whole.get, part))
            if state or None in out:
                out = []
                for t in part:
                    if not state and (given := whole.get(t)) is not None:
                        out.append(given)
                    else:
                        given, state = self._arc(state, t)
                        out.append(given)
            yield "".join(out)
        if state:
            yield "\ufffd"


class Coder:
    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern, self.machine = pattern, Transducer(ranks)
        self.bytes_of = [self.machine.token.get(i, b"") for i in range(max(ranks.values()) + 1)]
        self.decoder = TokenDecoder(self.bytes_of)
        self._kept: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        kept, out = self._kept, []
        for p in pieces(text, self.pattern):
            ids = kept.get(p)
            if ids is None:
                if len(kept) > KEPT_PIECES:
                    kept.clear()
                ids = tuple(self.machine.encode(p.encode("utf-8", "surrogatepass")))
                if len(p) < 64:
                    kept[p] = ids
            out += ids
        return out

    def decode_stream(self, ids, step: int = 65536):
        return self.decoder.stream(ids, step)


@lru_cache(2)
def coder(ranks_path: str, pattern: str) -> Coder:
    return Coder(ranks_path, pattern)


@lru_cache(2)
def _decimals(n: int) -> list[str]:
    return [str(i) for i in range(n)]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id_col, kept columns, ids (array of int) and decoded (the text that the ids decode to). A task gives back its transducer's memory."""

    def run(batches):
        own = coder(ranks_path, pattern)
        for b in without_collector(batches):
            ids = [own.encode(t) for t in b.column(len(b.column_names) - 1).to_pylist()]
            decoded = ["".join(own.decode_stream(x)) for x in ids]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], [*b.column_names[:-1], "ids", "decoded"])
        del own
        coder.cache_clear()
        release_memory()

    src = docs.select(id_col, *keep, text_or_empty(text_col).alias("_bpe_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{fields}, ids array<int>, decoded string")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256. Ids and texts stay in the task that made them."""

    def run(batches):
        own = coder(ranks_path, pattern)
        names = _decimals(len(own.bytes_of))
        for b in without_collector(batches):
            n, a, d = [], [], []
            for t in b.column(1).to_pylist():
                ids = own.encode(t)
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                h = hashlib.sha256()
                for part in own.decode_stream(ids):
                    h.update(part.encode())
                d.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = docs.select("doc_id", text_or_empty().alias("_text"))
    return src.mapInArrow(run, f"doc_id {src.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
