"""Operators without Spark: codecs, suffix arrays, page lines, top-k, features."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest

from recordloom.llm.files import write_bytes
from recordloom.llm import pagediff, pretoken, ranking, suffixdedup, vafile, wavelet
from recordloom.llm.bpe import Coder, TokenDecoder, Utf8Machine
from recordloom.llm.grouping import suffix_array
from recordloom.llm.pretoken import pieces


@pytest.fixture(scope="module")
def coder():
    return Coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def random_texts(n, seed=1):
    r = random.Random(seed)
    parts = ["a", "e", " ", "\n", "é", "中", "😀", "0", "the", "ing", "!!", "$", "'s", "̀", "²", "\x1c", "\xa0", "ß", "ŉ"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 20))) for _ in range(n)]


def test_bpe_equals_tiktoken(coder):
    import regex
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.machine.ranks, special_tokens={})
    whole = regex.compile(P.PATTERN)
    for t in [*random_texts(3000), "a" * 3000, " " * 2000 + "x", "ab" * 2000, "<|endoftext|>"]:
        assert pieces(t, P.PATTERN) == whole.findall(t)
        ids = coder.encode(t)
        assert ids == enc.encode_ordinary(t)
        assert "".join(coder.decode_stream(ids, 3)) == t


def test_transducer_within_its_bound():
    c = Coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    c.machine.kept_arcs = 5
    full = Coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for t in random_texts(300, 4):
        c._kept.clear()
        assert c.encode(t) == full.encode(t)
    assert c.machine.bytes_beyond > 0 == full.machine.bytes_beyond and full.machine.bytes_by_arcs > 0


def test_utf8_machine():
    r = random.Random(6)
    parts = [b"a", "é".encode(), "中".encode(), "😀".encode(), b"\xff", b"\xc3", b"\xe4\xb8", b"\xf0\x9f", b"\x80", b"\xed\xa0\x80", b"\xc0\xaf", b"\xf4\x90\x80\x80", b"\xe0\x80"]
    for _ in range(3000):
        data = b"".join(r.choice(parts) for _ in range(r.randint(0, 8)))
        text, state = Utf8Machine.run(b"", data)
        assert text + ("\ufffd" if state else "") == data.decode("utf-8", "replace")
        tokens = [data[i : i + 2] for i in range(0, len(data), 2)]
        decoder = TokenDecoder(tokens, kept=r.choice([0, 3, 100]))
        ids = list(range(len(tokens)))
        assert "".join(decoder.stream(ids, r.choice([1, 2, 100]))) == data.decode("utf-8", "replace") == "".join(decoder.stream(ids, 3))


def test_suffix_array():
    r = random.Random(3)
    for _ in range(1500):
        s = [r.randrange(r.choice([1, 2, 3, 9])) for _ in range(r.randint(0, 30))]
        assert suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_repeated_starts():
    r = random.Random(5)
    for _ in range(60):
        letters = r.choice([["a", "b", " "], ["the ", "of ", "x", "y "], ["é", "a", " "]])
        make = lambda n: "".join(r.choice(letters) for _ in range(n)).encode()  # noqa: B023, E731
        base, segments = make(400), []
        for _ in range(4):
            i = r.randint(0, 100)
            segments.append(make(r.randint(0, 30)) + base[i : r.randint(i + 150, 450)] + make(r.randint(0, 30)))
        seen = {}
        for s in segments:
            for p in range(len(s) - 199):
                seen[s[p : p + 200]] = seen.get(s[p : p + 200], 0) + 1
        for s, found in zip(segments, suffixdedup.repeated_starts(segments, [1] * 4, 200)):
            assert sorted(found.tolist()) == [p for p in range(len(s) - 199) if seen[s[p : p + 200]] > 1]


@pytest.mark.parametrize("bits", [3, 16, 17])
def test_wavelet_matrix(bits, tmp_path):
    n = 200_000
    ids = np.random.default_rng(bits).integers(0, 1 << bits, n).astype(np.uint32)
    ids[::3] = 5  # frequent
    path = f"file://{tmp_path}/one.wm"
    write_bytes(path, wavelet.shard_parts(ids, bits, pa.array(["a", None]), [1000, n - 1000]))
    m = wavelet.Shard.open(path)
    assert (m.all() == ids).all() and m.documents().to_pydict() == {"doc_id": ["a", None], "n": [1000, n - 1000]}
    for p in (0, 511, 65535, 65536, n - 1):
        assert m.access(p) == ids[p]
    for v in (5, int(ids[7]), int(ids[n - 2]), (1 << bits) - 1):
        places = np.flatnonzero(ids == v)
        assert m.count(v) == len(places) and m.count(v, 100, 90_000) == ((places >= 100) & (places < 90_000)).sum()
        assert [m.select(v, k) for k in (*range(min(3, len(places))), len(places) - 1)] == [*places[:3].tolist(), *(places[-1:].tolist() or [-1])] and m.select(v, len(places)) == -1
    assert m.count(1 << bits) == m.count(-1) == 0
    with pytest.raises(IndexError):
        m.access(n)


def test_shard_is_compressed_and_read_by_ranges():
    ids = np.minimum(np.random.default_rng(1).zipf(1.3, 400_000), 50_000).astype(np.uint32)
    data = b"".join(wavelet.shard_parts(ids, 16, pa.array([1]), [len(ids)]))
    assert len(data) < 2 * len(ids) * 0.75
    asked = []
    m = wavelet.Shard(lambda at, size: asked.append(size) or data[at : at + size])
    assert m.access(123_456) == ids[123_456] and m.select(1, 1000) == np.flatnonzero(ids == 1)[1000]
    assert sum(asked) < len(data) / 2
    with pytest.raises(ValueError, match="not a shard"):
        wavelet.Shard.of(b"x" * 40)


def test_empty_wavelet_matrix():
    m = wavelet.Shard.of(b"".join(wavelet.shard_parts(np.zeros(0, np.uint32), 4, pa.array([], pa.int64()), [])))
    assert m.n == 0 and len(m.all()) == 0 and m.count(3) == 0 and m.documents().num_rows == 0


def test_pieces_of_other_patterns():
    assert pretoken.pieces("ab 12", r"\p{L}|\p{N}+") == ["a", "b", "12"] and pretoken.pieces("ab 12", pretoken.KNOWN) == ["ab", " 12"]


@pytest.mark.parametrize("big", [1, 1 << 50])
def test_cells_bound_scores(big):
    g = np.random.default_rng(2)
    rows, q = g.integers(-300, 300, (200, 8)) * big, g.integers(-300, 300, (10, 8))
    low, width, cells = vafile.cells_of(rows)
    least, most = vafile.bounds(q, low, width, cells)
    full = q.astype(object) @ rows.astype(object).T
    assert (least <= full).all() and (full <= most).all() and int(cells.max()) < 32


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li>Menu</ul></nav>
<div class="cookie-notice">ok?</div>%s<section id="comments"><p>nice</section><form><input>Go</form><footer>&copy; x</footer></body></html>"""


def test_page_lines():
    article = pagediff.candidate_lines(PAGE % "<article><header><h1>A &amp;amp;</h1></header><p><b>one<br>\n two<p>th<i>r</i>ee&nbsp; x<!-- c --><aside>no</aside></article>")
    assert article == (True, ["A &amp;", "one two", "three x"])
    assert pagediff.candidate_lines(PAGE % "<div><p>body 1 < 2</div><table><tr><td>a<td>b</table>") == (False, ["body 1 < 2", "a b"])
    assert pagediff.candidate_lines("") == (False, []) and pagediff.candidate_lines("<p") == (False, ["<p"])


def test_common_subsequence_is_longest():
    def length(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.randrange(4) for _ in range(r.randint(0, 12))] for _ in range(2))
        found = [a[i] for i in sorted(pagediff.common_subsequence(a, b))]
        rest = iter(b)
        assert len(found) == length(a, b) and all(x in rest for x in found)


def test_ranking_parts_what_can_be_parted():
    good, bad = (np.array([ranking.features(t) for t in x]) for x in ([f"Some plain words number {i} here." for i in range(50)], [f"BUY!! NOW!! {i} $$$ !!!" for i in range(20)]))
    m = ranking.fit_pairs(good, bad, 0.3)
    assert (m.scores(good) >= 0.3).all() and (m.scores(bad) < 0.3).all() and 0 < m.quantile < 1
    empty = m.scores(ranking.features("")[None])
    assert 0 <= empty[0] <= 1
