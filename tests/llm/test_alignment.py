"""The alignment of two tokenizers' tokens against a merge of byte ranges, document by document."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from recordloom.llm import alignment

PATHS = P.path("byte_bpe_50k.json"), P.PATTERN, P.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "a", "  two  spaces ", "naïve café 😀 x", "has ▁ in it", "<|endoftext|> plain <s>", "line\n\nline\ttab", "\x00 zero", "ab" * 3000, "the cat sat on the mat " * 400, "the cat sat on the mat", "the cat sat on the mat", "ﬁx Å 漢字かな", "é"]
SCHEMA = "doc_id long, text string, block string, pair long, n_a long"


def expected(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    tok, sp = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[2])
    tok.encode_special_tokens = True
    letters = {v: k for k, v in alignment._byte_letters().items()}
    out = []
    for t in texts:
        a = tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        bytes_a = [bytes(letters[c] for c in tok.id_to_token(x)) for x in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(sp.id_to_piece, b)]
        if not t or not (b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode()):
            a, b, bytes_a, bytes_b = [], [], [], []
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        links, cuts, j = [], [], 0
        for i, end in enumerate(ends_a):
            start = end - len(bytes_a[i])
            while j and ends_b[j - 1] > start:
                j -= 1
            while j < len(ends_b) and ends_b[j] - len(bytes_b[j]) < end:
                if ends_b[j] > start:
                    links.append((i, j))
                j += 1
            if end in set(ends_b):
                cuts.append((i, ends_b.index(end)))
        out.append((a, b, links, cuts))
    return out


@pytest.fixture(scope="module")
def known():
    return expected(TEXTS)


@pytest.mark.parametrize("lane", [1, 7, 512])
def test_lanes(known, lane, monkeypatch):
    monkeypatch.setattr(alignment.merged, "__defaults__", (lane,))
    x = alignment.Batch([t or "" for t in TEXTS], alignment._tokenizers(*PATHS))
    links = sorted(zip(x.link_a.tolist(), x.link_b.tolist()))
    first_a, first_b = np.concatenate([[0], x.docs_a]), np.concatenate([[0], x.docs_b])
    assert links == [(first_a[d] + i, first_b[d] + j) for d, (_, _, own, _) in enumerate(known) for i, j in own]
    assert x.groups().tolist() == [len(cuts) for _, _, _, cuts in known]


def test_alignments(spark, known):
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(TEXTS)], SCHEMA)
    out = {r.doc_id: r for r in alignment.alignments(docs, *PATHS).collect()}
    for i, (a, b, links, cuts) in enumerate(known):
        assert (out[i].a, out[i].b, [tuple(x) for x in out[i].links], [tuple(x) for x in out[i].cuts]) == (a, b, links, cuts)
    assert known[6][0] == [] and known[7][0]  # U+2581 reads as a space; strings of special tokens are plain


@pytest.mark.parametrize("block", [500, 8_000_000])
def test_digests(spark, known, block):
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(TEXTS)] + [(None, TEXTS[3], "x", 1, 2), (5, TEXTS[5], "x", 1, 2)], SCHEMA)
    rows = [*enumerate(known), (None, known[3]), (5, known[5])]
    counts = Counter((a[i], b[j]) for _, (a, b, links, _) in rows for i, j in links)
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    want = []
    for k, (a, b, links, cuts) in rows:
        parts, i, j = [], 0, 0
        for x, y in cuts:
            parts.append(",".join(map(str, a[i : x + 1])) + "|" + ",".join(map(str, b[j : y + 1])))
            i, j = x + 1, y + 1
        own = [counts[a[i], b[j]] for i, j in links]
        best = sum(n == most[b[j]] for n, (_, j) in zip(own, links))
        want.append((k, len(a), len(b), len(cuts), len(links), best, sum(own), hashlib.sha256(";".join(parts).encode()).hexdigest() if a else ""))
    out = [tuple(r) for r in alignment.digests(docs.repartition(3), *PATHS, block_links=block).collect()]
    assert sorted(out, key=str) == sorted(want, key=str)
    assert alignment.digests(docs.limit(0), *PATHS).count() == 0
