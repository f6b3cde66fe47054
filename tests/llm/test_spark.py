"""Operators on Spark, against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, other columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from recordloom.llm import bpe, jaccard, pagediff, positional, ranking, suffixdedup, vafile, warc, wavelet

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, row long"
RANKS, TOKENIZER = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


def make_texts():
    r = random.Random(7)
    word = lambda: "".join(r.choice(["the", "ing", "er", "é", "a", "to"]) for _ in range(r.randint(1, 3)))
    base = [[word() for _ in range(r.randint(40, 160))] for _ in range(5)]
    out = [None, "", "one", "one two", "A a  b", " \n ", "x" * 5000, "ab " * 900]
    for _ in range(60):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 6])):
            w[r.randrange(len(w))] = word()
        out.append(" ".join(w[: r.choice([len(w), len(w), len(w) // 2])]))
    return [*out, out[-1], out[-1], "<|endoftext|> é😀"]


@pytest.fixture(scope="module")
def texts():
    return make_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "w", i) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_and_wavelet(spark, docs, texts, empty):
    import tiktoken
    from tokenizers import Tokenizer

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.coder(RANKS, P.PATTERN).machine.ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    out = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, RANKS, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert out[i] == (len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()))
    tok, start = Tokenizer.from_file(TOKENIZER), 0
    manifest = wavelet.write_shards(docs, TOKENIZER, P.PATTERN, shard_ids=500)
    assert manifest.count() > 4
    out = {r.doc_id: r for r in wavelet.read_documents(manifest, docs.schema["doc_id"].dataType).collect()}
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (out[i].start, out[i].n_tokens, out[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    shard = wavelet.Shard.open(manifest.orderBy("start").first().path)
    first = [*tok.encode(texts[0] or "", add_special_tokens=False).ids, 2, *tok.encode(texts[1], add_special_tokens=False).ids, 2, *tok.encode(texts[2], add_special_tokens=False).ids]
    assert [shard.access(k) for k in range(len(first))] == first and shard.select(2, 1) == first.index(2) + 1
    for kind in ("smallint", "string", "decimal(10,0)"):
        rows = wavelet.digests(docs.select(F.col("doc_id").cast(kind).alias("doc_id"), "text").where("text is not null").limit(3), TOKENIZER, P.PATTERN)
        assert rows.schema["doc_id"].dataType.simpleString() == kind and rows.count() == 3
    assert bpe.digests(empty, RANKS, P.PATTERN).count() == wavelet.digests(empty, TOKENIZER, P.PATTERN).count() == 0


def test_suffix_dedup(docs, texts, empty):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p : p + 200] for d in data for p in range(len(d) - 199))
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.digests(docs).collect()}
    for i, d in enumerate(data):
        hit = np.zeros(len(d) + 1, bool)
        for p in range(len(d) - 199):
            if seen[d[p : p + 200]] > 1:
                hit[p : p + 200] = True
        kept = bytes(b for b, h in zip(d, hit) if not h)
        assert out[i] == (len(d), int(hit.sum()), int((np.diff(hit.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    assert suffixdedup.digests(empty).count() == 0
    assert suffixdedup.kept_text("aéb".encode(), [[0, 2]]) == "b"


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80), (3, 100)])
def test_jaccard(docs, texts, empty, words, percent):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)]) if w else frozenset()

    sets = [grams(t) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_documents(docs, words, percent).collect()}
    assert out == {i: (len(s), find(i)) for i, s in enumerate(sets)}
    if words == 5:
        assert {r.doc_id for r in jaccard.without_linked(docs).collect()} == {i for i in range(len(sets)) if find(i) == i}
        assert jaccard.link_documents(empty).count() == 0


def test_decontamination(spark, docs, texts, empty):
    w = [positional.words(t or "") for t in texts]
    items = [("b", " ".join(w[20][5:30])), ("a", " ".join(w[30][:10])), ("short", "One"), ("none", None), ("", ""), ("absent", "zz " * 12), (None, " ".join(w[20][5:20]))]
    wins = {(i, tuple(x[k : k + 10])) for i, t in items for x in [positional.words(t or "")] for k in range(max(1, len(x) - 9) if x else 0)}
    out = {r.doc_id: tuple(r)[1:6] for r in positional.digests(docs, spark.createDataFrame(items, "item_id string, text string")).collect()}
    for i, x in enumerate(w):
        hit, found = set(), set()
        for item, win in wins:
            for k in range(len(x) - len(win) + 1):
                if tuple(x[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found |= {item} - {None}
        assert out[i] == (len(x), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    many = positional.contamination(docs, spark.createDataFrame(items, "item_id string, text string"), block_windows=2)
    assert {r.doc_id: (r.n_hit, r.n_items) for r in many.collect()} == {k: (v[1], v[2]) for k, v in out.items()}
    assert positional.digests(empty, empty.select(F.col("doc_id").alias("item_id"), "text")).count() == 0


def test_proximity():
    lists = {"a": np.array([1, 10]), "b": np.array([3, 20])}
    assert positional.find(lists, ["a", "b"]).tolist() == [] and positional.find(lists, ["a", "b"], 2).tolist() == [1]


def test_top_k(spark):
    g = np.random.default_rng(4)
    rows = [(i, [float(x) for x in g.normal(size=6)], "x") for i in range(200)] + [(300 + i, [1.0] * 6, "x") for i in range(50)]
    rows += [(400, None, "x"), (420, [1.0, None, 1.0, 1.0, 1.0, 1.0], "x"), (440, [float("nan")] * 6, "x"), (460, [float("inf")] * 6, "x"), (None, [1.0] * 6, "x"), (480, [], "x")]
    rows += [(5, [2.0] * 6, "x")] * 30 + [(500, [float(1 << 45), 1.0, 0.0, 0.0, 0.0, 0.0], "x"), (600, [0.5], "x"), (601, [0.25], "x")]
    out = {}
    found = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    for r in vafile.top_k(found, file_rows=40, block_queries=5).collect():
        out.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    ints = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and i not in (400, 420, 440, 460, 480)]
    queries = [(i, v) for i, v in ints if i % 20 == 0]
    for q, v in queries:
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ints if i != q and len(w) == len(v))[:20]
        assert sorted(out[q]) == [(k + 1, s, i) for k, (s, i) in enumerate(best)]
    assert set(out) == {q for q, _ in queries}
    assert vafile.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_top_k_reads_few_vectors(spark):
    g = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v / np.linalg.norm(v)]) for i, v in enumerate(g.normal(size=(4000, 16)))]
    stats = vafile.results(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("vec_id is null").groupBy().sum("n_read", "n_scanned").first()
    assert 0 < stats[0] < 0.1 * stats[1]


def test_warc(spark):
    big, small = "<p>é</p>" * 200, "<p>x</p>"
    pages = [(1, "http://a/ü\n", big, 0), (2, None, big, 0), (5, "http://b", big + "!", 0), (3, "u", small, 0), (4, "u", small, 0), (6, "u", None, 0), (7, "u", "", 0), (2, "u", big, 0)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload long")
    out = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in warc.archive(df).collect())
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    assert out == sorted((i, len((t or "").encode()), sha(t), "revisit" if i == 1 else "response", 2 if i == 1 else 0) for i, _, t, _ in pages)
    folder = warc.shared_folder(spark)
    warc.write_archive(warc.with_record_types(df), folder, splitBytes=100, fileBytes=4000)
    back = warc.read_archive(spark, folder)
    assert back.where("page_id = 1").select("target_uri").first()[0] == "http://a/ü\n"
    plan = back.where("warc_type = 'revisit' and payload_length > 10")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("PushedFilters", "").replace("RuntimeFilters", "")
    assert warc.read_archive(spark, folder, payload=False).where("payload is not null").count() == 0
    assert warc.archive(df.limit(0)).count() == 0


def test_pages(spark):
    chrome = lambda k: f"<html><body><div>Site name</div><div>Links</div><div><p>own {k}</p><p>text {k}</p></div><div>End</div></body></html>"
    art = "<html><body><div>Site name</div><article><p>shared</p></article></body></html>"
    pages = [(k, f"http://Host/x/{k}", chrome(k), 1) for k in range(20)] + [(30, "http://other/x", chrome("z"), 1), (31, None, "<p>t", 1), (32, "http://host/y", None, 1), (33, "http://q/1", art, 1), (34, "http://q/2", art, 1), (35, "http://r/1", chrome("r"), 1), (36, "http://r/2", chrome("r"), 1)]
    out = {r.page_id: (r.url, r.text, r.n_chars) for r in pagediff.main_text(spark.createDataFrame(pages, "page_id long, url string, html string, text long")).collect()}
    for k in range(20):
        assert out[k] == (f"http://Host/x/{k}", f"own {k}\n\ntext {k}", len(f"own {k}\n\ntext {k}"))
    assert out[30][1].startswith("Site name") and out[31][1] == "t" and out[32] == ("http://host/y", "", 0)
    assert out[33][1] == out[34][1] == "shared" and out[35][1].startswith("Site name")
    assert pagediff.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_ranking(spark, empty):
    good = [(i, f"Plain words stand here, number {i}.\nAnd more of them follow.", "en", "s", 1, "", 1) for i in range(80)]
    bad = [(100 + i, f"BUY!! NOW!! {i} !!! $$$ " * 5, "en", "s", 1, "", 1) for i in range(40)]
    docs = spark.createDataFrame([*good, *bad, (500, None, "en", "s", 0, "", 1), (500, None, "en", "s", 0, "", 1), (None, "Plain words", "en", "s", 0, "", 1)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i in [*range(80), *range(100, 140)]] + [(3, None, 0)], "doc_id long, quality int, toxic int")
    out = ranking.classify(docs, labels).collect()
    assert len(out) == 123 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 500]
    assert held and all(r.predicted == int(r.doc_id < 100) for r in held)
    assert {r.score for r in ranking.classify(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert ranking.classify(empty, labels.limit(0)).count() == 0


def test_one_file_of_cells_is_open_at_a_time(monkeypatch, tmp_path):
    """More blocks of queries than tasks: a band has all files, and a task still holds the cells of one."""
    import gc
    import weakref

    r = np.random.default_rng(8)
    rows, files = r.integers(-60, 60, (400, 6)), []
    for k in range(0, 400, 20):
        low, width, cells = vafile.cells_of(rows[k : k + 20])
        path = f"file://{tmp_path}/{k}"
        vafile.write_bytes(f"{path}.exact", [rows[k : k + 20].astype("<i8").tobytes()])
        vafile.write_bytes(f"{path}.cells", [vafile.MAGIC + vafile.struct.pack("<III", 6, 20, 8), low.astype("<i8").tobytes(), width.astype("<i8").tobytes(), np.arange(k, k + 20).astype("<i8").tobytes(), cells.tobytes()])
        files.append(path)
    live, most = weakref.WeakSet(), [0]

    class Counted(vafile.Cells):
        def __init__(self, path):
            super().__init__(path)
            live.add(self)
            gc.collect()
            most[0] = max(most[0], len(live))

    monkeypatch.setattr(vafile, "Cells", Counted)
    ids = np.arange(0, 400, 20)
    least = vafile.scan(rows[ids], ids, files, 5)[:, 0]
    found, _ = vafile.search(rows[ids], ids, least, files, 5, pairs=30)
    whole = rows[ids] @ rows.T
    for q, i in enumerate(ids):
        want = sorted((-whole[q, j], j) for j in range(400) if j != i)[:5]
        assert sorted((-s, v) for p, v, s in found if p == q)[:5] == want
    assert most[0] <= 2
