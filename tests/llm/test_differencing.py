"""Page differencing in articles, past copies and across ranges of the order."""

from recordloom.llm import pagediff


def test_articles_copies_and_ranges(spark):
    article = lambda k: f"<html><body><article><p>own {k}</p><p>Share this</p></article></body></html>"
    plain = lambda k: f"<html><body><div>Site</div><div>text {k}</div><div>End</div></body></html>"
    pages = [(k, f"http://a/x/{k}", article(k)) for k in range(3)]
    pages += [(10 + k, f"http://b/p?q={k}", plain("same")) for k in range(40)] + [(60, "http://b/o", plain("before")), (61, "http://b/q", plain("after"))]
    pages += [(70 + k, f"http://c/p?q={k}", plain("same")) for k in range(5)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out = {r.page_id: r.text for r in pagediff.main_text(df).collect()}
            assert [out[k] for k in range(3)] == ["own 0", "own 1", "own 2"]
            assert {out[10 + k] for k in range(40)} == {"text same"} and (out[60], out[61]) == ("text before", "text after")
            assert {out[70 + k] for k in range(5)} == {"Site\n\ntext same\n\nEnd"}  # no page with other lines
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_articles_keep_lines_that_other_articles_repeat(spark):
    """Lines that some articles of a host share by chance, and near copies, stay; the site's own lines go, whatever their elements are called."""
    article = lambda *ps: "<html><body><div class=x1>Site</div><article>" + "".join(f"<p>{p}</p>" for p in ps) + "<p>Follow us</p></article></body></html>"
    pages = [(k, f"http://a/x/{k:02}", article("common" if k % 4 == 0 or k == 5 else f"other {k}", f"own {k}", f"more {k}")) for k in range(12)]
    pages += [(20 + k, f"http://b/{k}", article("one", "two", "three", f"four {k}")) for k in range(3)]
    pages += [(30 + k, f"http://c/{k}", article("alike", f"own {k}")) for k in range(2)]
    out = {r.page_id: r.text.split("\n\n") for r in pagediff.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(out[k] == ["common" if k % 4 == 0 or k == 5 else f"other {k}", f"own {k}", f"more {k}"] for k in range(12))
    assert all(out[20 + k] == ["one", "two", "three", f"four {k}", "Follow us"] for k in range(3))
    assert all(out[30 + k] == ["alike", f"own {k}", "Follow us"] for k in range(2))


def test_long_pages_of_repeated_lines():
    import random
    import time

    r = random.Random(2)
    for n in (1, 2, 7, 40, 90):
        a, b = ([r.choice("ab" if n > 7 else "abc") for _ in range(n + k)] for k in (0, r.randint(0, 30)))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        for found in (pagediff._by_halves(a, b), pagediff.common_subsequence(a, b)):
            assert len(set(found)) == table[-1][-1]
            at = 0  # what was found is in b, in this order
            for i in sorted(found):
                at = b.index(a[i], at) + 1
    a, b = [r.choice("ab") for _ in range(20_000)], [r.choice("abc") for _ in range(20_000)]
    began = time.process_time()
    assert len(pagediff.common_subsequence(a, b)) > 10_000 and time.process_time() - began < 20


def _brute(pages):
    """Texts by definition: all pages of a host in order, each against the nearest page of other lines on both sides; longest common subsequences by the full table."""
    from urllib.parse import urlsplit

    def common(a, b):
        n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                n[i][j] = n[i + 1][j + 1] + 1 if a[i] == b[j] else max(n[i + 1][j], n[i][j + 1])
        return n[0][0]

    read = {i: pagediff.candidate_lines(h) for i, _, h in pages}
    hosts, out = {}, {}
    for i, url, _ in pages:
        u = urlsplit(url)
        hosts.setdefault(u.netloc, []).append((u.path, read[i][1], i))
    for own in hosts.values():
        own = [x for x in own if x[1]]
        texts = {tuple(x[1]) for x in own}
        for path, lines, i in own:
            best = set()
            for order in (sorted(p for p in own if p[0] < path)[::-1], sorted(p for p in own if p[0] > path)):
                other = next((p[1] for p in order if p[1] != lines), None)
                if other:
                    f = pagediff.common_subsequence(lines, other)
                    assert len(f) == common(lines, other)
                    if not read[i][0] or 2 * len(f) <= len(lines):
                        best |= {k for k in f if not read[i][0] or (c := sum(lines[k] in t for t in texts)) >= 3 and 2 * c >= len(texts)}
            out[i] = lines if len(best) == len(lines) else [x for k, x in enumerate(lines) if k not in best]
    return out


def test_against_brute_force(spark):
    import random

    r = random.Random(11)
    pages = []
    for k in range(300):
        host = r.choice(["a", "a", "a", "b", "c", f"d{k}"])
        body = "".join(f"<p>{r.choice('pqrstuv') if r.random() < 0.5 else k}</p>" for _ in range(r.randint(1, 6)))
        shell = "<div>Site {0}</div><div>Links</div>{1}<div>Bottom</div>".format(host, f"<article>{body}<p>Share</p></article>" if host in "ab" and r.random() < 0.6 else body)
        pages.append((k, f"http://{host}/{k:04}", f"<html><body>{shell}</body></html>"))
    out = {x.page_id: x.text for x in pagediff.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    want = _brute(pages)
    assert {k: out[k] for k in want} == {k: "\n\n".join(v) for k, v in want.items()}
    plain = {i: "\n\n".join(pagediff.candidate_lines(h)[1]) for i, _, h in pages}
    assert sum(out[k] != plain[k] for k in out) > 100  # differencing decides


def test_beside_looks_past_ranges_of_copies():
    page = lambda host, sig, row: (host, sig, row)
    a, b, c, d = page("h", 1, 10), page("h", 2, 20), page("h", 2, 30), page("h", 3, 40)
    ends = [(0, a, b, a, b), (1, c, None, None, c), (2, c, d, c, d), (3, page("i", 3, 50), None, None, page("i", 3, 50))]
    assert sorted(pagediff._beside(ends)) == [(0, 2, 40), (1, 0, 10), (1, 2, 40), (2, 0, 10)]


def test_wrappers_and_names():
    read = lambda html: pagediff.candidate_lines(f"<html><body>{html}</body></html>")[1]
    for name in ("no-sidebar", "has-sidebar", "content-with-banner", "widget", "sidebar"):
        for tag in ("article", "main"):
            assert read(f'<div class="{name}"><{tag}><p>text</p></{tag}></div>') == ["text"], name
    assert read("<form><div role=search><main><p>one</p><article><p>two</p></article></main></div></form>") == ["two"]
    for name in ("social-science", "share-price", "entry-header"):
        assert read(f'<article><div class="{name}">own</div><p>text</p></article>') == ["own", "text"], name
    for name in ("sidebar", "sidebar-left", "sidebar-1", "social-links", "cookie_notice", "nav-primary"):
        assert read(f'<article><div class="{name}">chrome</div><p>text</p></article>') == ["text"], name
    assert read("<article><p>a long text of the page</p></article><aside><article>teaser</article></aside>") == ["a long text of the page"]
    assert read('<article><p>text</p></article><section id="comments"><article class="comment">a much longer comment</article></section>') == ["text"]
