"""Operator 1: main text of web pages by nearest-URL page differencing.

A page is read into lines (blocks of text) and each line gets a zone from the elements around it: *dropped* (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, reader comments), *article* (inside an article element, or main where there is none) or *open* (anything else). Pages are put in the order of host and URL path, in
which the page with the nearest path stands next to each; the lines of the two are aligned by their longest common subsequence, and what they share is the site's, not the
page's: it is deleted. In an article, where chance and copies repeat lines too, a line goes only if at least half of the host's pages have it too, and a neighbour that shares more than half of the article (another copy of it) is passed over.
A page that has an article gives nothing else. Pages with the same lines throughout (copies) say nothing of each other: a run of them counts as one page,
and each is compared with the nearest page of its host before and after that has other lines. A page whose lines would all go keeps them, and pages without lines are passed over.

Pages are dealt by ranges of (host, path), so that a host with a third of all pages is spread like any other; the nearest page with other lines than a range's first (last) page travels to it from the ranges before (after) it, however far, so the
result doesn't depend on where ranges end. Only hashes of lines travel; texts are read again from the pages.

Results: null html gives an empty text; very long pages are read whole, and aligned in time that grows with the product of their lines over 64 at worst and space that grows with the lines; null or hostless URLs have no neighbours. Repeated rows get a row each. Other columns are not read.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shuffle_partitions, written

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody tfoot thead title tr ul".split())
_SPACED = {"br", "td", "th", "img"}
_DROPPED = set("script style noscript template head title nav footer aside form button select textarea input option iframe object svg canvas dialog menu search audio video map fieldset legend label".split())
_DROPPED_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
_DROPPED_NAMES = set(
    "ad ads adbox adslot advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs byline-share comment comments commentlist comment-list commentform consent cookie cookies copyright disclaimer "
    "disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommended related replies reply "
    "respond share sharing sidebar signup skip-link social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
_UNSEEN, _HIDDEN = {"noscript", "template"}, re.compile(r"\bhidden\b|display\s*:\s*none", re.I)
#: Words that a dropped name may stand with: sidebar-left, social-links; not social-science, no-sidebar.
_PLACES = set("area bar block box button buttons container form icons inner item items left link links list main outer panel posts primary right secondary section site top bottom wrap wrapper".split())
_CLOSED_BY = {"p": _BLOCKS - {"caption", "tbody", "thead", "tfoot", "tr", "option", "legend"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "p": {"table", "td", "th", "button", "object"}, "option": {"select"}}


def _named(x: str) -> bool:
    """Whether a class or id is made up of dropped names, words of _PLACES and numbers only."""
    parts = [w for w in re.split(r"[-_]+", x) if w and not w.isdigit()]
    return not _DROPPED_NAMES.isdisjoint(parts) and all(w in _DROPPED_NAMES or w in _PLACES for w in parts)


def _drops(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in _DROPPED or tag == "header" and not in_article:
        return True
    if not attributes.strip() or tag in ("html", "body", "article", "main") and not re.search("comment|hidden", attributes, re.I):
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name == "role" and value in _DROPPED_ROLES:
            return True
        if name in ("class", "id"):
            for x in value.split():
                if x in _DROPPED_NAMES or _named(x):
                    return True
    return False


def lines(html: str) -> list[tuple[str, str]]:
    """(zone, text) of each block that isn't dropped; zone is article, main or open. White space is one space. What contains the main element and the longest article (in it, if there is one) is never dropped."""
    out, bodies = _read(html, frozenset())
    if not any(b[2] for b in bodies):
        return out
    best = lambda found: max(found, key=lambda b: (not b[4], b[3]), default=None)
    main = best([b for b in bodies if b[0] == "main"])
    own = best([b for b in bodies if b[0] == "article" and (main is None or main[5] in b[1])])
    around = frozenset(at for b in (main, own) if b for at in b[1])
    return _read(html, around)[0] if around else out


def _read(html: str, around: frozenset) -> tuple[list[tuple[str, str]], list[list]]:
    """The lines, and main and article elements that don't go by themselves: [zone, places of the elements around, dropped, characters, hidden, place]; elements at the places ``around`` stay."""
    out: list[tuple[str, str]] = []
    bodies: list[list] = []
    places: list[tuple] = []  # beside the stack: place, body, hidden
    stack: list[tuple[str, bool, str]] = []  # tag, dropped, zone
    words: list[str] = []
    at, end = 0, len(html)

    def flush(zone: str) -> None:
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            out.append((zone, text))

    while at < end:
        m = _TOKEN.search(html, at)
        stop = m.start() if m else end
        _, dropped, zone = stack[-1] if stack else ("", False, "open")
        if stop > at:
            for _, body, _ in places:
                if body:
                    body[3] += stop - at
        if stop > at and not dropped:
            words.append(_html.unescape(html[at:stop]))
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if tag in ("br", "p") and all(x[0] != tag for x in stack):
                if not dropped:
                    flush(zone) if tag == "p" else words.append(" ")
                continue
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if k is None:
                continue
            if tag not in _BLOCKS and any(x[0] in _BLOCKS for x in stack[k + 1 :]):
                continue  # an inline element's end doesn't end the blocks inside it
            if any(x[0] in _BLOCKS for x in stack[k:]) and not dropped:
                flush(zone)
            elif tag in _SPACED and not dropped:
                words.append(" ")
            del stack[k:], places[k:]
            continue
        for open_tag, closers in _CLOSED_BY.items():
            if tag in closers:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == open_tag:
                        if not stack[-1][1]:
                            flush(stack[-1][2]) if open_tag in _BLOCKS else words.append(" ")
                        del stack[i:], places[i:]
                        break
                    if stack[i][0] in _SCOPES.get(open_tag, ()) or stack[i][0] in _BLOCKS and open_tag == "p":
                        break
        _, dropped, zone = stack[-1] if stack else ("", False, "open")
        if tag in _BLOCKS and not dropped:
            flush(zone)
        elif tag in _SPACED and not dropped:
            words.append(" ")
        if tag in _VOID or attributes.rstrip().endswith("/") and tag not in _BLOCKS and tag not in _RAW:
            continue
        goes = _drops(tag, attributes, zone == "article")
        drop = dropped or goes and m.start() not in around
        role = re.search(r"""\brole\s*=\s*["']?(main|article)\b""", attributes, re.I)
        inner = "article" if tag == "article" or role and role[1].lower() == "article" or zone == "article" else "main" if tag == "main" or role or zone == "main" else "open"
        if tag in _RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            if not drop:
                words.append(_html.unescape(html[at : close.start() if close else end]))
            at = close.end() if close else end
            continue
        hidden = bool(places and places[-1][2]) or goes and (tag in _UNSEEN or bool(_HIDDEN.search(attributes)))
        body = None
        if inner != "open" and inner != zone and not goes:
            body = [inner, [x[0] for x in places], drop, 0, hidden, m.start()]
            bodies.append(body)
        stack.append((tag, drop, inner))
        places.append((m.start(), body, hidden))
    if not (stack and stack[-1][1]):
        flush(stack[-1][2] if stack else "open")
    return out, bodies


def candidate_lines(html: str) -> tuple[bool, list[str]]:
    """Whether they are an article's, and the lines that may be the main text."""
    found = lines(html)
    for zone in ("article", "main"):
        own = [t for z, t in found if z == zone or zone == "main" and z == "article"]
        if own:
            return True, own
    return False, [t for _, t in found]


#: Pairs of equal lines, for each line, up to which they are gone through one by one.
PAIRS_A_LINE = 32


def _lengths(a: list, b: list) -> np.ndarray:
    """The lengths of longest common subsequences of ``a`` and each beginning of ``b``, by words of bits: a line of ``a`` is one step for all places of ``b``."""
    at: dict = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    whole = row = (1 << len(b)) - 1
    for x in a:
        hit = row & at.get(x, 0)
        row = (row + hit | row - hit) & whole
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), count=len(b), bitorder="little")
    return np.concatenate([[0], np.cumsum(bits == 0)])


def _by_halves(a: list, b: list) -> list[int]:
    """The places in ``a`` of a longest common subsequence, in space that grows with the lines: where ``b`` is best cut for the halves of ``a``, and so on."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        s, e, t, f = todo.pop()
        if e - s == 0 or f - t == 0:
            continue
        if e - s == 1:
            if a[s] in b[t:f]:
                out.append(s)
            continue
        mid = (s + e) // 2
        cut = t + int(np.argmax(_lengths(a[s:mid], b[t:f]) + _lengths(a[mid:e][::-1], b[t:f][::-1])[::-1]))
        todo += [(s, mid, t, cut), (mid, e, cut, f)]
    return out


def common_subsequence(a: list, b: list) -> set[int]:
    """The places in ``a`` of a longest common subsequence of both: by pairs of equal lines if these are few, else by halves (``_by_halves``), so that lines repeated throughout a long page don't multiply."""
    start, end = 0, 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    out = {*range(start), *range(len(a) - end, len(a))}
    places: dict = {}
    for j in range(start, len(b) - end):
        places.setdefault(b[j], []).append(j)
    own, other = a[start : len(a) - end], b[start : len(b) - end]
    if sum(len(places.get(x, ())) for x in own) > PAIRS_A_LINE * (len(own) + len(other)):
        return out | {start + i for i in _by_halves(own, other)}
    tails: list[int] = []
    links: list[tuple] = []
    for i in range(start, len(a) - end):
        for j in reversed(places.get(a[i], ())):
            k = bisect_left(tails, j)
            link = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(link)
            else:
                tails[k], links[k] = j, link
    link = links[-1] if links else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def shared_lines(own: list, neighbours: list[list], article: bool = False) -> set[int]:
    """The places of the lines that a neighbour shares. A neighbour that shares more than half of an article is another copy of it and doesn't count."""
    found = [common_subsequence(own, other) for other in neighbours if other and other != own]
    gone = set().union(*(f for f in found if not article or 2 * len(f) <= len(own)))
    return set() if len(gone) == len(own) and not article else gone


def _sources(pages: DataFrame) -> DataFrame:
    url = F.col("url").cast("string")
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select("page_id", url.alias("url"), body.alias("_body"), F.coalesce(host, F.lit("")).alias("_host"), F.coalesce(path, F.lit("")).alias("_path"), F.xxhash64("page_id", url, body).alias("_row"))


def deletions(src: DataFrame) -> DataFrame:
    """_row, _gone (places of lines): what differencing deletes, for the pages where it deletes something."""
    def hashed(batches):
        for b in batches:
            read = [candidate_lines(body) for body in b.column(3).to_pylist()]
            own = [[_hash(x) for x in found] for _, found in read]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([a for a, _ in read], pa.bool_()), pa.array(own, pa.list_(pa.int64()))], ["_host", "_path", "_row", "_article", "_lines"])

    fields = "_host string, _path string, _row long, _article boolean, _lines array<long>"
    order = ["_host", "_path", "_row"]
    light = written(src.where("_host <> ''").select(*order, "_body").mapInArrow(hashed, fields).where("size(_lines) > 0"), "page_lines")
    ranges = light.repartitionByRange(shuffle_partitions(src.sparkSession), *order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    ranges = written(ranges, "page_ranges")
    halo = src.sparkSession.createDataFrame(_beside(_ends(ranges, order)), "_to int, _range int, _row long")
    sent = ranges.join(F.broadcast(halo), ["_range", "_row"]).select(*order, "_article", "_lines", F.col("_to").alias("_range"), F.lit(False).alias("_own"))
    both = ranges.withColumn("_own", F.lit(True)).unionByName(sent.dropDuplicates(["_range", "_row"]))
    dealt = both.repartition(shuffle_partitions(src.sparkSession), "_range").sortWithinPartitions("_range", *order)

    def compared(batches):
        before, run, rows = None, None, []  # runs of pages with equal lines: (range, host, lines)

        def settled(after):
            near = [x[2] for x in (before, after) if x is not None and x[:2] == run[:2]]
            gone = {article: sorted(shared_lines(run[2], near, article)) for article in {a for _, a in rows}}
            return [(row, run[1], article, len(run[2]), [{"place": i, "line": run[2][i]} for i in gone[article]]) for row, article in rows if gone[article]]

        def out(found):
            names, kinds = ["_row", "_host", "_article", "_n", "_gone"], [pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.struct([("place", pa.int64()), ("line", pa.int64())]))]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)], names)

        for b in batches:
            found = []
            for x in b.to_pylist():
                page = x["_range"], x["_host"], x["_lines"]
                if page != run:
                    if run is not None:
                        found += settled(page)
                    before, run, rows = run, page, []
                if x["_own"]:
                    rows.append((x["_row"], x["_article"]))
            yield out(found)
        if run is not None:
            yield out(settled(None))

    shared = dealt.mapInArrow(compared, "_row long, _host string, _article boolean, _n long, _gone array<struct<place:long,line:long>>")
    shared = written(shared.groupBy("_row").agg(F.first(F.struct("_host", "_article", "_n", "_gone")).alias("s")).select("_row", "s.*"), "shared_lines")
    line = shared.where("_article").select("_row", "_host", "_n", F.explode("_gone").alias("g")).select("_row", "_host", "_n", "g.place", "g.line")
    kept = line.join(_site_lines(light, line.select("_host", "line").distinct()), ["_host", "line"], "left_semi").groupBy("_row", "_n").agg(F.sort_array(F.collect_list("place")).alias("_gone")).where("size(_gone) < _n").select("_row", "_gone")
    return shared.where("not _article").select("_row", F.transform("_gone", lambda g: g["place"]).alias("_gone")).unionByName(kept)


def _site_lines(light: DataFrame, asked: DataFrame) -> DataFrame:
    """Of the lines (_host, line) that are asked for, those of the site: on at least half of its pages with lines, and on three (copies count as one page)."""
    pages = light.join(asked.select("_host").distinct(), "_host", "left_semi").groupBy("_host", F.xxhash64("_lines").alias("_sig")).agg(F.first("_lines").alias("_lines"))
    on = pages.select("_host", F.explode(F.array_distinct("_lines")).alias("line")).join(asked, ["_host", "line"], "left_semi").groupBy("_host", "line").agg(F.count("*").alias("_on"))
    return on.join(pages.groupBy("_host").agg(F.count("*").alias("_pages")), "_host").where("_on >= 3 and 2 * _on >= _pages").select("_host", "line")


def _ends(ranges: DataFrame, order: list[str]) -> list[tuple]:
    """(range, first, second, last but one, last) by range: pages (host, hash of lines, _row) of the range's outer runs of equal pages; the inner two may be null."""
    page = F.struct(*order, F.xxhash64("_lines").alias("sig"))
    slim = ranges.select("_range", page.alias("p"))
    outer = slim.groupBy("_range").agg(F.min("p").alias("first"), F.max("p").alias("last"))
    other = lambda c: F.when((F.col("p._host") != F.col(f"{c}._host")) | (F.col("p.sig") != F.col(f"{c}.sig")), F.col("p"))
    inner = slim.join(F.broadcast(outer), "_range").groupBy("_range").agg(F.min(other("first")).alias("second"), F.max(other("last")).alias("before"))
    rows = outer.join(inner, "_range").collect()  # a row for each range
    return sorted((r["_range"], *(x and (x["_host"], x["sig"], x["_row"]) for x in (r["first"], r["second"], r["before"], r["last"]))) for r in rows)


def _beside(ends: list[tuple]) -> list[tuple[int, int, int]]:
    """(range, range that has the page, _row): the nearest pages with other lines than a range's first page, before it, and than its last, after it."""
    out = []
    for step in (1, -1):
        for i, (to, *edges) in enumerate(ends):
            edge = edges[-1 if step > 0 else 0]
            for at, *far in ends[i + 1 :] if step > 0 else ends[:i][::-1]:
                near, inner = (far[0], far[1]) if step > 0 else (far[3], far[2])
                if near[:2] == edge[:2] and inner is None:
                    continue  # the whole range is of the same lines
                found = inner if near[:2] == edge[:2] else near
                if found[0] == edge[0]:
                    out.append((to, at, found[2]))
                break
    return out


#: Rows of deletions (some hundred bytes each) up to which they are broadcast; beyond it, the join shuffles.
BROADCAST_ROWS = 20_000


def main_text(pages: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    kind = pages.schema["page_id"].dataType.simpleString()
    src = _sources(pages)
    gone = written(deletions(src), "deletions")
    if gone.limit(broadcast_rows + 1).count() <= broadcast_rows:
        gone = F.broadcast(gone)

    def run(batches):
        for b in batches:
            texts = []
            for body, places in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                found = candidate_lines(body)[1]
                drop = set(places or ())
                texts.append("\n\n".join(x for i, x in enumerate(found) if i not in drop))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = src.join(gone, "_row", "left").select("page_id", "url", "_body", "_gone")
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
