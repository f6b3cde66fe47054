"""The registered queries of this subpackage: thin calls of its operators on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .shared import text_batches


def _tables(spark: SparkSession, sf_dir: str):
    text_batches(spark)
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from .bpe import digests

    return digests(_tables(spark, sf_dir)("documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def op1_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pagediff import main_text

    return main_text(_tables(spark, sf_dir)("pages"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixdedup import digests

    return digests(_tables(spark, sf_dir)("documents"))


def op3_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vafile import top_k

    return top_k(_tables(spark, sf_dir)("embeddings"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import link_documents

    return link_documents(_tables(spark, sf_dir)("documents"), words=3, percent=90)


def op5_pairwise_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranking import classify

    t = _tables(spark, sf_dir)
    return classify(t("documents"), t("labels"))


def op6_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order 3 with all counts; each document is judged by the counts of the others, which is where runs are backed off."""
    from .backoff import scores

    return scores(_tables(spark, sf_dir)("documents"), own_out=True).select("doc_id", "n_words", "n_backoff", "log_score")


def op6_stupid_backoff_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with each document's own occurrences counted, so that every run is found."""
    from .backoff import scores

    return scores(_tables(spark, sf_dir)("documents")).select("doc_id", "n_words", "n_backoff", "log_score")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive

    return archive(_tables(spark, sf_dir)("pages"))


def op9_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .positional import digests

    t = _tables(spark, sf_dir)
    return digests(t("documents"), t("benchmark"))


def op10_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from .wavelet import digests

    return digests(_tables(spark, sf_dir)("documents"), P.path("byte_bpe_50k.json"), P.PATTERN)


def op11_accumulator_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked import rank

    t = _tables(spark, sf_dir)
    return rank(t("documents"), t("benchmark"))


def op12_lockstep_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from .alignment import digests

    return digests(_tables(spark, sf_dir)("documents"), P.path("byte_bpe_50k.json"), P.PATTERN, P.path("piece_bpe_32k.model"))


def op13_viterbi_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import predict

    return predict(_tables(spark, sf_dir)("documents"))


_OP3 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(r.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

_OP4 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, k, k + 2) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 90 * (p.n + q.n - o)),
r(doc_id, node) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.node = l.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.node) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id, n.n
"""

_OP6 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS m, CASE WHEN k > 2 THEN w[k - 2] END AS z, CASE WHEN k > 1 THEN w[k - 1] END AS a, w[k] AS b FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d)),
own1 AS (SELECT doc_id, b, count(*) AS n FROM p GROUP BY ALL), own2 AS (SELECT doc_id, a, b, count(*) AS n FROM p WHERE a IS NOT NULL GROUP BY ALL), own3 AS (SELECT doc_id, z, a, b, count(*) AS n FROM p WHERE z IS NOT NULL GROUP BY ALL),
left1 AS (SELECT doc_id, b, sum(n) OVER (PARTITION BY b) - n AS c FROM own1), left2 AS (SELECT doc_id, a, b, sum(n) OVER (PARTITION BY a, b) - n AS c FROM own2), left3 AS (SELECT doc_id, z, a, b, sum(n) OVER (PARTITION BY z, a, b) - n AS c FROM own3),
s AS (SELECT p.doc_id, p.a IS NOT NULL AND coalesce(t.c, 0) = 0 AND (p.z IS NOT NULL OR coalesce(g.c, 0) = 0) AS back,
  CASE WHEN t.c > 0 THEN ln(t.c / h.c) ELSE CASE WHEN p.z IS NOT NULL THEN ln(0.4) ELSE 0 END
    + CASE WHEN g.c > 0 THEN ln(g.c / u.c) ELSE CASE WHEN p.a IS NOT NULL THEN ln(0.4) ELSE 0 END + ln(greatest(v.c, 1) / greatest((SELECT count(*) FROM p) - p.m, 1)) END END AS s
  FROM p LEFT JOIN left3 t ON p.doc_id = t.doc_id AND p.z = t.z AND p.a = t.a AND p.b = t.b LEFT JOIN left2 h ON p.doc_id = h.doc_id AND p.z = h.a AND p.a = h.b
  LEFT JOIN left2 g ON p.doc_id = g.doc_id AND p.a = g.a AND p.b = g.b LEFT JOIN left1 u ON p.doc_id = u.doc_id AND p.a = u.b JOIN left1 v ON p.doc_id = v.doc_id AND p.b = v.b)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(t.n, 0) AS BIGINT) AS n_backoff, coalesce(t.s, 0.0) AS log_score
FROM d LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE back) AS n, round(sum(s), 6) AS s FROM s GROUP BY doc_id) t USING (doc_id)
"""

_OP6_TRIGRAMS = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, CASE WHEN k > 2 THEN w[k - 2] END AS z, CASE WHEN k > 1 THEN w[k - 1] END AS a, w[k] AS b FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d)),
one AS (SELECT b AS x, count(*) AS c1 FROM p GROUP BY b),
two AS (SELECT a, b, count(*) AS c2 FROM p WHERE a IS NOT NULL GROUP BY a, b),
three AS (SELECT z, a, b, count(*) AS c3 FROM p WHERE z IS NOT NULL GROUP BY z, a, b),
s AS (SELECT p.doc_id, p.z IS NOT NULL AND c3 IS NULL OR p.a IS NOT NULL AND two.c2 IS NULL AS back,
  CASE WHEN c3 IS NOT NULL THEN ln(c3 / h.c2) ELSE CASE WHEN p.z IS NOT NULL THEN ln(0.4) ELSE 0 END
    + CASE WHEN two.c2 IS NOT NULL THEN ln(two.c2 / u.c1) ELSE ln(v.c1 / (SELECT sum(c1) FROM one)) + CASE WHEN p.a IS NOT NULL THEN ln(0.4) ELSE 0 END END END AS s
  FROM p LEFT JOIN three ON p.z = three.z AND p.a = three.a AND p.b = three.b LEFT JOIN two h ON p.z = h.a AND p.a = h.b LEFT JOIN two ON p.a = two.a AND p.b = two.b
  LEFT JOIN one u ON u.x = p.a JOIN one v ON v.x = p.b)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(any_value(t.n), 0) AS BIGINT) AS n_backoff, coalesce(any_value(t.s), 0.0) AS log_score
FROM d LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE back) AS n, round(sum(s), 6) AS s FROM s GROUP BY doc_id) t USING (doc_id) GROUP BY d.doc_id, d.w
"""

_OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS first, count(*) AS n FROM p WHERE strlen(h) >= 1000 GROUP BY h HAVING count(*) > 1)
SELECT p.page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN g.first IS NOT NULL AND p.page_id IS DISTINCT FROM g.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN g.first IS NOT NULL AND p.page_id IS DISTINCT FROM g.first THEN g.first END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h
"""


_OP9 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, k, k + least(len(w), 10) - 1) AS terms
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
runs AS (SELECT doc_id, n, k, list_slice(w, k, k + n - 1) AS terms
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT r.doc_id, r.k, r.n, win.item_id FROM runs r JOIN win ON r.n = win.n AND r.terms = win.terms),
covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS at FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP11 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
a AS (SELECT CAST(count(*) FILTER (WHERE len(w) > 0) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d),
t AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, a GROUP BY term, docs),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms))))) AS BIGINT) AS score FROM q JOIN t USING (term) JOIN f USING (term), a GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op3_va_file": _OP3, "op4_ngram_jaccard": _OP4, "op6_stupid_backoff": _OP6, "op6_stupid_backoff_trigrams": _OP6_TRIGRAMS, "op7_warc": _OP7, "op9_positional_index": _OP9, "op11_accumulator_search": _OP11}
