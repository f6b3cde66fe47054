"""The driver's tables seen as documents, proposals, requests and timings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATHS = ["/returnflag", "/linestatus", "/quantity"]


def proposals(t, lines: DataFrame | None = None) -> DataFrame:
    """Each line of an order (``lines``: as they are dealt) as a section of a document that proposes three fields."""
    lines = t.lineitem if lines is None else lines
    fields = F.array(*(F.struct(F.lit(p).alias("path"), v.alias("value")) for p, v in zip(PATHS, (F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_quantity").cast("long").cast("string")))))
    confidence = F.round(F.greatest(F.lit(0.0), F.lit(1.0) - F.col("l_discount") * 5), 4)
    rows = lines.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("section"), confidence.alias("confidence"), F.col("l_shipdate").alias("extracted_at"), F.explode(fields).alias("f"))
    return rows.select("document_id", "section", "f.path", "f.value", "confidence", "extracted_at")


#: The same in SQL.
PROPOSALS = """p AS (SELECT l_orderkey AS document_id, l_linenumber AS section, f.path AS path, f.value AS value, confidence, extracted_at FROM
  (SELECT l_orderkey, l_linenumber, round(greatest(0.0, 1.0 - l_discount * 5), 4) AS confidence, l_shipdate AS extracted_at,
   unnest([{'path': '/returnflag', 'value': l_returnflag}, {'path': '/linestatus', 'value': l_linestatus}, {'path': '/quantity', 'value': CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)}]) AS f FROM lineitem))"""
MERGED = PROPOSALS + """, r AS (SELECT *, row_number() OVER (PARTITION BY document_id, path ORDER BY confidence DESC, section, value) AS k FROM p),
m AS (SELECT document_id, path, max(value) FILTER (WHERE k = 1) AS value, CASE WHEN count(DISTINCT value) > 1 THEN least(max(confidence) FILTER (WHERE k = 1), 0.5) ELSE max(confidence) FILTER (WHERE k = 1) END AS confidence,
  count(*) AS n_proposals, count(DISTINCT value) > 1 AS is_conflict FROM r GROUP BY document_id, path)"""


def fields(t) -> DataFrame:
    """Merged fields, dealt by document. Lines are dealt, not their proposals: a third of the rows, and counted from the files alone, so that tasks grow in number with them."""
    from recordloom.operators.extraction import merged_proposals
    from recordloom.operators.tables import dealt

    return merged_proposals(proposals(t, dealt(t.lineitem, ["l_orderkey"])), ["document_id", "path"], ["section"])


def bronze(t, run_date: str = "2024-01-31") -> DataFrame:
    from recordloom.operators.tables import bronze_rows

    d = t.documents.select(F.col("doc_id").cast("string").alias("document_id"), F.concat("source", F.lit("/"), "doc_id").alias("filename"), F.sha2("text", 256).alias("content_hash"), F.when(F.col("lang") == "en", "text/plain").when(F.col("lang") == "de", "text/csv").otherwise("text/html").alias("mime"), F.octet_length("text").cast("long").alias("size_bytes"), F.col("doc_id").cast("long").alias("kafka_offset"), F.col("source").alias("source_system"))
    return bronze_rows(d, run_date)


BRONZE = """b AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, source || '/' || doc_id AS filename, sha256(text) AS content_hash,
  CASE lang WHEN 'en' THEN 'text/plain' WHEN 'de' THEN 'text/csv' ELSE 'text/html' END AS mime, CAST(strlen(text) AS BIGINT) AS size_bytes, source || '/' || doc_id AS s3_key, 'unknown' AS schema_name, CAST(1 AS BIGINT) AS schema_version, '2024-01-31' AS ingest_date, source AS source_system, CAST(doc_id AS BIGINT) AS kafka_offset FROM documents)"""


def timings(t) -> DataFrame:
    """Orders as timed work on documents."""
    o = t.orders
    arm = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "tool").when(F.col("o_orderpriority") == "5-LOW", None).otherwise("manual")
    return o.select(F.col("o_custkey").alias("document_id"), F.when(F.col("o_custkey") % 7 != 0, F.concat(F.lit("p"), F.col("o_custkey") % 7)).alias("participant"), arm.alias("arm"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("finished_at"), F.round(F.col("o_totalprice") / 100).cast("long").alias("active_seconds"), (F.col("o_totalprice") / 600000).alias("accuracy"))


TIMINGS = """t AS (SELECT o_custkey AS document_id, CASE WHEN o_custkey % 7 <> 0 THEN 'p' || (o_custkey % 7) END AS participant,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'tool' WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'manual' END AS arm,
  CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS finished_at, CAST(round(o_totalprice / 100) AS BIGINT) AS active_seconds, o_totalprice / 600000 AS accuracy FROM orders)"""


def requests(t) -> DataFrame:
    from recordloom.operators.extraction import estimated_tokens

    tokens = estimated_tokens(F.col("n_chars"), 500)
    return t.documents.select(F.col("doc_id").alias("request_id"), tokens.alias("tokens"), F.round(tokens * 3e-6, 6).alias("cost"))


REQUESTS = "q AS (SELECT doc_id AS request_id, n_chars // 4 + 500 AS tokens, round((n_chars // 4 + 500) * 3e-6, 6) AS cost FROM documents)"


#: Customers in a CSV text at most: files grow in number, not in size.
ROWS_A_FILE = 1000
FILE = f"c_nationkey || '-' || c_custkey // {ROWS_A_FILE}"


def grids(t) -> DataFrame:
    """Customers of each nation as untidy CSV texts: a preamble, a header with a blank and a repeated name, quoted cells, a total at the end, a delimiter by nation."""
    delimiter = F.element_at(F.array(*map(F.lit, [",", ";", "\t", "|"])), (F.col("c_nationkey") % 4 + 1).cast("int"))
    cells = F.array(F.col("c_custkey").cast("string"), F.concat(F.lit('"'), F.regexp_replace("c_name", "#", '""'), F.lit("\n"), F.col("c_mktsegment"), F.lit('"')), F.format_string("%.2f", "c_acctbal"), F.when(F.col("c_acctbal") < 0, "N/A").otherwise("yes"))
    name = F.concat_ws("-", "c_nationkey", F.floor(F.col("c_custkey") / ROWS_A_FILE))
    rows = t.customer.select(name.alias("document_id"), "c_custkey", F.array_join(cells, "\x01").alias("row"), delimiter.alias("d"))
    g = rows.groupBy("document_id", "d").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "row"))), lambda s: s["row"]), "\n").alias("body"))
    head = F.lit("customers of a nation\n\nid\x01name\x01\x01name\n")
    text = F.concat(head, F.col("body"), F.lit("\nTotal\x01\x01\x01\n"))
    return g.select("document_id", F.replace(text, F.lit("\x01"), F.col("d")).alias("text"))


def sheets(t) -> DataFrame:
    """Suppliers of each nation as CSV texts with a header of two rows and rows that are too short or too long; every fifth nation's last quote stays open."""
    rows = t.supplier.select("s_nationkey", "s_suppkey", F.concat_ws(";", (F.col("s_suppkey") + 100).cast("string"), F.format_string("%.2f", "s_acctbal"), F.when(F.col("s_suppkey") % 3 != 0, F.lit("ok")), F.when(F.col("s_suppkey") % 3 == 1, F.lit("more"))).alias("row"))
    body = rows.groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "row"))), lambda s: s["row"]), "\n").alias("body"))
    return body.select(F.concat(F.lit("s"), "s_nationkey").alias("document_id"), F.concat(F.lit("key;amount;note\nnumber;in USD;\n"), "body", F.when(F.col("s_nationkey") % 5 == 0, '\n"').otherwise("\n")).alias("text"))
