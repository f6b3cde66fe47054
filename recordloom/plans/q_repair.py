"""Queries of CSV repair on texts written from the customers of each nation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions import values
from recordloom.operators import csvrepair
from recordloom.plans.mapping import FILE, grids, sheets
from recordloom.plans.registry import query
from recordloom.session import scratch


@query(f"""SELECT {FILE} AS document_id, CASE any_value(c_nationkey) % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) ELSE '|' END AS delimiter FROM customer GROUP BY 1""")
def csv_delimiters(t) -> DataFrame:
    return csvrepair.delimiters(grids(t))


@query(f"""SELECT {FILE} AS document_id, row_number() OVER (PARTITION BY {FILE} ORDER BY c_custkey) - 1 AS row_no, CAST(c_custkey AS VARCHAR) AS id, replace(c_name, '#', '"') || chr(10) || c_mktsegment AS name FROM customer""")
def csv_cells(t) -> DataFrame:
    cells = csvrepair.repaired(grids(t), strict_header=True)["cells"]
    return cells.groupBy("document_id", "row_no").agg(F.max(F.when(F.col("col_no") == 0, F.col("value"))).alias("id"), F.max(F.when(F.col("col_no") == 1, F.col("value"))).alias("name"))


@query(f"""WITH f AS (SELECT {FILE} AS document_id, count(*) FILTER (WHERE c_acctbal < 0) AS nulls, count(*) FILTER (WHERE c_acctbal >= 0) AS words FROM customer GROUP BY 1)
SELECT document_id, x.col_no, x.name, CASE x.col_no WHEN 0 THEN 'integer' WHEN 1 THEN 'string' WHEN 2 THEN 'float' ELSE CASE WHEN words > 0 THEN 'boolean' ELSE 'null' END END AS inferred_type, CASE WHEN x.col_no = 3 THEN nulls ELSE 0 END AS null_count
FROM f, (VALUES (0, 'id'), (1, 'name'), (2, 'column_3'), (3, 'name_1')) x(col_no, name)""")
def csv_columns(t) -> DataFrame:
    return csvrepair.repaired(grids(t), strict_header=True)["columns"].select("document_id", "col_no", "name", "inferred_type", "null_count")


@query(f"""SELECT {FILE} AS document_id, count(*) + 3 AS total_raw_rows, 1 AS n_preamble, count(*) AS n_rows, 1 AS n_trailing FROM customer GROUP BY 1""")
def csv_summary(t) -> DataFrame:
    s = csvrepair.repaired(grids(t), strict_header=True)["summary"]
    return s.select("document_id", "total_raw_rows", "n_preamble", "n_rows", "n_trailing")


@query("SELECT doc_id, CASE lang WHEN 'de' THEN 'latin-1' WHEN 'fr' THEN 'utf-8-sig' WHEN 'es' THEN 'utf-16-le' ELSE 'utf-8' END AS encoding, sha256(lang || ' é ' || doc_id) AS text_sha256 FROM documents")
def csv_decoding(t) -> DataFrame:
    text = F.concat("lang", F.lit(" é "), "doc_id")
    content = F.when(F.col("lang") == "de", F.encode(text, "ISO-8859-1")).when(F.col("lang") == "fr", F.concat(F.lit(b"\xef\xbb\xbf"), F.encode(text, "UTF-8"))).when(F.col("lang") == "es", F.concat(F.lit(b"\xff\xfe"), F.encode(text, "UTF-16LE"))).otherwise(F.encode(text, "UTF-8"))
    return csvrepair.decoded(t.documents.select("doc_id", content.alias("content"))).select("doc_id", "encoding", F.sha2("text", 256).alias("text_sha256"))


@query("""SELECT 's' || s_nationkey AS document_id, x.col_no, x.name, x.type AS inferred_type FROM (SELECT s_nationkey, count(*) FILTER (WHERE s_suppkey % 3 <> 0) AS notes FROM supplier WHERE s_nationkey % 5 <> 0 GROUP BY s_nationkey),
(VALUES (0, 'key number', 'integer'), (1, 'amount in USD', 'float'), (2, 'note', 'string')) x(col_no, name, type) WHERE x.col_no < 2 OR notes > 0 UNION ALL
SELECT 's' || s_nationkey, 2, 'note', 'null' FROM supplier WHERE s_nationkey % 5 <> 0 GROUP BY s_nationkey HAVING count(*) FILTER (WHERE s_suppkey % 3 <> 0) = 0""")
def csv_header_merge(t) -> DataFrame:
    return csvrepair.repaired(sheets(t))["columns"].select("document_id", "col_no", "name", "inferred_type")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier WHERE s_nationkey % 5 <> 0)
SELECT 's' || s_nationkey AS document_id, k - 1 AS row_no, 'Row ' || k || CASE s_suppkey % 3 WHEN 0 THEN ': padded from 2' ELSE ': truncated from 4' END || ' to 3 columns' AS issue FROM r WHERE s_suppkey % 3 <> 2""")
def csv_issues(t) -> DataFrame:
    return csvrepair.repaired(sheets(t))["issues"]


@query("""WITH c AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS row_no FROM customer)
SELECT CAST(row_no AS INTEGER) AS row_no, CAST(c_custkey AS VARCHAR) AS id, 'says "' || c_name || '"' || chr(10) || chr(10) || c_mktsegment || ',' AS remark, printf('%.2f', c_acctbal) AS balance, x.inferred_type FROM c, (SELECT 'float' AS inferred_type) x""")
def csv_parts(t) -> DataFrame:
    """One document in eight files, cut between any two lines, of records of three lines each: all customers, read in splits by all tasks."""
    folder = f"{scratch(t.spark)}/csv/{uuid.uuid4().hex}"
    quoted = F.concat(F.lit('"says ""'), "c_name", F.lit('""'))
    lines = F.array(F.concat(F.col("c_custkey").cast("string"), F.lit(","), quoted), F.lit(""), F.concat("c_mktsegment", F.lit(',",'), F.format_string("%.2f", "c_acctbal")))
    rows = t.customer.select("c_custkey", F.posexplode(lines).alias("k", "value"))
    head = t.spark.createDataFrame([(-1, 0, "id,remark,balance")], "c_custkey long, k int, value string")
    dealt = head.unionByName(rows).repartitionByRange(8, "c_custkey", "k").sortWithinPartitions("c_custkey", "k")
    dealt.select("value").write.text(folder)
    parts = csvrepair.repaired_lines(csvrepair.lines_of_files(t.spark, folder, parts=True), strict_header=True)
    named = {n: F.max(F.when(F.col("column_name") == n, F.col("value"))).alias(n) for n in ("id", "remark", "balance")}
    kind = parts["columns"].where("name = 'balance'").select("document_id", "inferred_type")
    return parts["cells"].groupBy("document_id", "row_no").agg(*named.values()).join(F.broadcast(kind), "document_id").drop("document_id")


@query("SELECT DISTINCT 's' || s_nationkey AS document_id, 'odd_quotes' AS reason FROM supplier WHERE s_nationkey % 5 = 0")
def csv_quarantine(t) -> DataFrame:
    return csvrepair.repaired(sheets(t))["quarantine"]


@query("SELECT s_suppkey + 100.0 AS key_number, s_acctbal AS amount FROM supplier WHERE s_nationkey % 5 <> 0")
def csv_typed_cells(t) -> DataFrame:
    parts = csvrepair.repaired(sheets(t))
    cells = csvrepair.cast_cells(parts["cells"], parts["columns"])
    one = cells.groupBy("document_id", "row_no").agg(F.max(F.when(F.col("column_name") == "key number", F.col("number"))).alias("key_number"), F.max(F.when(F.col("column_name") == "amount in USD", F.col("number"))).alias("amount"))
    return one.select("key_number", "amount")


@query("""SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders WHERE o_orderkey % 6 < 5""")
def coerce_dates(t) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    shapes = ["yyyy-MM-dd", "MM/dd/yyyy", "dd.MM.yyyy", "dd-MMM-yyyy", "MMMM d, yyyy"]
    text = F.lit("no day")
    for k, shape in enumerate(shapes):
        text = F.when(F.col("o_orderkey") % 6 == k, F.date_format(d, shape)).otherwise(text)
    return t.orders.select("o_orderkey", values.to_date(text).cast("string").alias("day")).where("day is not null")
