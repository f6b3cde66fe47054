"""Queries from proposals to committed records, and of layout elements."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions.prefix import stored
from recordloom.functions.values import to_array, to_boolean, to_number
from recordloom.operators import elements, extraction, review, schemas, tables
from recordloom.plans.mapping import MERGED, PROPOSALS, REQUESTS, fields, proposals, requests
from recordloom.plans.registry import query


@query(f"WITH {MERGED} SELECT document_id, path, value, confidence, n_proposals, is_conflict FROM m")
def proposal_merge_conflict(t) -> DataFrame:
    return fields(t).drop("candidates")


@query(f"""WITH {MERGED} SELECT document_id, '{{' || string_agg('"' || path || '":"' || value || '"', ',' ORDER BY path) || '}}' AS record_json, round(avg(confidence), 8) AS quality_score, count(*) AS field_count, count(*) FILTER (WHERE confidence < 0.7) AS low_confidence_count FROM m GROUP BY document_id""")
def gold_conform(t) -> DataFrame:
    return extraction.conformed(fields(t), ["document_id"]).withColumn("quality_score", F.round("quality_score", 8))


@query(f"""WITH {PROPOSALS} SELECT document_id, count(*) AS field_count, round(avg(confidence), 8) AS avg_confidence, CAST(sum(CASE WHEN confidence < 0.7 THEN 1 ELSE 0 END) AS BIGINT) AS low_confidence_count, min(extracted_at) AS first_extracted, max(extracted_at) AS last_extracted, round(sum(section * 0.001), 6) AS total_cost FROM p GROUP BY document_id""")
def gold_stats(t) -> DataFrame:
    f = proposals(t).withColumn("cost", F.col("section") * 0.001)
    return extraction.record_statistics(f, ["document_id"], "extracted_at").withColumn("avg_confidence", F.round("avg_confidence", 8)).withColumn("total_cost", F.round("total_cost", 6))


@query(f"WITH {MERGED} SELECT document_id, path, row_number() OVER (PARTITION BY document_id ORDER BY confidence NULLS FIRST, path) AS position FROM m")
def review_queue(t) -> DataFrame:
    return review.queue(fields(t)).select("document_id", "path", "position")


@query(f"WITH {MERGED} SELECT CASE WHEN coalesce(confidence, 0) >= 0.9 THEN 'high' WHEN coalesce(confidence, 0) >= 0.7 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM m GROUP BY 1")
def confidence_bands(t) -> DataFrame:
    return fields(t).groupBy(review.band(F.col("confidence")).alias("band")).agg(F.count("*").alias("n"))


@query("SELECT p_brand AS name, max(p_size) AS version FROM part GROUP BY p_brand")
def latest_version_per_name(t) -> DataFrame:
    return schemas.latest_per_name(t.part.select(F.col("p_brand").alias("name"), F.col("p_size").alias("version")))


@query("""WITH l AS (SELECT p_brand AS name, max(p_size) AS last FROM part WHERE p_type <> 'ECONOMY' GROUP BY p_brand)
SELECT p.p_brand AS name, p_partkey, coalesce(last, 0) + row_number() OVER (PARTITION BY p.p_brand ORDER BY p_partkey) AS version FROM part p LEFT JOIN l ON l.name = p.p_brand WHERE p_type = 'ECONOMY'""")
def next_version(t) -> DataFrame:
    p = t.part.select(F.col("p_brand").alias("name"), F.col("p_size").cast("long").alias("version"), "p_partkey", "p_type")
    return schemas.registered(p.where("p_type <> 'ECONOMY'"), p.where("p_type = 'ECONOMY'").select("name", "p_partkey"), "p_partkey").select("name", "p_partkey", "version")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE CASE p_partkey % 5 WHEN 1 THEN CAST(p_retailprice AS DOUBLE) WHEN 3 THEN p_size / 100.0 ELSE p_size * 1000.0 + 1 END END AS number,
CASE WHEN p_size % 2 = 0 THEN true WHEN p_size % 3 = 0 THEN false END AS flag FROM part""")
def coerce_values(t) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 5 == 4, F.concat(F.col("p_size").cast("string"), F.lit("d"))).when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("$"), F.col("p_retailprice").cast("string"))).when(F.col("p_partkey") % 5 == 3, F.concat(F.col("p_size").cast("string"), F.lit(" %"))).otherwise(F.concat(F.lit("€ "), F.col("p_size").cast("string"), F.lit(",001")))
    word = F.when(F.col("p_size") % 2 == 0, " Yes").when(F.col("p_size") % 3 == 0, "N ").otherwise("maybe")
    return t.part.select("p_partkey", to_number(raw).alias("number"), to_boolean(word).alias("flag"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN [CAST(user_id AS VARCHAR), event_type] ELSE [event_type] END AS items FROM events")
def coerce_arrays(t) -> DataFrame:
    raw = F.when(F.col("event_id") % 2 == 0, F.format_string('["%s","%s"]', F.col("user_id").cast("string"), "event_type")).otherwise(F.col("event_type"))
    return t.events.select("event_id", to_array(raw).alias("items"))


_SCHEMA = '{"properties":{"returnflag":{"type":"string","enum":["A","R"]},"linestatus":{"type":"string","maxLength":1},"quantity":{"type":"integer","minimum":5,"maximum":45},"shipmode":{"type":"string"}},"required":["returnflag","quantity","shipmode"],"additionalProperties":false}'


def _props(t) -> DataFrame:
    return F.broadcast(schemas.properties(t.spark.createDataFrame([("line", 1, _SCHEMA)], "name string, version long, body string")))


def _documents(t) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderstatus") == "P", "extracting").otherwise("review").alias("state"), F.lit("line").alias("schema_name"), F.lit(1).cast("long").alias("schema_version"))


@query(f"WITH {MERGED}, e AS (SELECT document_id, path, CASE WHEN path IN ('/returnflag', '/linestatus') OR regexp_matches(value, '^[0-9]+$') THEN CASE WHEN path = '/returnflag' AND value NOT IN ('A', 'R') THEN 'enum' WHEN path = '/quantity' AND TRY_CAST(value AS BIGINT) < 5 THEN 'minimum' WHEN path = '/quantity' AND TRY_CAST(value AS BIGINT) > 45 THEN 'maximum' END END AS keyword FROM m) SELECT document_id, path, keyword FROM e WHERE keyword IS NOT NULL")
def field_validation(t) -> DataFrame:
    f = fields(t).withColumn("schema_name", F.lit("line")).withColumn("schema_version", F.lit(1).cast("long"))
    return schemas.field_errors(f, _props(t)).select("document_id", "path", "keyword")


@query(f"WITH {MERGED} SELECT o_orderkey AS document_id, x.path, CASE WHEN m.path IS NULL THEN 'missing' WHEN m.confidence < 0.9 THEN 'unverified' ELSE 'ok' END AS status FROM orders, (VALUES ('/returnflag'), ('/quantity'), ('/shipmode')) x(path) LEFT JOIN m ON m.document_id = o_orderkey AND m.path = x.path")
def required_coverage(t) -> DataFrame:
    f = fields(t).withColumn("verified", F.col("confidence") >= 0.9)
    return review.coverage(_documents(t), f, _props(t))


@query(f"""WITH {MERGED}, d AS (SELECT o_orderkey AS document_id, CASE o_orderstatus WHEN 'P' THEN 'extracting' ELSE 'review' END AS state FROM orders),
c AS (SELECT d.document_id, x.path, CASE WHEN m.path IS NULL THEN 'missing_required' WHEN m.confidence < 0.9 THEN 'unverified_required' END AS error FROM d, (VALUES ('/returnflag'), ('/quantity'), ('/shipmode')) x(path) LEFT JOIN m ON m.document_id = d.document_id AND m.path = x.path),
s AS (SELECT m.document_id, m.path, CASE WHEN path = '/returnflag' AND value NOT IN ('A', 'R') THEN 1 WHEN path = '/quantity' AND (TRY_CAST(value AS BIGINT) < 5 OR TRY_CAST(value AS BIGINT) > 45) THEN 1 END AS bad FROM m JOIN d USING (document_id)),
e AS (SELECT document_id, 'invalid_state' AS error FROM d WHERE state <> 'review' UNION ALL SELECT document_id, error FROM c WHERE error IS NOT NULL UNION ALL SELECT document_id, 'validation_error' FROM m WHERE is_conflict UNION ALL SELECT document_id, 'schema_validation' FROM s WHERE bad = 1)
SELECT error, count(*) AS n, count(DISTINCT document_id) AS documents FROM e GROUP BY error""")
def commit_gate(t) -> DataFrame:
    m = fields(t).select("document_id", "path", "value", F.when(F.col("is_conflict"), "conflict").alias("validation_error"), (F.col("confidence") >= 0.9).alias("verified"))
    errors = review.gate_errors(_documents(t), m, _props(t))
    return errors.groupBy("error").agg(F.count("*").alias("n"), F.count_distinct("document_id").alias("documents"))


@query(f"""WITH {MERGED}, bad AS (SELECT DISTINCT document_id FROM m WHERE is_conflict) SELECT o_orderkey AS document_id FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey NOT IN (SELECT document_id FROM bad)""")
def committable(t) -> DataFrame:
    d = _documents(t)
    errors = fields(t).where("is_conflict").select("document_id").unionByName(d.where("state <> 'review'").select("document_id"))
    return review.committable(d, errors).select("document_id")


@query(f"""WITH {MERGED}, c AS (SELECT l_orderkey AS document_id, '/quantity' AS path, max(l_linenumber) AS at FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
SELECT m.document_id, m.path, CASE WHEN c.at IS NOT NULL THEN CAST(c.at AS VARCHAR) ELSE m.value END AS value, CASE WHEN c.at IS NOT NULL THEN m.value END AS corrected_from FROM m LEFT JOIN c USING (document_id, path)""")
def correction_upsert(t) -> DataFrame:
    c = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("document_id"), F.lit("/quantity").alias("path"), F.col("l_linenumber").cast("string").alias("new_value"), F.lit("someone").alias("corrected_by"), F.col("l_linenumber").alias("corrected_at"))
    return review.corrected(fields(t).drop("candidates"), c).select("document_id", "path", "value", "corrected_from")


@query("""SELECT c_nationkey AS document_id, c_custkey AS part_number, CASE WHEN o.o_custkey IS NOT NULL THEN 'completed' ELSE 'missing' END AS status FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') o ON o.o_custkey = c_custkey""")
def parts_missing(t) -> DataFrame:
    plan = t.customer.select(F.col("c_nationkey").alias("document_id"), F.col("c_custkey").alias("part_number"))
    stored = t.orders.where("o_orderstatus = 'F'").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("document_id"), F.col("c_custkey").alias("part_number"))
    return review.upload_parts(plan, stored)


@query("""SELECT c_custkey AS document_id, '{"_metadata":{"document_id":' || c_custkey || ',"schema_name":"party","schema_version":1},"data":{"address":{"nation":"' || n_name || '","segment":"' || c_mktsegment || '"},"name":"' || c_name || '"}}' AS line FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 0""")
def export_lines(t) -> DataFrame:
    c = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    docs = c.select(F.col("c_custkey").alias("document_id"), F.lit("party").alias("schema_name"), F.lit(1).alias("schema_version"), F.when(F.col("c_acctbal") >= 0, "committed").otherwise("review").alias("state"))
    f = c.select(F.col("c_custkey").alias("document_id"), F.explode(F.create_map(F.lit("/name"), F.col("c_name"), F.lit("/address/segment"), F.col("c_mktsegment"), F.lit("/address/nation"), F.col("n_name"))).alias("path", "value"))
    return review.exported(docs, f)


@query("SELECT event_id, '/k' AS path, CAST(json_extract(props, '$.k') AS VARCHAR) AS value, 0.5 AS confidence FROM events UNION ALL SELECT event_id, '/total', CAST(CAST(floor(value) AS INTEGER) AS VARCHAR), 0.25 FROM events")
def response_parse(t) -> DataFrame:
    answer = F.concat(F.regexp_replace("props", "\\}$", ""), F.format_string(', "total": {"value": %d, "confidence": 0.25, "source_text": "x"}}', F.floor("value").cast("int")))
    return extraction.parsed_answers(t.events.select("event_id", answer.alias("answer"))).select("event_id", "path", "value", "confidence")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'not_json' ELSE 'not_an_object' END AS reason FROM events WHERE event_type IN ('error', 'view')")
def response_quarantine(t) -> DataFrame:
    answer = F.when(F.col("event_type") == "error", F.concat(F.lit("x"), "props")).when(F.col("event_type") == "view", "[1]").otherwise(F.col("props"))
    return extraction.failed_answers(t.events.select("event_id", answer.alias("answer"))).select("event_id", "reason")


@query("SELECT l_orderkey || ':' || f.path AS field_id, l_orderkey AS document_id, f.path AS path, f.value AS value FROM (SELECT l_orderkey, unnest([{'path': '/flag', 'value': l_returnflag}, {'path': '/none', 'value': NULL}]) AS f FROM lineitem)")
def silver_flatten(t) -> DataFrame:
    field = lambda p, v: F.struct(F.lit(p).alias("path"), v.alias("value"), F.lit(0.5).alias("confidence"), F.lit(None).cast("struct<x0:double,y0:double>").alias("bbox"))
    r = t.lineitem.select(F.col("l_orderkey").alias("document_id"), F.array(field("/flag", F.col("l_returnflag")), field("/none", F.lit(None).cast("string"))).alias("fields"))
    return extraction.flattened(r).select("field_id", "document_id", "path", "value")


@query("SELECT d.doc_id, d.doc_id <> f.first AS deduplicated, f.first AS existing FROM documents d JOIN (SELECT text, min(doc_id) AS first FROM documents GROUP BY text) f ON f.text = d.text")
def content_hash_lookup(t) -> DataFrame:
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("content_hash"))
    first = d.groupBy("content_hash").agg(F.min("doc_id").alias("existing"))
    return d.join(first, "content_hash").select("doc_id", (F.col("doc_id") != F.col("existing")).alias("deduplicated"), "existing")


@query("SELECT doc_id, sha256('Fields:' || chr(10) || lang || chr(10) || chr(10) || 'Text:' || chr(10) || text) AS prompt_hash FROM documents")
def prompt_hashes(t) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(extraction.prompt(F.col("lang"), F.col("text")), 256).alias("prompt_hash"))


@query("""SELECT conv_id, turn, CASE WHEN turn * 100.0 > 630 THEN 'footer' WHEN ((10.0 + turn % 5 >= 14) OR role = 'system') AND len(text) - len(replace(text, chr(10), '')) + 1 <= 3 THEN 'heading'
WHEN NOT contains(text, chr(10)) AND regexp_matches(text, '^([^:]+):\\s*(.+)$') THEN 'kv_pair' WHEN regexp_matches(text, '^\\s*[•\\-●○▪]') OR regexp_matches(text, '^\\d+[.)]\\s') THEN 'list_item' ELSE 'paragraph' END AS kind FROM conversations""")
def element_kind(t) -> DataFrame:
    c = t.conversations.select("conv_id", "turn", "text", (F.col("turn") * 100.0).alias("y0"), (10.0 + F.col("turn") % 5).alias("font_size"), (F.col("role") == "system").alias("is_bold"), (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).alias("line_count"), F.lit(700.0).alias("page_height"))
    return c.select("conv_id", "turn", elements.kind().alias("kind"))


@query("""WITH b AS (SELECT p_partkey, p_brand AS d, p_partkey % 7 AS page, p_size * 10.0 AS x0, p_retailprice - 900 AS y0, p_size * 10.0 + 30 AS x1, p_retailprice - 890 AS y1 FROM part),
t AS (SELECT 'Brand#' || (s_suppkey % 25 + 1) AS d, s_suppkey % 7 AS page, s_nationkey * 15.0 AS x0, 10.0 AS y0, s_nationkey * 15.0 + 100 AS x1, 60.0 AS y1 FROM supplier)
SELECT p_partkey FROM b WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.d = b.d AND t.page = b.page AND b.x0 < t.x1 AND t.x0 < b.x1 AND b.y0 < t.y1 AND t.y0 < b.y1)""")
def table_overlap_antijoin(t) -> DataFrame:
    b = t.part.select("p_partkey", F.col("p_brand").alias("document_id"), (F.col("p_partkey") % 7).alias("page"), (F.col("p_size") * 10.0).alias("x0"), (F.col("p_retailprice") - 900).alias("y0"), (F.col("p_size") * 10.0 + 30).alias("x1"), (F.col("p_retailprice") - 890).alias("y1"))
    s = t.supplier.select(F.concat(F.lit("Brand#"), F.col("s_suppkey") % 25 + 1).alias("document_id"), (F.col("s_suppkey") % 7).alias("page"), (F.col("s_nationkey") * 15.0).alias("x0"), F.lit(10.0).alias("y0"), (F.col("s_nationkey") * 15.0 + 100).alias("x1"), F.lit(60.0).alias("y1"))
    return elements.outside_tables(b, s).select("p_partkey")


@query("SELECT conv_id AS document_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn // 2, role = 'assistant', turn) - 1 AS ordinal FROM conversations")
def element_ordinals(t) -> DataFrame:
    e = t.conversations.select(F.col("conv_id").alias("document_id"), F.floor(F.col("turn") / 2).alias("page"), (F.col("role") == "assistant").alias("is_table"), F.col("turn").alias("block_no"), "turn")
    return elements.ordinals(e).select("document_id", "turn", F.col("ordinal").cast("long").alias("ordinal"))


@query("""SELECT conv_id AS document_id, string_agg(text, chr(10) ORDER BY turn) AS text, max(10.0 + turn) AS font_size, bool_or(role = 'system') AS is_bold, count(*) AS line_count FROM conversations GROUP BY conv_id""")
def block_assembly(t) -> DataFrame:
    s = t.conversations.select(F.col("conv_id").alias("document_id"), F.lit(0).alias("page"), F.lit(0).alias("block_no"), F.col("turn").alias("line_no"), F.lit(0).alias("span_no"), "text", (10.0 + F.col("turn")).alias("font_size"), F.when(F.col("role") == "system", "Helvetica-Bold").otherwise("Helvetica").alias("font_name"))
    return elements.blocks_of_spans(s).select("document_id", "text", "font_size", "is_bold", "line_count")


@query("SELECT conv_id AS document_id, arg_min(role, turn) = 'system' AS needs_ocr FROM conversations GROUP BY conv_id")
def ocr_needed(t) -> DataFrame:
    return elements.needs_ocr(t.conversations.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page"), F.when(F.col("role") == "system", " \n").otherwise(F.col("text")).alias("text")))


@query("SELECT c_custkey, 'key | name' || chr(10) || repeat('-', 40) || chr(10) || c_custkey || ' | ' || coalesce(CASE WHEN c_acctbal >= 0 THEN c_name END, '') AS text FROM customer")
def table_rendering(t) -> DataFrame:
    cells = F.array(F.array(F.lit("key"), F.lit("name")), F.array(F.col("c_custkey").cast("string"), F.when(F.col("c_acctbal") >= 0, F.col("c_name"))))
    return t.customer.select("c_custkey", cells.alias("cells")).select("c_custkey", elements.rendered_table().alias("text"))


@query("""WITH s AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) OR lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL THEN 1 ELSE 0 END AS new FROM conversations),
g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS table_no FROM s) SELECT conv_id AS document_id, CAST(table_no AS BIGINT) AS table_no, any_value(role) AS header, min(turn) AS first_page, max(turn) AS last_page FROM g GROUP BY conv_id, table_no""")
def repeated_headers(t) -> DataFrame:
    x = t.conversations.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page"), F.col("role").alias("header"), F.array("text").alias("rows"))
    return elements.joined_tables(x).select("document_id", "table_no", "header", "first_page", "last_page")


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS width, p_size % 7 + 1.0 AS height, p_size * (p_size % 7 + 1.0) AS area FROM part")
def box_geometry(t) -> DataFrame:
    x0 = F.col("p_partkey") % 13 * 1.0
    return t.part.select("p_partkey", x0.alias("x0"), F.lit(5.0).alias("y0"), (x0 + F.col("p_size")).alias("x1"), (F.col("p_size") % 7 + 6.0).alias("y1")).select("p_partkey", elements.box().alias("b")).select("p_partkey", "b.*")


@query("""SELECT p_partkey AS document_id, '/brand_' || lower(p_type) AS path, p_brand || ': ' || p_size AS value, 0.5 AS confidence FROM part WHERE p_partkey % 3 <> 1""")
def rule_extraction(t) -> DataFrame:
    text = F.concat(F.lit(" Brand "), "p_type", F.lit(": "), "p_brand", F.lit(": "), F.col("p_size").cast("string"), F.lit(" "))
    e = t.part.select(F.col("p_partkey").alias("document_id"), F.lit(0).alias("ordinal"), text.alias("text"), F.when(F.col("p_partkey") % 3 == 1, "paragraph").otherwise("kv_pair").alias("kind"))
    return extraction.key_values(e).select("document_id", "path", "value", "confidence")


@query("""WITH p AS (SELECT l_orderkey, string_agg(l_returnflag || ':' || strlen(l_shipmode_), ',' ORDER BY l_linenumber, l_returnflag, strlen(l_shipmode_)) AS kinds, string_agg('/q' || l_linenumber || '=' || CAST(l_quantity AS BIGINT), ',' ORDER BY coalesce(c, -1), l_linenumber, CAST(l_quantity AS BIGINT)) AS fields
FROM (SELECT *, repeat('x', CAST(l_quantity AS INTEGER)) AS l_shipmode_, CASE WHEN l_linenumber % 3 > 0 THEN l_discount END AS c FROM lineitem) GROUP BY l_orderkey)
SELECT o_orderkey AS document_id, kinds, fields FROM orders LEFT JOIN p ON l_orderkey = o_orderkey""")
def document_detail(t) -> DataFrame:
    line = t.lineitem.select(F.col("l_orderkey").alias("document_id"), "l_linenumber", "l_returnflag", F.col("l_quantity").cast("int").alias("q"), "l_discount")
    p = line.select("document_id", F.col("l_linenumber").alias("ordinal"), F.col("l_returnflag").alias("kind"), F.repeat(F.lit("x"), F.col("q")).alias("content"))
    f = line.select("document_id", F.concat(F.lit("/q"), "l_linenumber").alias("path"), F.col("q").cast("string").alias("value"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_discount")).alias("confidence"))
    d = review.document_detail(t.orders.select(F.col("o_orderkey").alias("document_id")), p, f)
    ordered = F.array_sort("fields", lambda a, b: F.when(a["_order"] != b["_order"], F.when(a["_order"] < b["_order"], -1).otherwise(1)).when(a["path"] != b["path"], F.when(a["path"] < b["path"], -1).otherwise(1)).when(a["value"].cast("int") < b["value"].cast("int"), -1).when(a["value"].cast("int") > b["value"].cast("int"), 1).otherwise(0))
    return d.select(
        "document_id", F.array_join(F.transform("partitions", lambda x: F.concat_ws(":", x["kind"], x["length"])), ",").alias("kinds"),
        F.array_join(F.transform(ordered, lambda x: F.concat_ws("=", x["path"], x["value"])), ",").alias("fields"),
    )


@query("SELECT c_custkey AS document_id, '/name' AS path, c_name AS value FROM customer")
def encrypt_roundtrip(t) -> DataFrame:
    f = t.customer.select(F.col("c_custkey").alias("document_id"), F.lit("/name").alias("path"), F.col("c_name").alias("value"))
    keys = t.customer.select(F.col("c_custkey").alias("document_id"), F.unhex(F.sha2(F.col("c_custkey").cast("string"), 256)).alias("data_key"))
    return review.decrypted(review.encrypted(f, keys), keys).select("document_id", "path", "value")


def _longest_word(batches):
    for pdf in batches:
        out = pdf[["doc_id"]].copy()
        out["path"], out["value"] = "/longest", [max(filter(None, re.split("[ \t-\r]+", t or "")), key=lambda w: (len(w), w), default="") for t in pdf["text"]]
        yield out


_LONGEST = "coalesce(list_sort(list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), lambda x: {'n': length(x), 'w': x}), 'DESC')[1].w, '')"


@query(f"SELECT doc_id, '/longest' AS path, {_LONGEST} AS value FROM documents")
def extract_with(t) -> DataFrame:
    return extraction.extract_with(t.documents.select("doc_id", "text"), _longest_word, "doc_id long, path string, value string")


@query("""WITH p AS (SELECT l_orderkey AS d, l_linenumber AS n, max(l_linestatus) AS kind FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2), f AS (SELECT DISTINCT l_orderkey AS d, l_linenumber AS n FROM lineitem)
SELECT f.d AS document_id, '/f' || f.n AS path, kind, CASE WHEN kind IS NOT NULL THEN f.n % 3 ELSE -1 END AS page, kind IS NOT NULL AS partition_known FROM f LEFT JOIN p USING (d, n)""")
def provenance(t) -> DataFrame:
    line = t.lineitem.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("partition_id"), "l_linestatus", "l_returnflag")
    f = line.select("document_id", F.col("partition_id").alias("source_partition_id"), F.concat(F.lit("/f"), "partition_id").alias("path"), F.lit("v").alias("value")).distinct()
    p = line.where("l_returnflag <> 'N'").groupBy("document_id", "partition_id").agg(F.max("l_linestatus").alias("kind")).select("*", (F.col("partition_id") % 3).alias("page"), F.lit(None).cast("string").alias("bbox"))
    return review.provenance(f, p).select("document_id", "path", "kind", F.coalesce("page", F.lit(-1)).alias("page"), "partition_known")


_STATES = ["uploading", "uploaded", "extracting", "committed", "failed"]
_OF_EVENT = dict(zip(["signup", "view", "click", "purchase", "error"], _STATES))


def _changes(t) -> DataFrame:
    state = F.element_at(F.create_map(*(F.lit(x) for kv in _OF_EVENT.items() for x in kv)), F.col("event_type"))
    return t.events.select(F.col("user_id").alias("document_id"), state.alias("state"), F.col("event_id").alias("ts"))


_CHANGES = f"c AS (SELECT user_id AS document_id, event_id AS ts, list_position({list(_OF_EVENT)}, event_type) AS place, {_STATES}[list_position({list(_OF_EVENT)}, event_type)] AS state FROM events)"


@query(f"""WITH {_CHANGES}, b AS (SELECT *, lag(place) OVER (PARTITION BY document_id ORDER BY ts, state) AS before FROM c)
SELECT document_id, arg_max(state, ts) AS state, count(*) FILTER (WHERE place < before AND state <> 'failed') AS bad FROM b GROUP BY document_id""")
def state_changes(t) -> DataFrame:
    c = _changes(t)
    bad = review.bad_transitions(c, _STATES).groupBy("document_id").agg(F.count("*").alias("bad"))
    return review.latest_state(c).join(bad, "document_id", "left").select("document_id", "state", F.coalesce("bad", F.lit(0)).alias("bad"))


@query(f"""WITH {MERGED}, c AS (SELECT l_orderkey AS document_id, '/quantity' AS path, CAST(l_linenumber AS VARCHAR) AS new_value, l_linenumber AS place FROM lineitem WHERE l_returnflag = 'R')
SELECT m.document_id, m.path, row_number() OVER w AS step, coalesce(lag(new_value) OVER w, m.value) AS old_value, new_value FROM c JOIN m USING (document_id, path) WINDOW w AS (PARTITION BY m.document_id, m.path ORDER BY place, new_value)""")
def correction_log(t) -> DataFrame:
    c = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("document_id"), F.lit("/quantity").alias("path"), F.col("l_linenumber").cast("string").alias("new_value"), F.lit("someone").alias("corrected_by"), F.col("l_linenumber").alias("corrected_at"))
    return review.correction_log(fields(t), c).select("document_id", "path", "step", "old_value", "new_value")


@query(f"""WITH {MERGED}, c AS (SELECT DISTINCT l_orderkey AS document_id, '/returnflag' AS path FROM lineitem WHERE l_linenumber = 1)
SELECT m.document_id, m.path, CASE WHEN c.path IS NOT NULL THEN 'Q' ELSE m.value END AS value, CASE WHEN c.path IS NOT NULL THEN 'enum' WHEN m.is_conflict THEN 'conflict' END AS validation_error FROM m LEFT JOIN c USING (document_id, path)""")
def correction_revalidated(t) -> DataFrame:
    c = t.lineitem.where("l_linenumber = 1").select(F.col("l_orderkey").alias("document_id"), F.lit("/returnflag").alias("path"), F.lit("Q").alias("new_value"), F.lit("someone").alias("corrected_by"), F.lit(1).alias("corrected_at"))
    f = fields(t).select("document_id", "path", "value", F.when(F.col("is_conflict"), "conflict").alias("validation_error"), F.lit("line").alias("schema_name"), F.lit(1).cast("long").alias("schema_version"))
    return review.corrected(f, c, _props(t)).select("document_id", "path", "value", "validation_error")


@query(f"WITH {MERGED} SELECT m.document_id, m.path, coalesce(m.path = '/quantity' AND o_orderstatus = 'F', false) AS verified FROM m LEFT JOIN orders ON o_orderkey = m.document_id")
def verification_marks(t) -> DataFrame:
    marks = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("document_id"), F.lit("/quantity").alias("path"))
    marks = tables.dealt(marks, ["document_id"])  # made distinct by tasks that grow in number with them
    return review.verified(fields(t), marks).select("document_id", "path", "verified")


_NESTED = """{"properties":{"brand":{"type":"string","pattern":"^Brand#[1-3]"},"comment":{"type":"string"},"note":{"type":["string","null"],"minLength":6},"extra":{"type":"object"},
"size":{"type":"object","required":["value","unit"],"additionalProperties":false,"properties":{"value":{"type":"integer","maximum":40},"unit":{"enum":["cm","in"]},"deep":{"properties":{"price":{"type":"number","minimum":1000}}}}}},"required":["brand","size"]}"""


def _nested(t, keep: str = "true") -> DataFrame:
    """Fields of parts on nested paths; ``keep`` drops some."""
    some = lambda p, v: F.struct(F.lit(p).alias("path"), v.cast("string").alias("value"))
    n = F.col("p_size")
    f = F.array(
        some("/brand", F.col("p_brand")), some("/size/value", n), some("/size/unit", F.when(n % 3 == 0, "cm").when(n % 3 == 1, "in").otherwise("ft")), some("/comment", F.when(n % 5 > 0, F.col("p_type"))), some("/note", F.when(n % 5 > 0, F.col("p_type"))),
        some("/extra/any/thing", n), some("/size/deep/price", F.col("p_retailprice")), some("/size/loose", n), some("/loose", n),
    )
    return t.part.select(F.col("p_partkey").alias("document_id"), "p_size", F.lit("part").alias("schema_name"), F.lit(1).cast("long").alias("schema_version"), F.explode(f).alias("f")).select("document_id", "p_size", "schema_name", "schema_version", "f.*").where(keep).drop("p_size")


def _nested_props(t) -> DataFrame:
    return schemas.properties(t.spark.createDataFrame([("part", 1, _NESTED)], "name string, version long, body string"))


@query("""SELECT p_partkey AS document_id, '/brand' AS path, 'pattern' AS keyword FROM part WHERE NOT regexp_matches(p_brand, '^Brand#[1-3]') UNION ALL SELECT p_partkey, '/size/value', 'maximum' FROM part WHERE p_size > 40
UNION ALL SELECT p_partkey, '/size/unit', 'enum' FROM part WHERE p_size % 3 = 2 UNION ALL SELECT p_partkey, '/comment', 'type' FROM part WHERE p_size % 5 = 0 UNION ALL SELECT p_partkey, '/note', 'minLength' FROM part WHERE p_size % 5 > 0 AND length(p_type) < 6
UNION ALL SELECT p_partkey, '/size/deep/price', 'minimum' FROM part WHERE p_retailprice < 1000 UNION ALL SELECT p_partkey, x, 'additionalProperties' FROM part, (VALUES ('/size/loose'), ('/loose')) v(x)""")
def nested_validation(t) -> DataFrame:
    return schemas.field_errors(_nested(t), _nested_props(t)).select("document_id", "path", "keyword")


@query("""SELECT p_partkey AS document_id, x AS path FROM part, (VALUES ('/brand'), ('/size'), ('/size/value'), ('/size/unit')) v(x)
WHERE CASE x WHEN '/brand' THEN p_size % 4 = 0 WHEN '/size' THEN p_size % 6 = 0 WHEN '/size/value' THEN p_size % 6 <> 0 AND p_size % 7 = 0 ELSE false END""")
def nested_required(t) -> DataFrame:
    f = _nested(t, "not (path = '/brand' and p_size % 4 = 0) and not (path like '/size%' and p_size % 6 = 0) and not (path = '/size/value' and p_size % 7 = 0)")
    d = t.part.select(F.col("p_partkey").alias("document_id"), F.lit("part").alias("schema_name"), F.lit(1).cast("long").alias("schema_version"))
    return schemas.missing_required(d, f, _nested_props(t))


@query("""SELECT 's' || p_partkey AS schema_name, x.path, x.keyword FROM part, (VALUES ('/kind', 'maxLength'), ('/loose', 'additionalProperties'), ('/size/unit/deep', 'additionalProperties'), ('/size/n', 'maximum')) x(path, keyword)
WHERE CASE x.path WHEN '/kind' THEN length(p_type) > 5 + p_partkey % 20 WHEN '/loose' THEN p_partkey % 2 = 0 WHEN '/size/unit/deep' THEN p_partkey % 3 = 0 ELSE p_size > p_partkey % 50 END""")
def many_schemas(t) -> DataFrame:
    """A schema for each part, three properties each; top and inner objects that admit others or not."""
    k = F.col("p_partkey")
    inner = F.format_string('{"type":"object","additionalProperties":%s,"properties":{"n":{"type":"integer","maximum":%d}}}', F.when(k % 3 == 0, "false").otherwise("true"), (k % 50).cast("int"))
    body = F.format_string('{"additionalProperties":%s,"properties":{"kind":{"type":"string","maxLength":%d},"size":%s}}', F.when(k % 2 == 0, "false").otherwise("true"), (5 + k % 20).cast("int"), inner)
    props = stored(schemas.properties(t.part.select(F.concat(F.lit("s"), k).alias("name"), F.lit(1).cast("long").alias("version"), body.alias("body"))), "properties")
    one = lambda p, v: F.struct(F.lit(p).alias("path"), v.cast("string").alias("value"))
    f = F.array(one("/kind", F.col("p_type")), one("/loose", k), one("/size/unit/deep", k), one("/size/n", F.col("p_size")))
    fields_ = t.part.select(F.lit("d").alias("document_id"), F.concat(F.lit("s"), k).alias("schema_name"), F.lit(1).cast("long").alias("schema_version"), F.explode(f).alias("f")).select("document_id", "schema_name", "schema_version", "f.*")
    return schemas.judged(fields_, props).where("keyword is not null").select("schema_name", "path", "keyword")


@query("""WITH p AS (SELECT p_partkey, p_size, p_type, CASE WHEN p_size % 4 = 0 THEN '(' WHEN p_size % 4 = 1 THEN '[a-' ELSE '^[A-M]' END AS pattern FROM part)
SELECT p_partkey AS document_id, CASE WHEN p_size % 4 < 2 THEN 'malformedPattern' ELSE 'pattern' END AS keyword, p_size % 4 < 2 AS registered_malformed FROM p WHERE p_size % 4 < 2 OR NOT regexp_matches(p_type, '^[A-M]')""")
def pattern_validation(t) -> DataFrame:
    """Many schemas, half of them with patterns that don't compile: these are named at registration, and don't stop the validation of the others."""
    pattern = F.when(F.col("p_size") % 4 == 0, "(").when(F.col("p_size") % 4 == 1, "[a-").otherwise("^[A-M]")
    s = t.part.select(F.concat(F.lit("s"), F.col("p_size") % 8).alias("name"), F.lit(1).cast("long").alias("version"), F.to_json(F.struct(F.struct(F.struct(F.lit("string").alias("type"), pattern.alias("pattern")).alias("kind")).alias("properties"))).alias("body")).distinct()
    props = schemas.properties(s)
    bad = schemas.malformed(props).where(F.array_contains("reasons", "pattern")).select(F.col("name").alias("schema_name"), F.lit(True).alias("_bad"))
    f = t.part.select(F.col("p_partkey").alias("document_id"), F.concat(F.lit("s"), F.col("p_size") % 8).alias("schema_name"), F.lit(1).cast("long").alias("schema_version"), F.lit("/kind").alias("path"), F.col("p_type").alias("value"))
    found = schemas.judged(f, props).where("keyword is not null").join(bad, "schema_name", "left")
    return found.select("document_id", "keyword", F.coalesce("_bad", F.lit(False)).alias("registered_malformed"))


@query("SELECT 'n' || p_brand AS name, p_partkey AS version, '/a/b' AS path FROM part WHERE p_size > 25 UNION ALL SELECT 'n' || p_brand, p_partkey, '/c' FROM part WHERE p_size % 2 = 0")
def malformed_schemas(t) -> DataFrame:
    body = F.format_string('{"properties":{"a":{"properties":{"b":{"minimum":%d,"maximum":25}}},"c":{"type":"%s"}}}', F.col("p_size").cast("int"), F.when(F.col("p_size") % 2 == 0, "text").otherwise("string"))
    s = t.part.select(F.concat(F.lit("n"), "p_brand").alias("name"), F.col("p_partkey").alias("version"), body.alias("body"))
    return schemas.malformed(schemas.properties(s)).select("name", "version", "path")


@query("SELECT p_partkey AS document_id, '/a' AS path FROM part WHERE p_size % 3 = 0")
def path_collisions(t) -> DataFrame:
    some = lambda p, on=None: F.when(F.lit(True) if on is None else on, F.lit(p))
    paths = F.array_compact(F.array(some("/a"), some("/a/b/c", F.col("p_size") % 3 == 0), some("/ab"), some("/x/y")))
    return review.path_collisions(t.part.select(F.col("p_partkey").alias("document_id"), F.explode(paths).alias("path")), ["document_id"])


@query("""SELECT s_suppkey AS document_id, '{"_metadata":{"document_id":' || s_suppkey || ',"schema_name":"s","schema_version":1},"data":{"a":{"b":{"c":{"d":{"e":{"f":"' || s_name || '"},"g":null}}}},"k":"' || s_nationkey || '"}}' AS line FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def export_selected(t) -> DataFrame:
    """Deep paths, and only the documents that are asked for."""
    docs = t.supplier.select(F.col("s_suppkey").alias("document_id"), F.lit("s").alias("schema_name"), F.lit(1).alias("schema_version"), F.lit("committed").alias("state"))
    f = t.supplier.select(F.col("s_suppkey").alias("document_id"), F.explode(F.create_map(F.lit("/a/b/c/d/e/f"), F.col("s_name"), F.lit("/a/b/c/d/g"), F.lit(None).cast("string"), F.lit("/k"), F.col("s_nationkey").cast("string"))).alias("path", "value"))
    only = t.supplier.join(F.broadcast(t.nation.where("n_regionkey = 1")), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("document_id"))
    return review.exported(docs, f, only)


@query("""SELECT CASE WHEN n_chars % 5 = 0 THEN 'failed' ELSE 'success' END AS status, count(*) AS documents, CAST(sum(n_chars // 4) AS BIGINT) AS tokens_in, CAST(sum(n_chars // 100) AS BIGINT) AS tokens_out, round(sum((n_chars // 4) * 3e-6 + (n_chars // 100) * 15e-6), 6) AS cost FROM documents GROUP BY 1""")
def extraction_status(t) -> DataFrame:
    return extraction.status_counts(t.documents.select(F.when(F.col("n_chars") % 5 == 0, "failed").otherwise("success").alias("status"), F.floor(F.col("n_chars") / 4).alias("tokens_in"), F.floor(F.col("n_chars") / 100).alias("tokens_out")))


def _with_start(batches):
    for pdf in batches:
        yield pdf[["request_id", "start_s"]]


@query(f"""WITH {REQUESTS}, c AS (SELECT *, sum(1) OVER (ORDER BY request_id) AS cr, sum(tokens) OVER (ORDER BY request_id) AS ct FROM q WHERE tokens <= 2000)
SELECT request_id, round(greatest(0.0, (cr - 50) / (50 / 60.0), (ct - 2000) / (2000 / 60.0)), 6) AS start_s FROM c""")
def paced_extraction(t) -> DataFrame:
    out, _ = extraction.paced(requests(t), _with_start, "request_id long, start_s double", ["request_id"], 50, 2000)
    return out.withColumn("start_s", F.round("start_s", 6))
