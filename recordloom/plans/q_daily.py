"""Queries of the daily chain: two runs over the documents, their layers, metrics and reproduction."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.operators import extraction, layout
from recordloom.plans import daily
from recordloom.plans.registry import query
from recordloom.session import scratch
from recordloom.sources import io

DAYS = ["2024-01-01", "2024-01-02"]


def _documents(t) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return t.documents.select(F.col("doc_id").cast("string").alias("document_id"), "doc_id", "lang", "n_chars", F.sha2(text, 256).alias("content_hash"), F.greatest(F.octet_length(text), F.lit(1)).cast("long").alias("size_bytes"))


def _runs(t) -> str:
    """First the English and German documents; then all, the English ones extracted again by another prompt. Returns the folder."""
    base, d = f"{scratch(t.spark)}/daily/{uuid.uuid4().hex}", _documents(t)
    arrivals = d.select("document_id", F.concat(F.lit("f"), "document_id").alias("filename"), "content_hash", F.when(F.col("lang") == "fr", "text/html").otherwise("text/plain").alias("mime"), "size_bytes", "lang")

    def extract(day: int):
        def proposals(docs: DataFrame) -> DataFrame:
            own = d.join(docs.select("document_id"), "document_id", "left_semi")
            one = lambda section, path, value, confidence: F.struct(F.lit(section).alias("section"), F.lit(path).alias("path"), value.cast("string").alias("value"), confidence.alias("confidence"))
            size = F.round(F.lit(0.55) + F.col("doc_id") % 40 / 100, 2)
            rows = F.array(one(1, "/lang", F.col("lang"), F.lit(1.0 - day / 10)), one(1, "/size", F.col("n_chars"), size), one(2, "/size", F.when(F.col("doc_id") % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")), F.lit(0.5)))
            return own.select("document_id", F.explode(rows).alias("f"), F.lit(f"p{day}").alias("prompt_hash"), F.lit(0.001).alias("cost")).select("document_id", "f.*", "prompt_hash", "cost")

        return proposals

    daily.run(t.spark, base, arrivals.where("lang in ('en', 'de')").drop("lang"), extract(1), DAYS[0], "a")
    daily.run(t.spark, base, arrivals.drop("lang"), extract(2), DAYS[1], "b", again=arrivals.where("lang = 'en'").select("document_id"))
    return base


_RUNS = """d AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, doc_id, lang, n_chars, sha256(coalesce(text, '')) AS h FROM documents),
one AS (SELECT h, min(document_id) AS document_id, 1 AS first FROM d WHERE lang IN ('en', 'de') GROUP BY h), two AS (SELECT h, min(document_id) AS document_id, 2 AS first FROM d WHERE lang <> 'fr' AND h NOT IN (SELECT h FROM one) GROUP BY h),
b AS (SELECT d.*, first, CASE WHEN first = 2 OR lang = 'en' THEN 2 ELSE 1 END AS v, CASE WHEN doc_id % 7 = 0 THEN 0.5 ELSE round(0.55 + doc_id % 40 / 100, 2) END AS size_c FROM (SELECT * FROM one UNION ALL SELECT * FROM two) JOIN d USING (document_id, h))"""


@query(f"""WITH {_RUNS} SELECT document_id, h AS content_hash, 'unknown' AS schema_name, CAST(1 AS BIGINT) AS schema_version, '{{"/lang":"' || lang || '","/size":"' || n_chars || '"}}' AS record_json, round((1.0 - v / 10 + size_c) / 2, 8) AS quality_score,
CAST(2 AS BIGINT) AS field_count, CAST(size_c < 0.7 AS BIGINT) AS low_confidence_count, CAST(v AS BIGINT) AS silver_version, '2024-01-0' || v AS conformed_at, CASE v WHEN 1 THEN 'a' ELSE 'b' END AS run_id FROM b""")
def daily_gold(t) -> DataFrame:
    g = daily.current(t.spark, _runs(t), "gold")
    return g.withColumn("quality_score", F.round("quality_score", 8)).withColumn("conformed_at", F.date_format("conformed_at", "yyyy-MM-dd"))


@query(f"""WITH {_RUNS}, n AS (SELECT 1 AS version, * FROM b WHERE first = 1 UNION ALL SELECT 2, * FROM b WHERE v = 2)
SELECT CAST(version AS BIGINT) AS version, '2024-01-0' || version AS run_date, count(*) FILTER (WHERE first = version) AS bronze_count, 2 * count(*) AS fields_extracted, round(3 * count(*) * 0.001, 6) AS extraction_cost, count(*) AS gold_count FROM n GROUP BY version""")
def daily_metrics(t) -> DataFrame:
    return io.published(t.spark, _runs(t)).withColumn("extraction_cost", F.round("extraction_cost", 6))


@query("""SELECT CAST(doc_id AS VARCHAR) AS document_id, 'mime_not_allowed' AS reason, CAST(2 AS BIGINT) AS version FROM documents WHERE lang = 'fr'""")
def daily_quarantine(t) -> DataFrame:
    return io.log(t.spark, _runs(t), "quarantine").select("document_id", "reason", "version")


@query(f"WITH {_RUNS} SELECT count(*) AS records, 0 AS differing, count(*) FILTER (WHERE lang = 'en') AS changed FROM b WHERE first = 1")
def gold_reproduction(t) -> DataFrame:
    """The first version's records made again after the second: none differs, though those of the English documents have changed since."""
    base = _runs(t)
    columns = ["document_id", "record_json", "quality_score"]
    first, now = daily.current(t.spark, base, "gold", 1).select(*columns), daily.current(t.spark, base, "gold").select(*columns)
    parts = first.agg(F.count("*").alias("records")), daily.reproduced(t.spark, base, 1).agg(F.count("*").cast("int").alias("differing")), first.exceptAll(now).agg(F.count("*").alias("changed"))
    return parts[0].join(parts[1], F.lit(True)).join(parts[2], F.lit(True))


@query(f"""WITH {_RUNS} SELECT document_id, CAST(2 AS BIGINT) AS field_count, round((1.0 - v / 10 + size_c) / 2, 8) AS avg_confidence, CAST(size_c < 0.7 AS BIGINT) AS low_confidence_count, round(0.003, 6) AS total_cost, '2024-01-0' || v AS first_extracted FROM b""")
def gold_table(t) -> DataFrame:
    """The warehouse's record table, made of the staged silver fields and written."""
    base = _runs(t)
    stats = extraction.record_statistics(daily.current(t.spark, base, "silver"), ["document_id"], "extracted_at")
    table = io.stage(stats, base, "gold_table", 2)
    return table.select("document_id", "field_count", F.round("avg_confidence", 8).alias("avg_confidence"), "low_confidence_count", F.round("total_cost", 6).alias("total_cost"), F.date_format("first_extracted", "yyyy-MM-dd").alias("first_extracted"))


@query(f"""WITH {_RUNS}, f AS (SELECT document_id, h, '/lang' AS path, lang AS value, 1.0 - v / 10 AS confidence, v FROM b UNION ALL SELECT document_id, h, '/size', CAST(n_chars AS VARCHAR), size_c, v FROM b)
SELECT path AS field_path, count(*) AS n, count(DISTINCT value) AS n_values, round(avg(confidence), 8) AS mean_confidence, CAST(0 AS BIGINT) AS with_page, '2024-01-02' AS last_extracted FROM f GROUP BY path""")
def staging_view(t) -> DataFrame:
    """The staging view, asked in SQL."""
    daily.staging_view(t.spark, _runs(t), "stg_silver_fields")
    return t.spark.sql("SELECT field_path, count(*) AS n, count(DISTINCT field_value) AS n_values, round(avg(confidence), 8) AS mean_confidence, count(source_page) AS with_page, date_format(max(extraction_timestamp), 'yyyy-MM-dd') AS last_extracted FROM stg_silver_fields GROUP BY field_path")


@query(f"""WITH {_RUNS}, g AS (SELECT *, 1 AS version FROM b WHERE first = 1 UNION ALL SELECT *, 2 FROM b WHERE v = 2)
SELECT CAST(version AS BIGINT) AS version, document_id, '{{"/lang":"' || lang || '","/size":"' || n_chars || '"}}' AS record_json, round((1.0 - version / 10 + size_c) / 2, 8) AS quality_score FROM g""")
def gold_versions(t) -> DataFrame:
    """The records of all gold versions made again in one pass from the silver versions that they name."""
    again = daily.reproduced_all(t.spark, _runs(t))
    return again.select("version", "document_id", "record_json", F.round("quality_score", 8).alias("quality_score"))


@query("""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, sha256(coalesce(text, '')) AS h, lang FROM documents), k AS (SELECT h, min(document_id) AS document_id FROM d WHERE lang <> 'fr' GROUP BY h)
SELECT 'threshold_quality_score' AS check_name, document_id AS subject, 0 AS published FROM k WHERE CAST(document_id AS BIGINT) % 10 = 0""")
def gate_outcome(t) -> DataFrame:
    """A run whose gate finds records of low quality: it names them, and nothing is published."""
    base, d = f"{scratch(t.spark)}/daily/{uuid.uuid4().hex}", _documents(t).where("lang <> 'fr'")
    arrivals = d.select("document_id", "content_hash", F.lit("f").alias("filename"), F.lit("text/plain").alias("mime"), "size_bytes")
    proposals = lambda docs: docs.select("document_id", F.lit(1).alias("section"), F.lit("/x").alias("path"), F.lit("v").alias("value"), F.when(F.col("document_id").cast("long") % 10 == 0, 0.2).otherwise(0.9).alias("confidence"), F.lit("p").alias("prompt_hash"), F.lit(0.0).alias("cost"))
    try:
        daily.run(t.spark, base, arrivals, proposals, DAYS[0])
    except daily.Rejected:
        pass
    n = 0 if io.published(t.spark, base) is None else 1
    return t.spark.read.parquet(f"{base}/gate").select("check_name", "subject", F.lit(n).alias("published"))


@query("""SELECT 'bronze' AS layer, 8 AS files_after, 'done' AS status, count(*) AS n_rows, true AS pruned FROM documents UNION ALL SELECT 'silver', 8, 'done', count(*), true FROM lineitem
UNION ALL SELECT 'gold', 0, 'skipped: PATH_NOT_FOUND', 0, true""")
def layers_compacted(t) -> DataFrame:
    """All layers rewritten along their own string columns, one that doesn't exist yet skipped: a single value of the first column may be in a quarter of the files at most."""
    base, to = (f"{scratch(t.spark)}/lake/{uuid.uuid4().hex}" for _ in range(2))
    _documents(t).select("document_id", "content_hash").repartition(20).write.parquet(f"{base}/bronze")
    t.lineitem.select(F.concat(F.lit("doc-"), F.lpad(F.col("l_orderkey").cast("string"), 10, "0")).alias("document_id"), F.col("l_returnflag").alias("schema_name")).repartition(30).write.parquet(f"{base}/silver")
    orders = {"bronze": ["content_hash"], "silver": ["document_id"], "gold": ["document_id"]}
    done, found = daily.compacted(t.spark, base, to, orders), None
    for layer in ("bronze", "silver"):
        table, c = t.spark.read.parquet(f"{to}/{layer}"), orders[layer][0]
        one = table.agg(F.max(c)).first()[0]
        row = layout.admitting(table, {layer: {c: (one, one)}}).join(table.agg(F.count("*").alias("n_rows")), F.lit(True))
        found = row if found is None else found.unionByName(row)
    judged = found.select(F.col("predicate").alias("layer"), "n_rows", (F.col("admitted") * 4 <= F.col("files")).alias("pruned"))
    return done.join(judged, "layer", "left").select("layer", F.col("files_after").cast("int").alias("files_after"), "status", F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"), F.coalesce("pruned", F.lit(True)).alias("pruned"))
