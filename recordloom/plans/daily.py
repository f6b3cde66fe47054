"""The daily chain: land, validate, extract, merge, conform, gate, publish.

Layers are logs of versions, one a run: bronze gets the day's new documents, silver the fields that are new or whose prompt changed, gold the records of the documents that these touch, quarantine the rejected arrivals. A layer as of a version
is the last row of each key up to it (``sources.io.as_of``), so gold can be made again from the silver version that it names. A run writes what it adds, and it counts only once it is published, which it isn't before the gate is empty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators import extraction, layout, quality, tables
from recordloom.sources import io

SILVER, GOLD = ["content_hash", "path", "schema_version"], ["content_hash", "schema_version"]


class Rejected(Exception):
    """What kept a run from being published."""


def landed(bronze: DataFrame | None, arrivals: DataFrame, run_date: str) -> tuple[DataFrame, DataFrame]:
    """The day's new documents, and the rejected arrivals with their reasons."""
    judged = quality.admission(arrivals)
    rows = tables.bronze_rows(judged.where("reason is null"), run_date)
    first = tables.first_per_key(rows, ["content_hash"], [F.col("document_id")])
    return first if bronze is None else tables.new_rows(first, bronze, ["content_hash"]), judged.where("reason is not null")


def violations(bronze: DataFrame, silver: DataFrame, gold: DataFrame) -> DataFrame:
    return quality.gate(
        quality.outside(silver, "confidence", 0, 1, "document_id"), quality.orphans(silver, bronze, "document_id", "document_id", "document_id"),
        quality.below(gold, "quality_score", 0.5, "document_id"), quality.repeated(gold, GOLD), quality.null_in(gold, ["document_id", "record_json"], "document_id"),
    )


def run(spark: SparkSession, base: str, arrivals: DataFrame, extract: Callable[[DataFrame], DataFrame], run_date: str, run_id: str | None = None, again: DataFrame | None = None) -> int:
    """One day's run on the layers in ``base``; returns its version. ``extract`` gives proposals (document_id, section, path, value, confidence, prompt_hash, cost) of documents: the new ones and those of ``again`` (document_id)."""
    done = io.published(spark, base)
    version = (done.agg(F.max("version")).first()[0] if done is not None else 0) + 1
    known = io.log(spark, base, "bronze")
    new, rejected = landed(known, arrivals, run_date)
    new = io.stage(new, base, "bronze", version)
    table = new if known is None else known.select(*new.columns).unionByName(new)
    io.stage(rejected.select("document_id", "filename", "content_hash", "reason", F.lit("landing").alias("stage")), base, "quarantine", version)
    found = quality.bronze_summary(new).first()
    if found.required_null or found.repeated_hash:
        raise Rejected(f"bronze of {run_date}: {found}")
    todo = new if again is None else new.unionByName(table.join(again.select("document_id").distinct(), "document_id", "left_semi").select(*new.columns)).dropDuplicates(["document_id"])
    todo = layout.by_salt(todo, "size_bytes", "content_hash")  # documents are dealt by their sizes before they are extracted
    proposals = extract(todo)
    merged = extraction.merged_proposals(proposals, ["document_id", "path"], ["section"], ["document_id"])
    spent = proposals.groupBy("document_id", "path").agg(F.min("prompt_hash").alias("prompt_hash"), F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"))
    silver_rows = merged.join(spent, ["document_id", "path"]).join(todo.select("document_id", "content_hash", "schema_name", "schema_version"), "document_id").select(
        F.concat_ws(":", "document_id", "path").alias("field_id"), "document_id", "content_hash", "path", "value", "confidence", "n_proposals", "is_conflict", "schema_name", "schema_version", F.lit(run_date).cast("timestamp").alias("extracted_at"), "cost", "prompt_hash",
    )
    before = io.as_of(spark, base, "silver", SILVER)
    silver = io.stage(silver_rows if before is None else tables.changes(before, silver_rows, SILVER, "prompt_hash"), base, "silver", version)
    now = silver if before is None else tables.upsert_replace(before.join(silver.select("content_hash").distinct(), "content_hash", "left_semi").select(*silver.columns), silver, SILVER)
    gold = io.stage(extraction.gold_records(now, version, run_date, run_id), base, "gold", version)
    bad = violations(table, silver, gold)
    if not quality.passes(bad):
        io.stage(bad, base, "gate", version)
        raise Rejected(f"gate of {run_date}: {bad.limit(5).collect()}")
    earlier = done.where(F.col("run_date") == run_date).agg(F.max("version")).first()[0] if done is not None else None
    if earlier is not None and not any(x.limit(1).count() for x in (new, silver, gold)):
        return earlier  # a day that is run again and brings nothing
    counts = new.agg(F.count("*").alias("a")).join(silver.agg(F.count("*").alias("b"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("c")), F.lit(True)).join(gold.agg(F.count("*").alias("d")), F.lit(True)).first()
    io.publish(spark, base, version, run_date=run_date, bronze_count=counts.a, fields_extracted=counts.b, extraction_cost=float(counts.c), gold_count=counts.d)
    return version


def metrics(spark: SparkSession, base: str) -> DataFrame:
    """A row for each run date: its last version, and what all its runs brought."""
    return io.published(spark, base).groupBy("run_date").agg(F.max("version").alias("version"), *(F.sum(c).alias(c) for c in ("bronze_count", "fields_extracted", "extraction_cost", "gold_count")))


#: The columns of the warehouse's staging view and their types, and the silver columns that stand for them under other names.
STAGED = "field_id string, document_id string, content_hash string, field_path string, field_value string, confidence double, source_partition_id string, source_page int, source_bbox string, source_row int, source_col int, schema_name string, schema_version long, model_version string, extraction_timestamp timestamp, extraction_cost_usd double, prompt_hash string"
_OTHER_NAMES = {"field_path": "path", "field_value": "value", "extraction_timestamp": "extracted_at", "extraction_cost_usd": "cost"}


def staging_view(spark: SparkSession, base: str, name: str = "stg_silver_fields") -> None:
    """A view of silver as it is published now, for SQL: columns that the extractor doesn't give are null."""
    silver = current(spark, base, "silver")

    def column(c: str, kind: str) -> F.Column:
        own = _OTHER_NAMES.get(c, c)
        return (F.col(own).cast(kind) if own in silver.columns else F.lit(None).cast(kind)).alias(c)

    silver.select(*(column(*x.strip().split(" ")) for x in STAGED.split(","))).createOrReplaceTempView(name)


def current(spark: SparkSession, base: str, layer: str, upto: int | None = None) -> DataFrame | None:
    """silver or gold as of a version (the last one)."""
    return io.as_of(spark, base, layer, SILVER if layer == "silver" else GOLD, upto)


def reproduced(spark: SparkSession, base: str, version: int) -> DataFrame:
    """What the gold rows that a version wrote and those made again from the silver that they name have not in common: side (stored or again) and the record; empty if they agree."""
    columns = ["document_id", "content_hash", "schema_name", "schema_version", "record_json", "quality_score", "field_count", "low_confidence_count"]
    rows = io.log(spark, base, "gold", version)
    stored = rows.where(F.col("version") == version)
    silver = current(spark, base, "silver", version).join(stored.select("content_hash").distinct(), "content_hash", "left_semi")
    again = extraction.gold_records(silver, version, "1970-01-01", None).select(*columns)
    stored = stored.select(*columns)
    return stored.exceptAll(again).withColumn("side", F.lit("stored")).unionByName(again.exceptAll(stored).withColumn("side", F.lit("again")))


def reproduced_all(spark: SparkSession, base: str) -> DataFrame:
    """The gold rows of all versions made again in one pass, each of the silver that it names: version, document_id, record_json, quality_score. Each field of a record is joined as of the record's own silver version."""
    gold = io.log(spark, base, "gold").select("version", "document_id", *GOLD, "silver_version")
    silver = io.log(spark, base, "silver")
    places = gold.join(silver.select(*SILVER).distinct(), GOLD).select(*SILVER, F.col("silver_version").alias("at"), F.col("version").alias("gold_version"), F.col("document_id").alias("gold_document"))
    known = silver.select(*SILVER, F.col("version").alias("at"), "document_id", "schema_name", "value", "confidence")
    fields = tables.as_of_join(places, known, SILVER, "at", ["gold_version", "gold_document"]).where("document_id is not null")
    keys = ["gold_version", "document_id", "content_hash", "schema_name", "schema_version"]
    return extraction.conformed(fields, keys).where("quality_score is not null").withColumnRenamed("gold_version", "version")


def retained(spark: SparkSession, base: str, to: str, oldest: int) -> DataFrame:
    """The layers without versions before ``oldest``: what these left behind is one version now, ``oldest`` itself. Returns layer, versions before and after. The new folder is complete before anyone reads it; reproduction reaches back to ``oldest``."""
    done = io.published(spark, base)
    kept, rows = [r for r in done.orderBy("version").collect() if r.version >= oldest], []
    for layer, keys in (("bronze", ["content_hash"]), ("silver", SILVER), ("gold", GOLD), ("quarantine", None)):
        own = io.log(spark, base, layer)
        names = [c for c in own.columns if c != "version"]
        first = io.log(spark, base, layer, oldest).select(*names) if keys is None else io.as_of(spark, base, layer, keys, oldest).select(*names)
        io.stage(first, to, layer, oldest)
        for r in kept[1:]:
            io.stage(own.where(F.col("version") == r.version).select(*names), to, layer, r.version)
        rows.append((layer, done.count(), len(kept)))
    for r in kept:
        io.publish(spark, to, r.version, **{k: v for k, v in r.asDict().items() if k != "version"})
    return spark.createDataFrame(rows, "layer string, versions_before long, versions_after long")


def compacted(spark: SparkSession, base: str, to: str, orders: dict[str, list[str]], files: int = 8) -> DataFrame:
    """Each layer rewritten in few files along its order; layer, files before and after, status. The new folder is complete before anyone reads it."""
    rows = []
    for layer, columns in orders.items():
        try:
            df = spark.read.parquet(f"{base}/{layer}")
        except AnalysisException as e:  # a layer that doesn't exist yet
            rows.append((layer, 0, 0, f"skipped: {e.getCondition()}"))
            continue
        layout.z_ordered(df, columns, files).drop("_z").write.mode("overwrite").parquet(f"{to}/{layer}")
        counts = [tables.file_detail(spark.read.parquet(f"{b}/{layer}")).first().n_files for b in (base, to)]
        rows.append((layer, *counts, "done"))
    return spark.createDataFrame(rows, "layer string, files_before long, files_after long, status string")
