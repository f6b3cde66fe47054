"""Keyed upserts, versions and retention of plain Parquet tables, as joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.prefix import carried


def bronze_rows(docs: DataFrame, run_date: str) -> DataFrame:
    """Typed document rows with defaults; run_date is a parameter, so a backfill reads what it wrote, and the stamp is its first moment unless the documents have one."""
    name = lambda c, default, kind: (F.coalesce(F.col(c).cast(kind), F.lit(default).cast(kind)) if c in docs.columns else F.lit(default).cast(kind)).alias(c)
    stamp = F.lit(run_date).cast("timestamp")
    return docs.select(
        "document_id", "filename", "content_hash", "mime", F.col("size_bytes").cast("long"), (F.coalesce("s3_key", "filename") if "s3_key" in docs.columns else F.col("filename")).alias("s3_key"), name("schema_name", "unknown", "string"),
        name("schema_version", 1, "long"), (F.coalesce("ingest_timestamp", stamp) if "ingest_timestamp" in docs.columns else stamp).alias("ingest_timestamp"), F.lit(run_date).alias("ingest_date"),
        name("source_system", "upload", "string"), name("kafka_offset", None, "long"),
    )


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in ``order``; an aggregate, so equal keys are combined before the shuffle."""
    order_struct = F.struct(*(c.alias(f"_o{i}") for i, c in enumerate(order)), *(F.col(c).alias(f"_c_{c}") for c in rows.columns if c not in keys))
    return rows.groupBy(*keys).agg(F.min(order_struct).alias("_r")).select(*(F.col(c) if c in keys else F.col(f"_r._c_{c}").alias(c) for c in rows.columns))


#: Rows of a task that ``dealt`` makes, about.
ROWS_A_TASK = 500_000


def dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dealt by keys to tasks that grow in number with the rows, not in size: what later sorts or joins them by these keys holds about ROWS_A_TASK rows at a time (more, if a key has more). Counts the rows first, so they should come from files or be cheap to make."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / ROWS_A_TASK)), *keys)


def new_rows(incoming: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the table lacks."""
    return incoming.join(table.select(*keys), keys, "left_anti")


def insert_only(table: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The table and, of each new key, the first incoming row."""
    return table.unionByName(new_rows(first_per_key(incoming, keys, order), table, keys), allowMissingColumns=True)


def one_per_key(incoming: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """One incoming row for each key (null keys are one key): the first in ``order``; without an order several rows of a key stop the job and the error names the key, as in a keyed merge."""
    if order is not None:
        return first_per_key(incoming, keys, order)
    rest = [c for c in incoming.columns if c not in keys]
    named = F.concat_ws(", ", *(F.concat(F.lit(f"{k} = "), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in keys))
    row = F.struct(F.lit(True).alias("_has"), *(F.col(c).alias(f"_c_{c}") for c in rest))
    g = incoming.groupBy(*keys).agg(F.any_value(row).alias("_r"), F.count("*").alias("_n"))
    g = g.withColumn("_r", F.when(F.col("_n") == 1, F.col("_r")).otherwise(F.raise_error(F.concat(F.lit("several incoming rows of one key: "), named))))
    # the filter keeps the check where no other column is read
    return g.where(F.col("_r._has")).select(*(F.col(c) if c in keys else F.col(f"_r._c_{c}").alias(c) for c in incoming.columns))


def upsert_when_changed(table: DataFrame, incoming: DataFrame, keys: list[str], stamp: str, order: list[Column] | None = None) -> DataFrame:
    """Insert new keys; replace a row if its old stamp is null or differs from the new one (a null new stamp replaces only a null one).
    Keys are unique in the table; of incoming rows see ``one_per_key``. Columns that one side lacks become null."""
    incoming = one_per_key(incoming, keys, order)
    columns = list(dict.fromkeys([*table.columns, *incoming.columns]))
    rest = [c for c in columns if c not in keys]
    side = lambda df, s: df.select(*keys, F.lit(True).alias(f"_{s}"), *((F.col(c) if c in df.columns else F.lit(None)).alias(f"_{s}_{c}") for c in rest))
    both = side(table, "old").join(side(incoming, "new"), keys, "full_outer")
    replace = F.col("_old").isNull() | (F.col("_new").isNotNull() & F.coalesce((F.col(f"_old_{stamp}") != F.col(f"_new_{stamp}")) | F.col(f"_old_{stamp}").isNull(), F.lit(False)))
    return both.select(*keys, *(F.when(replace, F.col(f"_new_{c}")).otherwise(F.col(f"_old_{c}")).alias(c) for c in rest)).select(*columns)


def changes(table: DataFrame, incoming: DataFrame, keys: list[str], stamp: str, order: list[Column] | None = None) -> DataFrame:
    """The incoming rows that ``upsert_when_changed`` would write: what an append-only log of changes gets."""
    incoming = one_per_key(incoming, keys, order)
    old = table.select(*keys, F.col(stamp).alias("_stamp"), F.lit(True).alias("_old")).join(incoming.select(*keys), keys, "left_semi")
    both = incoming.join(old, keys, "left")
    return both.where(F.col("_old").isNull() | F.col("_stamp").isNull() | (F.col("_stamp") != F.col(stamp))).select(*incoming.columns)


def upsert_replace(table: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Whole rows of the incoming keys replace those of the table; of incoming rows see ``one_per_key``."""
    # the anti join needs the keys alone; that each has one row is judged where the rows go in
    return table.join(incoming.select(*keys), keys, "left_anti").unionByName(one_per_key(incoming, keys, order), allowMissingColumns=True)


def history(changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Type-2 history: each change with valid_from and valid_to, the version that replaces it (null: current)."""
    w = Window.partitionBy(*keys).orderBy(version)
    return changes.withColumn("valid_from", F.col(version)).withColumn("valid_to", F.lead(version).over(w)).drop(version)


def only_changes(rows: DataFrame, keys: list[str], version: str, values: list[str]) -> DataFrame:
    """Rows whose values differ from the row before of their key."""
    w = Window.partitionBy(*keys).orderBy(version)
    now, before = F.struct(*values), F.lag(F.struct(*values)).over(w)
    return rows.withColumn("_before", before).where(F.col("_before").isNull() | ~F.struct(*values).eqNullSafe(F.col("_before"))).drop("_before")


def at_version(table: DataFrame, version) -> DataFrame:
    """What was valid at a version."""
    return table.where((F.col("valid_from") <= F.lit(version)) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.lit(version))))


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, order: list[str]) -> DataFrame:
    """Left rows with the columns of the last right row of their key whose ``at`` is at most theirs (null if there is none). Both sides go through one order of (keys, at), so a frequent key's rows may stand in many tasks. ``order``: left columns that make its rows unique
    within (keys, at); of the right at most one row has a key and ``at``."""
    values = [c for c in right.columns if c not in (*keys, at)]
    kind = right.select(F.struct(*values).alias("_v")).schema["_v"].dataType
    rest = [c for c in left.columns if c not in (*keys, at)]
    a = left.select(*keys, at, F.lit(1).alias("_side"), F.struct(*rest).alias("_l"), F.lit(None).cast(kind).alias("_v"), *(F.col(c).alias(f"_s{i}") for i, c in enumerate(order)))
    b = right.select(*keys, at, F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), F.struct(*values).alias("_v"), *(F.lit(None).cast(a.schema[f"_s{i}"].dataType).alias(f"_s{i}") for i in range(len(order))))
    out = carried(a.unionByName(b), keys, [at, "_side", *(f"_s{i}" for i in range(len(order)))], "_v", "_at").where("_side = 1")
    return out.select(*(F.col(c) if c in (*keys, at) else F.col(f"_l.{c}").alias(c) for c in left.columns), *(F.col(f"_at.{c}").alias(c) for c in values))


def latest_version(table: DataFrame) -> DataFrame:
    return table.agg(F.max("valid_from").alias("version"))


def retained(table: DataFrame, oldest) -> DataFrame:
    """History without rows that ended before ``oldest``."""
    return table.where(F.col("valid_to").isNull() | (F.col("valid_to") >= F.lit(oldest)))


def with_cache(requests: DataFrame, cache: DataFrame, key: list[str], price: Column) -> DataFrame:
    """Requests with the cached answer where there is one (cost 0), marked ``cached``; null answers in the cache are faults and count as absent."""
    stored = cache.where(F.col("answer").isNotNull()).select("cache_key", "answer")
    keyed = requests.withColumn("cache_key", cache_key(key))
    return keyed.join(stored, "cache_key", "left").withColumn("cached", F.col("answer").isNotNull()).withColumn("cost", F.when(F.col("cached"), 0.0).otherwise(price))


def cache_after(cache: DataFrame, answered: DataFrame) -> DataFrame:
    """The cache with new answers (cache_key, answer): of keys that it lacks, or whose answer there is a fault (null), the least answer that isn't null goes in."""
    new = answered.where(F.col("answer").isNotNull()).groupBy("cache_key").agg(F.min("answer").alias("answer"))
    kept = cache.where(F.col("answer").isNotNull()).select("cache_key", "answer")
    return kept.unionByName(new.join(kept.select("cache_key"), "cache_key", "left_anti"))


def cache_key(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"}), 256)


def file_detail(table: DataFrame) -> DataFrame:
    """Number of files and rows of a table that is read from files."""
    return table.select(F.col("_metadata.file_path").alias("f")).agg(F.count_distinct("f").alias("n_files"), F.count("*").alias("n_rows"))
