"""Checks of tables as tables of violations, and the gate that they form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _named(check: str, subject) -> list:
    return [F.lit(check).alias("check_name"), subject.cast("string").alias("subject")]


def null_in(df: DataFrame, columns: list[str], subject: str) -> DataFrame:
    """One scan for all columns."""
    bad = df.select(F.col(subject).cast("string").alias("subject"), F.explode(F.filter(F.array(*(F.when(F.col(c).isNull(), F.lit(f"not_null_{c}")) for c in columns)), lambda x: x.isNotNull())).alias("check_name"))
    return bad.select("check_name", "subject")


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1").select(*_named("unique_" + "_".join(keys), F.concat_ws("/", *keys)))


def outside(df: DataFrame, column: str, low: float, high: float, subject: str) -> DataFrame:
    return df.where((F.col(column) < low) | (F.col(column) > high)).select(*_named(f"range_{column}", F.col(subject)))


def below(df: DataFrame, column: str, least: float, subject: str) -> DataFrame:
    return df.where(F.col(column) < least).select(*_named(f"threshold_{column}", F.col(subject)))


def orphans(df: DataFrame, parents: DataFrame, key: str, parent_key: str, subject: str) -> DataFrame:
    """Rows whose key is null, empty or has no parent."""
    known = parents.select(F.col(parent_key).alias(key)).where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    return df.join(known, key, "left_anti").select(*_named(f"orphan_{key}", F.col(subject)))


def gate(*violations: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, violations)


def passes(violations: DataFrame) -> bool:
    return not violations.limit(1).count()


def bronze_summary(bronze: DataFrame, least: int = 1, most: int = 500_000_000, schemas: list[str] | None = None) -> DataFrame:
    """Rows, required nulls, sizes out of bounds, repeated hashes, unknown schemas: one row."""
    return bronze.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("content_hash").isNull() | F.col("filename").isNull()).alias("required_null"), F.count_if((F.col("size_bytes") < least) | (F.col("size_bytes") > most)).alias("size_out"),
        (F.count("content_hash") - F.count_distinct("content_hash")).alias("repeated_hash"), F.count_if(~F.col("schema_name").isin(schemas)).alias("unknown_schema") if schemas else F.lit(0).cast("long").alias("unknown_schema"),
    )


# Accepted types, the largest upload, first bytes and the type that they show.
ALLOWED_TYPES = ["application/pdf", "text/csv", "text/plain", "application/vnd.ms-excel"]
LARGEST_UPLOAD = 500_000_000
FIRST_BYTES = [("25504446", "application/pdf"), ("EFBBBF", "text/csv")]


def admission(uploads: DataFrame, largest: int = LARGEST_UPLOAD) -> DataFrame:
    """Uploads with the reason of a rejection, null if admitted; with a column ``content`` its first bytes must fit the declared type."""
    reason = F.when(F.col("mime").isNull() | ~F.col("mime").isin(ALLOWED_TYPES), "mime_not_allowed").when(F.col("size_bytes") > largest, "too_large")
    if "content" in uploads.columns:
        for head, mime in FIRST_BYTES:
            reason = reason.when(F.hex(F.substring("content", 1, len(head) // 2)).eqNullSafe(head) & (F.col("mime") != mime), "content_mismatch")
    return uploads.withColumn("reason", reason)
