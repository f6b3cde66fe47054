"""Global running sums without a one-partition window."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.session import scratch


def pinned(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: layouts by range must not change when a task is run again."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(scratch(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written as Parquet in the shared folder and read back: what several steps read is made once, and each reads its columns."""
    path = f"{scratch(df.sparkSession)}/recordloom/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_sums(df: DataFrame, order: list[str], sums: dict[str, str], partitions: int | None = None, by: list[str] | None = None) -> DataFrame:
    """For each output name: the sum of a column over all rows up to each row in a global order (``order`` must be unique). With ``by``, sums start anew for each value of these columns, which may be few.

    Rows are dealt by ranges of the order; a row for each range carries its total, and the totals before a range are added to the sums inside it."""
    by = by or []
    order = [*by, *(c for c in order if c not in by)]
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = pinned(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range", *by).agg(*(F.sum(c).alias(f"_t_{o}") for o, c in sums.items()))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *(F.col(c).alias(f"_by_{c}") for c in by), *(F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_b_{o}") for o in sums))
    inside = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    out = ranged.withColumnRenamed("_range", "_own").join(offsets, (F.col("_own") == F.col("_range")) & same)
    return out.select(*df.columns, *((F.col(f"_b_{o}") + F.sum(c).over(inside)).alias(o) for o, c in sums.items()))


def carried(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, partitions: int | None = None) -> DataFrame:
    """The rows with ``name``: the last ``value`` that isn't null of their key up to them, in ``order`` (unique within a key). A key's rows may fill many ranges: each range says the value that its last key ends with, and takes that of the ranges before for its first."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = pinned(df.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()))
    key = F.struct(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)))
    inside = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # a row for each range: its last key and what that ends with
    rank = F.struct(*(F.col(o).alias(f"_o{i}") for i, o in enumerate(order)))
    last = ranged.groupBy("_range").agg(F.max(key).alias("_key"))
    of_last = ranged.withColumn("_key", key).join(F.broadcast(last), ["_range", "_key"]).groupBy("_range", "_key").agg(F.max_by(value, F.when(F.col(value).isNotNull(), rank)).alias("_end"))
    before = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.orderBy("_range")
    ends = last.join(of_last, ["_range", "_key"], "left")
    # the next range may begin with the key: it gets the last value of all ranges that end with it
    told = ends.withColumn("_so_far", F.coalesce("_end", F.last("_end", ignorenulls=True).over(before))).select((F.lead("_range").over(later)).alias("_to"), F.col("_key").alias("_of"), "_so_far").where("_to is not null")
    out = ranged.withColumn("_key", key).join(F.broadcast(told), (F.col("_range") == F.col("_to")) & F.col("_key").eqNullSafe(F.col("_of")), "left")
    return out.select(*df.columns, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_so_far")).alias(name))
