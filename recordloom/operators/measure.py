"""Measurement of two ways of working (arms), of accuracy, latency and cost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions.prefix import running_sums

ARMS = ["manual", "tool"]


def finished(timings: DataFrame) -> DataFrame:
    """Runs with an end and some active time, of known arms."""
    return timings.where(F.col("finished_at").isNotNull() & (F.col("active_seconds") > 0) & F.col("arm").isin(ARMS))


def rejected(timings: DataFrame) -> DataFrame:
    """Runs that can't be measured, with the reason: no or an unknown arm, no end, no active time."""
    reason = F.when(F.col("arm").isNull() | ~F.col("arm").isin(ARMS), "unknown_arm").when(F.col("finished_at").isNull(), "unfinished").when(F.coalesce("active_seconds", F.lit(0)) <= 0, "no_active_time")
    return timings.withColumn("reason", reason).where("reason is not null")


def quantiles(rows: DataFrame, by: list[str], value: str, share: float, name: str) -> DataFrame:
    """The groups of ``by`` with the exact quantile of a column, between two values by their distance. Values are counted, and the counts summed along their order over all tasks, so that few groups don't mean few tasks."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    summed = running_sums(counts, ["_v"], {"_cum": "_n"}, by=by)
    total = summed.groupBy(*(F.col(c).alias(f"_by_{c}") for c in by)).agg(F.max("_cum").alias("_all"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by))
    at = F.lit(share) * (F.col("_all") - 1)
    near = lambda place: F.min(F.when(F.col("_cum") > place, F.col("_v")))
    found = summed.join(total, same).groupBy(*by).agg(near(F.floor(at)).alias("_low"), near(F.ceil(at)).alias("_high"), F.first(at - F.floor(at)).alias("_part"))
    return found.select(*by, (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias(name))


def _beside(groups: DataFrame, by: list[str], found: DataFrame) -> DataFrame:
    """Groups with a column of another table of the same groups; keys may be null."""
    other = found.select(*(F.col(c).alias(f"_by_{c}") for c in by), *(c for c in found.columns if c not in by))
    return groups.join(other, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by)), "left").drop(*(f"_by_{c}" for c in by))


def arm_statistics(timings: DataFrame) -> DataFrame:
    g = timings.groupBy("arm").agg(F.count("*").alias("n"), F.sum("active_seconds").alias("total_seconds"), F.avg("accuracy").alias("mean_accuracy"))
    return _beside(g, ["arm"], quantiles(timings, ["arm"], "active_seconds", 0.5, "median_seconds")).select("arm", "n", "median_seconds", "total_seconds", "mean_accuracy")


def comparison(timings: DataFrame) -> DataFrame:
    """One row: both arms' medians (0 without runs), the reduction in percent, distinct participants."""
    t = finished(timings)
    medians = quantiles(t, ["arm"], "active_seconds", 0.5, "m")
    of = lambda arm: F.coalesce(F.max(F.when(F.col("arm") == arm, F.col("m"))), F.lit(0.0)).alias(f"{arm}_median")
    g = medians.agg(*map(of, ARMS)).join(t.agg(F.count_distinct("participant").alias("participants")), F.lit(True))
    return g.withColumn("reduction_percent", F.when(F.col("manual_median") > 0, F.round((F.col("manual_median") - F.col("tool_median")) / F.col("manual_median") * 100, 1)).otherwise(0.0))


def report(results: DataFrame) -> DataFrame:
    """Each arm's documents, median, total, least and greatest seconds; zeros count here. Participants without a name are 'unknown'."""
    g = results.groupBy("arm").agg(
        F.count("*").alias("documents"), F.sum("active_seconds").alias("total_seconds"), F.min("active_seconds").alias("least_seconds"), F.max("active_seconds").alias("most_seconds"),
        F.array_join(F.array_sort(F.collect_set(F.coalesce("participant", F.lit("unknown")))), ",").alias("participants"), (F.count_distinct(F.coalesce("participant", F.lit("unknown"))) < 3).alias("few_participants"),
    )
    return _beside(g, ["arm"], quantiles(results, ["arm"], "active_seconds", 0.5, "median_seconds"))


def per_participant(timings: DataFrame) -> DataFrame:
    by = ["participant", "arm"]
    return _beside(timings.groupBy(*by).agg(F.count("*").alias("n")), by, quantiles(timings, by, "active_seconds", 0.5, "median_seconds"))


def repeated_work(timings: DataFrame) -> DataFrame:
    """Documents that one participant did more than once."""
    return timings.groupBy("participant", "document_id").agg(F.count("*").alias("times")).where("times > 1")


def review_accuracy(fields: DataFrame) -> DataFrame:
    return fields.groupBy("document_id").agg(((F.count("*") - F.count("corrected_from")) / F.count("*")).alias("accuracy"))


def against_truth(found: DataFrame, truth: DataFrame, key: str = "document_id") -> DataFrame:
    """Of each path: hits, wrong values, misses, inventions; precision and recall (null if undefined)."""
    f, t = found.select(key, "path", F.col("value").alias("_f")), truth.select(key, "path", F.col("value").alias("_t"))
    both = f.join(t, [key, "path"], "full_outer")
    hit = F.col("_f") == F.col("_t")
    g = both.groupBy("path").agg(F.count_if(F.coalesce(hit, F.lit(False))).alias("hits"), F.count("_f").alias("found"), F.count("_t").alias("expected"))
    return g.select("path", "hits", "found", "expected", F.when(F.col("found") > 0, F.col("hits") / F.col("found")).alias("precision"), F.when(F.col("expected") > 0, F.col("hits") / F.col("expected")).alias("recall"))


def correction_rate(fields: DataFrame, types: DataFrame) -> DataFrame:
    return fields.join(types, "path").groupBy("type").agg(F.count("*").alias("n"), F.avg(F.col("corrected_from").isNotNull().cast("int")).alias("rate"))


def latency(rows: DataFrame, share: float = 0.95) -> DataFrame:
    band = F.when(F.col("size_bytes") > 10_000, "large").when(F.col("size_bytes") > 1_000, "medium").otherwise("small")
    banded = rows.select(band.alias("size_band"), "seconds")
    return _beside(banded.groupBy("size_band").agg(F.count("*").alias("n")), ["size_band"], quantiles(banded, ["size_band"], "seconds", share, "p95_seconds"))


def throughput(rows: DataFrame, stamp: str = "ts") -> DataFrame:
    """Documents an hour between the first and the last."""
    span = (F.unix_micros(F.max(stamp)) - F.unix_micros(F.min(stamp))) / 3.6e9
    return rows.agg(F.count("*").alias("documents"), F.when(span > 0, F.count("*") / span).alias("per_hour"))
