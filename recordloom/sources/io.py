"""Reading and writing of the lake's layers, documents, results and exports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYERS = ("bronze", "silver", "gold")


def read_layer(spark: SparkSession, base: str, layer: str, ingest_date: str | None = None) -> DataFrame:
    """A layer's table; a date prunes the partitions of bronze."""
    if layer not in LAYERS:
        raise ValueError(f"no layer {layer}")
    df = spark.read.option("mergeSchema", str(layer == "silver").lower()).parquet(f"{base}/{layer}")
    return df if ingest_date is None else df.where(F.col("ingest_date") == ingest_date)


def write_layer(df: DataFrame, base: str, layer: str) -> None:
    """Bronze is partitioned by ingest_date and appended to; the others are replaced by a table built from elsewhere."""
    w = df.write.mode("append" if layer == "bronze" else "overwrite")
    (w.partitionBy("ingest_date") if layer == "bronze" else w).parquet(f"{base}/{layer}")


def stage(df: DataFrame, base: str, layer: str, version: int) -> DataFrame:
    """Write a version's rows of a layer. They don't count before ``publish``; a run that is repeated replaces them."""
    path = f"{base}/{layer}/version={version}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def publish(spark: SparkSession, base: str, version: int, **metrics) -> None:
    """Make a version count, with its metrics: one small file, written when all layers stand."""
    names = ", ".join(f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'long'}" for k, v in metrics.items())
    spark.createDataFrame([(version, *metrics.values())], f"version long, {names}").coalesce(1).write.mode("overwrite").parquet(f"{base}/published/number={version}")


def published(spark: SparkSession, base: str) -> DataFrame | None:
    """Versions that count and their metrics; None before the first."""
    try:
        return spark.read.option("mergeSchema", "true").parquet(f"{base}/published").drop("number")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def log(spark: SparkSession, base: str, layer: str, upto: int | None = None) -> DataFrame | None:
    """A layer's rows of published versions, with version; None if there are none."""
    done = published(spark, base)
    versions = sorted(r.version for r in done.select("version").collect() if upto is None or r.version <= upto) if done is not None else []  # one number a run
    if not versions:
        return None
    return spark.read.option("mergeSchema", "true").option("basePath", f"{base}/{layer}").parquet(*(f"{base}/{layer}/version={v}" for v in versions)).withColumn("version", F.col("version").cast("long"))


def as_of(spark: SparkSession, base: str, layer: str, keys: list[str], upto: int | None = None) -> DataFrame | None:
    """A layer as it was at a version: of each key the row of the last version up to it."""
    rows = log(spark, base, layer, upto)
    if rows is None:
        return None
    rest = [c for c in rows.columns if c not in (*keys, "version")]
    return rows.groupBy(*keys).agg(F.max(F.struct("version", *rest)).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def read_documents(spark: SparkSession, folder: str, pattern: str = "*.{pdf,csv}") -> DataFrame:
    """Files as rows: path, content, content_hash, size_bytes."""
    b = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return b.select("path", "content", F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size_bytes"))


def read_results(spark: SparkSession, pattern: str, schema: str | None = None) -> DataFrame:
    """Evaluation results: JSON files with a list ``results``, one row for each. Without a ``schema`` Spark first reads all files to find one, and small files in one task."""
    reader = spark.read.option("multiLine", "true")
    return (reader if schema is None else reader.schema(schema)).json(pattern).select("arm", F.explode("results").alias("r")).select("arm", "r.*")


def write_lines(lines: DataFrame, folder: str, column: str = "line") -> None:
    lines.select(column).write.mode("overwrite").text(folder)


#: Files that a task of ``write_each`` makes, about.
FILES_A_TASK = 500


def write_each(df: DataFrame, folder: str, kind: str, drop: list[str]) -> None:
    """A text or JSON file for each row, in a new folder. Tasks grow in number with the files (small rows would else meet in one task, which makes them one after the other), and each moves its own files to their places, not the driver all of them; the columns ``drop`` say where rows go and aren't written."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, df.count() // FILES_A_TASK)
    w = df.repartition(tasks, *drop).drop(*drop).write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    w.format(kind).save(folder)


def write_parts(df: DataFrame, folder: str, parts: list[str], n: int) -> None:
    """Parquet partitioned by ``parts``, about ``n`` of them, one file for each, in a new folder; tasks as in ``write_each``."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, n // FILES_A_TASK)
    df.repartition(tasks, *parts).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(*parts).parquet(folder)
