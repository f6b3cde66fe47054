"""What the operators share: the cluster's shared folder, written tables, and block sizes."""

from __future__ import annotations

import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.session import scratch


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the folder that all machines share."""
    return f"{scratch(spark)}/recordloom/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back."""
    return written_at(df, name, **options)[0]


def written_at(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """``written``, and the table's folder, for ``files.remove`` once all that reads it has been written itself."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of jobs whose results have been written."""
    import gc

    gc.collect()
    with suppress(Exception):
        spark.sparkContext._jvm.System.gc()


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python workers in batches of so many rows at most: the usual 10000 take too much memory if texts are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def without_collector(batches):
    """Hand batches on with Python's collector of cycles paused: large tables without cycles would be looked through again and again."""
    import gc

    was = gc.isenabled()
    gc.disable()
    try:
        yield from batches
    finally:
        if was:
            gc.enable()


def release_memory() -> None:
    """Give back to the system what this worker has freed: workers outlive their tasks, and the next stage's need room beside them."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of ``df`` has it."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def row_key(doc_id: str = "doc_id", text: str = "text"):
    """Tells rows apart whose ids are null or repeat: a hash of id and text; rows that repeat both share it."""
    return F.xxhash64(F.col(doc_id).cast("string"), text_or_empty(text))
