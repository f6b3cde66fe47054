"""Session defaults: adaptive execution, UTC, sizes that the caller's cluster may override; and the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_local: list[str] = []


def session(app: str = "recordloom", **conf: str) -> SparkSession:
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.parquet.filterPushdown": "true", "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536"}
    b = SparkSession.builder.appName(app)
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch(spark: SparkSession) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir``. Only where everything runs in one process (a local master) may it be unset: a temporary folder serves then."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return _local[0]
