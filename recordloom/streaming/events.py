"""Arrival events as streams: typed source, idempotent landing, duplicates, windows, latest state, periods.

What a stream knows of earlier batches is in its state, by key; a batch writes what it adds or changes, under its own number, and reads no table of batches before it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from recordloom.session import scratch

EVENT = "event_type string, event_id string, timestamp timestamp, document_id string, content_hash string, filename string, mime string, size_bytes long, s3_key string, schema_name string"


def from_files(spark: SparkSession, folder: str, pattern: str, schema, files_a_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def from_kafka(spark: SparkSession, servers: str, topic: str, most: int = 1_000_000) -> DataFrame:
    """key, value, partition, offset, as ``log.from_log`` gives them. Needs Spark's Kafka package; offsets live in the query's checkpoint."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", most).load()
    return raw.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "partition", "offset")


def arrivals(messages: DataFrame, schema: str = EVENT) -> DataFrame:
    """Events of a source's messages, with the partition and offset that they stand at."""
    return typed(messages.select("value", F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset")), schema)


def typed(raw: DataFrame, schema: str = EVENT) -> DataFrame:
    """JSON in ``value`` as columns; texts that are no JSON object, or whose values don't fit the schema, give no row: see ``malformed``."""
    return _parsed(raw, schema).where("_e._bad is null and _e is not null").select(*(F.col(f"_e.{n}").alias(n) for n in _names(schema)), *(c for c in raw.columns if c != "value"))


def malformed(raw: DataFrame, schema: str = EVENT) -> DataFrame:
    """The rows that ``typed`` leaves out, for quarantine."""
    return _parsed(raw, schema).where("_e._bad is not null or _e is null").select(*raw.columns, F.lit("malformed_event").alias("reason"))


def _names(schema: str) -> list[str]:
    return StructType.fromDDL(schema).names


def _parsed(raw: DataFrame, schema: str) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    return raw.withColumn("_e", F.when(is_object, F.from_json("value", f"{schema}, _bad string", options)))


def as_messages(rows: DataFrame, key: str) -> DataFrame:
    """key and value for a Kafka or file sink."""
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def first_arrivals(events: DataFrame, key: str, stamp: str, late: str = "1 day") -> DataFrame:
    return events.withWatermark(stamp, late).dropDuplicatesWithinWatermark([key])


def counts_by_window(events: DataFrame, stamp: str, window: str, by: str, late: str = "2 days") -> DataFrame:
    return events.withWatermark(stamp, late).groupBy(F.window(stamp, window).alias("w"), by).agg(F.count("*").alias("n"))


def latest_by_key(events: DataFrame, key: str, stamp: str, value: str) -> DataFrame:
    """The last value of each key, kept as state (update or complete mode)."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(stamp, value)).alias(value))


def to_folder(messages: DataFrame, folder: str, checkpoint: str):
    """A file sink of messages (key, value), one JSON line each; the same call with ``format("kafka")`` needs Spark's package. Returns the running query."""
    return messages.select("key", "value").writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folder(spark: SparkSession) -> str:
    return f"{scratch(spark)}/streams/{uuid.uuid4().hex}"


@contextmanager
def _large_state(spark: SparkSession):
    """State on disk, which the processors with timers need; the caller's setting comes back once the query has begun."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def run_to_end(stream: DataFrame, folder: str, mode: str, put=None) -> None:
    """All that has arrived, in batches; each is written under its own number (``put``: made of the batch first), so one that is run again replaces itself. Called again on the folder, it goes on where it ended."""

    def write(batch: DataFrame, number: int) -> None:
        (put(batch) if put else batch).write.mode("overwrite").parquet(f"{folder}/table/batch={number}")

    with _large_state(stream.sparkSession):
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()


def _table(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields, *StructType.fromDDL("batch long").fields])).parquet(f"{folder}/table")


def drained(stream: DataFrame, mode: str, keys: list[str] | None = None, folder: str | None = None) -> DataFrame:
    """Run a stream over all that has arrived and return its table. In update mode batches write the keys that changed, and of each key the last batch counts."""
    spark, folder, schema = stream.sparkSession, folder or _folder(stream.sparkSession), stream.schema
    run_to_end(stream, folder, mode)
    rows = _table(spark, folder, schema)
    if mode == "complete":
        return rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]).drop("batch")
    if mode == "update":
        rest = [c for c in schema.names if c not in keys]
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
        return last.select(*(F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in schema.names))
    return rows.drop("batch")


def landed(stream: DataFrame, key: str, columns: list[str], order: list[str] | None = None, folder: str | None = None) -> DataFrame:
    """Each key's row once: of the batch that brings it first the first in ``order`` (all columns, if not given), whatever is delivered again, in this batch or later. The state keeps each key's first row and the times of its first and its last batch:
    a key is new in the batch in which these are equal. With ``folder``, a stopped stream goes on where it ended."""
    spark, folder = stream.sparkSession, folder or _folder(stream.sparkSession)
    rank = F.struct(*(F.col(c).alias(f"_o_{c}") for c in order or [c for c in columns if c != key]))
    rest = [c for c in columns if c != key]
    timed = stream.withColumn("_now", F.current_timestamp())  # the time of the batch, also if it is run again
    state = timed.groupBy(key).agg(F.min(F.struct(F.col("_now").alias("_first"), rank.alias("_rank"), *rest)).alias("_r"), F.max("_now").alias("_last"))
    run_to_end(state, folder, "update", lambda batch: batch.where("_r._first = _last").select(*(F.col(c) if c == key else F.col(f"_r.{c}").alias(c) for c in columns)))
    return _table(spark, folder, stream.select(*columns).schema).select(*columns)


class _Periods(StatefulProcessor):
    """The end of each key's open period; its timer clears it when no event that isn't late can fall into it."""

    def __init__(self, keep_ms: int):
        self.keep = keep_ms

    def init(self, handle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", "until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        # plain rows: a key has few of them in a batch, and a frame for each key costs more than its rows
        stored = self.open.get()
        until = before = stored[0] if stored else None
        new = []
        for r in sorted(rows, key=lambda r: (r["_us"] is None, r["_us"] or 0)):
            if r["_us"] is None:  # no time: the first of its key only where there is no other
                new += [r] if until is None and not new else []
            elif until is None or r["_us"] // 1000 >= until:
                until = r["_us"] // 1000 + self.keep
                new.append(r)
        if until != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.open.update((until,))
            self.handle.registerTimer(until)
        for r in new:
            yield Row(**{k: v for k, v in r.asDict().items() if k != "_us"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self.open.clear()
        yield from ()

    def close(self) -> None:
        pass


def period_starts(events: DataFrame, key: str, stamp: str, keep_ms: int, late: str = "1 day") -> DataFrame:
    """The events that begin a period of their key: the first, and each that comes ``keep_ms`` or more after the one that began the period before. Events later than ``late`` are dropped; with that bound, the order in which the others come in different batches is theirs by time."""
    stream = events.withWatermark(stamp, late).withColumn("_us", F.unix_micros(stamp))
    return stream.groupBy(key).transformWithState(_Periods(keep_ms), outputStructType=events.schema, outputMode="Append", timeMode="EventTime")
