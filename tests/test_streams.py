from datetime import datetime, timedelta

from pyspark.sql import functions as F

from recordloom.streaming import events as streams
from recordloom.streaming import log

START = datetime(2024, 1, 1)


def messages(spark, items):
    return spark.createDataFrame([(str(i), f'{{"n": {i}, "v": "{v}"}}' if v != "broken" else "[", i % 2, k) for k, (i, v) in enumerate(items)], "key string, value string, partition int, k int")


def test_a_stopped_stream_goes_on(spark, tmp_path):
    folder, out = f"file://{tmp_path}/log", f"file://{tmp_path}/out"
    columns = ["n", "v", "kafka_partition", "kafka_offset"]
    land = lambda: sorted(tuple(r) for r in streams.landed(streams.arrivals(log.from_log(spark, folder), "n long, v string"), "n", columns, ["kafka_partition", "kafka_offset"], out).collect())
    log.append(messages(spark, [(1, "a"), (2, "b"), (4, "c"), (1, "again")]), folder, ["k"])
    assert land() == [(1, "a", 1, 0), (2, "b", 0, 0), (4, "c", 0, 1)]
    log.append(messages(spark, [(1, "late"), (6, "broken"), (8, "d"), (3, "e")]), folder, ["k"])
    log.append(messages(spark, [(8, "twice"), (10, "f")]), folder, ["k"])
    want = [(1, "a", 1, 0), (2, "b", 0, 0), (3, "e", 1, 3), (4, "c", 0, 1), (8, "d", 0, 3), (10, "f", 0, 5)]
    assert land() == want == land()
    assert log.ends(folder) == {0: 6, 1: 4}
    # a new stream reads all offsets, without gaps
    every = streams.drained(log.from_log(spark, folder), "append")
    assert sorted((r.partition, r.offset) for r in every.collect()) == [(0, k) for k in range(6)] + [(1, k) for k in range(4)]
    # what a batch wrote: later batches hold new keys only
    assert spark.read.parquet(f"{out}/table").groupBy("n").count().where("count > 1").count() == 0


def test_stretches_of_segments(spark, tmp_path):
    folder = f"file://{tmp_path}/log"
    for k in range(3):
        log.append(messages(spark, [(2 * i, "x" * 50) for i in range(5 * k, 5 * k + 5)]), folder, ["k"])
    reader = log.Reader(folder)
    parts = reader.partitions({"0": 3}, {"0": 12})
    assert [(p.start, p.end) for p in parts] == [(3, 5), (5, 10), (10, 12)]
    assert [o for p in parts for b in reader.read(p) for o in b.column("offset").to_pylist()] == list(range(3, 12))
    assert reader.partitions({"0": 15}, {"0": 15}) == [] and log.segments(f"file://{tmp_path}/none") == {}


def test_latest_state_merges_batches(spark, tmp_path):
    folder, out = f"file://{tmp_path}/log", f"file://{tmp_path}/out"
    latest = lambda: sorted(tuple(r) for r in streams.drained(streams.latest_by_key(streams.arrivals(log.from_log(spark, folder), "n long, v string"), "n", "kafka_offset", "v"), "update", ["n"], out).collect())
    log.append(messages(spark, [(2, "a"), (4, "b")]), folder, ["k"])
    assert latest() == [(2, "a"), (4, "b")]
    log.append(messages(spark, [(2, "c")]), folder, ["k"])
    assert latest() == [(2, "c"), (4, "b")]
    assert sorted((r.batch, r.n) for r in spark.read.parquet(f"{out}/table").collect()) == [(0, 2), (0, 4), (1, 2)]  # what changed, not the whole state


def test_periods_with_late_repeated_and_expired_events(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    schema = "user string, id int, ts timestamp"
    at = lambda days: START + timedelta(days=days)
    batches = [
        [("a", 1, at(0)), ("a", 2, at(1)), ("b", 3, at(0))],
        [("a", 4, at(4.9)), ("a", 5, at(5)), ("b", 6, at(40))],
        [("b", 13, at(40.2))],  # a row is late by the watermark that the batch before had
        [("a", 7, at(30)), ("c", 8, at(39.5)), ("c", 9, at(39.6))],  # the first is late
        [("a", 10, at(41)), ("b", 11, at(44.9)), ("b", 12, at(45.1))],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = streams.from_files(spark, folder, "*.parquet", spark.createDataFrame([], schema).schema, 1)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    out = streams.drained(streams.period_starts(stream, "user", "ts", 5 * 86_400_000), "append")
    assert sorted(r.id for r in out.collect()) == [1, 3, 5, 6, 8, 10, 12]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_windows_drop_what_is_late(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    for rows in ([(1, START), (2, START + timedelta(days=9))], [(5, START + timedelta(days=9))], [(3, START + timedelta(hours=1)), (4, START + timedelta(days=9))]):
        spark.createDataFrame(rows, "id int, ts timestamp").withColumn("kind", F.lit("x")).coalesce(1).write.mode("append").parquet(folder)
    stream = streams.from_files(spark, folder, "*.parquet", spark.read.parquet(folder).schema, 1)
    out = streams.drained(streams.counts_by_window(stream, "ts", "1 day", "kind"), "append")
    assert [(r.w.start, r.n) for r in out.collect()] == [(START, 1)]


def test_periods_of_plain_rows():
    """A key's rows come as they are, without a frame for each key; rows without a time begin no period beside others."""
    from pyspark.sql import Row

    class Handle:
        until, timers = None, set()

        def getValueState(self, name, schema):
            return self

        def get(self):
            return None if self.until is None else (self.until,)

        def update(self, value):
            self.until = value[0]

        def registerTimer(self, at):
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    h, p = Handle(), streams._Periods(1000)
    p.init(h)
    batch = lambda *us: [r.asDict() for r in p.handleInputRows(("k",), iter([Row(id=i, _us=u) for i, u in enumerate(us)]), None)]
    assert batch(2_500_000, 500_000, None, 1_499_999) == [{"id": 1}, {"id": 0}] and h.timers == {3500}
    assert batch(3_499_999) == [] and batch(3_500_000) == [{"id": 0}] and h.timers == {4500}
