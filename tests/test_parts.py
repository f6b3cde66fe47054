"""Work on parts: filtered landings, joins as of a version, tiles, samples, calls held to limits."""

import hashlib
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from recordloom.functions.prefix import carried
from recordloom.operators import bloom, elements, extraction, layout, schemas, tables
from recordloom.plans.catalog import queries
from recordloom.sources import io


@pytest.mark.parametrize("bits", [64, 1 << 14])
def test_filters_never_lose_a_row(spark, tmp_path, bits):
    log = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 3).alias("version"), F.pmod(F.hash("id"), F.lit(8)).alias("part"))
    log.write.partitionBy("version", "part").parquet(f"{tmp_path}/log")
    log = spark.read.parquet(f"{tmp_path}/log")
    new = spark.createDataFrame([(k,) for k in [5, 5, 299, 300, 1000, None]], "k long")
    filters = bloom.built(log, ["k"], ["version", "part"], bits, 3)
    out, parts = bloom.new_rows(new, log, ["k"], filters, ["version", "part"], bits, 3)
    assert sorted((r.k for r in out.collect()), key=str) == [1000, 300, None]
    assert len(parts) > 2 if bits == 64 else len(parts) == 2  # a small filter finds parts by mistake, which changes nothing but what is read
    halves = bloom.built(log.where("k < 100"), ["k"], [], bits, 3).unionByName(bloom.built(log.where("k >= 100"), ["k"], [], bits, 3))
    whole = bloom.built(log, ["k"], [], bits, 3)
    assert sorted(bloom.merged(halves, []).collect()) == sorted(whole.collect())
    assert bloom.new_rows(new, log.limit(0), ["k"], filters.limit(0), ["version", "part"], bits, 3)[0].count() == 6


def test_keys_ask_the_filters_of_their_own_parts(spark):
    part = lambda k: F.pmod(F.hash(k), F.lit(40))
    log = spark.range(0, 900, 3).select(F.col("id").alias("k"), (F.col("id") % 2).cast("int").alias("version"), part("id").alias("part"))
    new = spark.range(0, 600, 20).select(F.col("id").alias("k"))
    filters = bloom.built(log, ["k"], ["version", "part"], 64, 2)  # so small that other parts' filters have many keys by mistake
    out, parts = bloom.new_rows(new, log, ["k"], filters, ["version", "part"], 64, 2, dealt={"part": part("k")})
    assert sorted(r.k for r in out.collect()) == [k for k in range(0, 600, 20) if k % 3]
    own = {(r.version, r.part) for r in new.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("version"), part("k").alias("part")).collect()}
    assert set(parts) <= own and {(r.version, r.part) for r in log.join(new, "k").collect()} <= set(parts)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_parts_of_a_log_grow_in_number(spark):
    assert tuple(queries()["landing_filtered"](spark, "/root/testdata/sf0.1").first()) == (1500, True)



def test_as_of_join(spark):
    r = random.Random(2)
    right = [(k, at, f"{k}{at}") for k in "ab" for at in sorted(r.sample(range(400), 90))] + [(None, 5, "null key"), ("c", 9, None)]
    left = [(i, "a" if i % 3 else "b", r.randrange(420)) for i in range(500)] + [(900, "zz", 3), (901, None, 7), (902, "c", 10)]
    want = {i: max(((at, v) for k2, at, v in right if k2 == k and at <= t), default=(None, None))[1] for i, k, t in left}
    l, s = spark.createDataFrame(left, "id int, k string, at int").repartition(5), spark.createDataFrame(right, "k string, at int, v string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        out = {x.id: x.v for x in tables.as_of_join(l, s, ["k"], "at", ["id"]).collect()}
        rows = spark.createDataFrame([(k, i if i % 40 == 0 else None) for i, k in enumerate(["x"] * 300 + ["y"] * 5)], "k string, v int").withColumn("n", F.monotonically_increasing_id())
        last = [(x.k, x.last) for x in carried(rows, ["k"], ["n"], "v", "last").orderBy("n").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out == want
    assert last == [("x", i // 40 * 40) for i in range(300)] + [("y", None)] * 5


def test_tiles_find_what_pairs_find(spark):
    r = random.Random(6)
    box = lambda most: (lambda x, y: (x, y, x + r.uniform(0, most), y + r.uniform(0, most)))(r.uniform(-50, 900), r.uniform(-50, 900))
    blocks = [(i, "d", i % 2, *box(r.choice([0.0, 3, 40, 900]))) for i in range(400)] + [(900, "d", 0, None, 1.0, 2.0, 3.0), (901, "e", 0, 1.0, 1.0, 2.0, 2.0)]
    found = [("d", i % 2, *box(r.choice([2, 30, 300]))) for i in range(25)] + [("e", 1, 0.0, 0.0, 9.0, 9.0)]
    b = spark.createDataFrame(blocks, "id int, document_id string, page int, x0 double, y0 double, x1 double, y1 double")
    t = spark.createDataFrame(found, "document_id string, page int, x0 double, y0 double, x1 double, y1 double")
    pairs = sorted(x.id for x in elements.outside_tables(b, t).collect())
    assert sorted(x.id for x in elements.outside_tables(b, t, crowded=10).collect()) == pairs and 20 < len(pairs) < 380
    assert elements._tiled(b.where("id < 400")).groupBy("id", "level").count().where("count > 4").count() == 0


def test_drawn(spark):
    df = spark.createDataFrame([(i, "ab"[i % 10 == 0], 0 if i % 7 == 0 else 1 + i % 3) for i in range(1000)], "id int, s string, w int").repartition(7)
    out = layout.drawn(df, "s", "id", 60, "w")
    assert {x.s: x.n for x in out.groupBy("s").agg(F.count("*").alias("n")).collect()} == {"a": 60, "b": 60}
    assert out.where("w = 0").count() == 0 and sorted(out.collect()) == sorted(layout.drawn(df.repartition(2), "s", "id", 60, "w").collect())
    assert layout.drawn(df, "s", "id", 5000).count() == 1000
    heavy = layout.drawn(df.where("w > 0"), "s", "id", 200, "w").agg(F.avg("w")).first()[0]
    assert heavy > df.where("w > 0").agg(F.avg("w")).first()[0] + 0.05
    rates = layout.error_rates(spark.createDataFrame([("x", i < 5) for i in range(50)] + [("y", False)], "s string, bad boolean"), "s", "bad")
    out = {r.s: r for r in rates.collect()}
    assert out["x"].rate == 0.1 and out["x"].low == pytest.approx(0.0435, abs=1e-3) and out["x"].high == pytest.approx(0.2136, abs=1e-3) and out["y"].low == 0.0 < out["y"].high < 1


def test_calls_are_held_to_their_limits(spark, tmp_path):
    """Twelve calls and 1200 tokens in two seconds, in two lanes; the first run dies after some calls, and the second asks for what has no answer alone."""
    log, folder = f"{tmp_path}/calls", f"file://{tmp_path}/answers"
    docs = spark.createDataFrame([(f"d{i}", 100 if i else 700, "x") for i in range(28)], "document_id string, tokens int, note string")

    def ask(dies):
        def call(row):
            with open(log, "a") as f:
                f.write(f"{row['document_id']} {time.time()} {row['tokens']}\n")
            if dies and row["document_id"] in ("d17", "d9"):
                raise RuntimeError("lost")
            return f"answer of {row['document_id']} {row['note']}"

        return call

    run = lambda dies: extraction.paced_calls(docs, "document_id", ask(dies), 2, folder, 12, 1200, minute=2.0)
    with pytest.raises(Exception, match="lost"):
        run(True)[0].collect()
    time.sleep(2.5)  # until the other lane has been stopped
    first = [x.split() for x in open(log)]
    open(log, "w").close()
    ended = time.time()
    done, over = run(False)
    out = {r.document_id: (r.answer, r.asked_at) for r in done.collect()}
    assert [r.document_id for r in over.collect()] == ["d0"] and set(out) == {f"d{i}" for i in range(1, 28)}
    assert all(a == f"answer of {k} x" for k, (a, _) in out.items())
    second = [x.split() for x in open(log)]
    answered = {k for k in out if os.path.getmtime(f"{tmp_path}/answers/{hashlib.sha256(repr(k).encode()).hexdigest()}") < ended}
    assert answered and not answered & {x[0] for x in second} and len(second) == 27 - len(answered)
    assert 1 <= len({x[0] for x in first} - answered) <= 2  # a call of each lane that was cut off
    assert {k for k, (_, at) in out.items() if at is None} == answered
    times = sorted(float(x[1]) for x in second)
    assert all(times[k + 12] - times[k] >= 2.0 - 0.2 for k in range(len(times) - 12))


def test_partitions_are_bounded_by_cores_and_bytes(spark, monkeypatch):
    most = layout.PARTITIONS_A_CORE * spark.sparkContext.defaultParallelism
    small = spark.range(3000).select("id", F.lit(100).alias("n"))
    assert layout.by_salt(small, "n", "id").rdd.getNumPartitions() == most < 1000
    assert layout.by_salt(small.limit(15), "n", "id").rdd.getNumPartitions() == 5
    assert layout.by_salt(small.limit(0), "n", "id").rdd.getNumPartitions() == 4
    monkeypatch.setattr(layout, "PARTITION_BYTES", 3000)
    assert layout.by_salt(small, "n", "id").rdd.getNumPartitions() == 100
    assert layout.by_salt(small, "n", "id").count() == 3000


def test_tables_that_grow_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(schemas, "BROADCAST_PROPERTIES", 1)
    body = '{"properties":{"a":{"type":"integer"},"b":{"required":["c"],"properties":{"c":{"type":"string"}}}},"required":["a","b"]}'
    props = schemas.properties(spark.createDataFrame([(f"s{i}", 1, body) for i in range(3)], "name string, version long, body string"))
    docs = spark.createDataFrame([(i, f"s{i}", 1) for i in range(3)], "document_id long, schema_name string, schema_version long")
    fields = docs.withColumn("f", F.explode(F.array(*(F.struct(F.lit(p).alias("path"), F.lit("x").alias("value")) for p in ("/a", "/b/d", "/z"))))).select(*docs.columns, "f.*")
    judged, missing = schemas.judged(fields, props), schemas.missing_required(docs, fields, props)
    for df in (judged, missing):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted({(r.path, r.keyword) for r in judged.collect()}) == [("/a", "type"), ("/b/d", None), ("/z", "additionalProperties")]
    assert sorted((r.document_id, r.path) for r in missing.collect()) == [(i, "/b/c") for i in range(3)]


def test_small_files_are_made_and_read_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(io, "FILES_A_TASK", 5)
    rows = spark.range(60).select("id", F.lit("a").alias("arm"), F.array(F.struct(F.col("id").alias("document"), F.lit(1.5).alias("seconds"))).alias("results"))
    io.write_each(rows, f"{tmp_path}/out", "json", ["id"])
    files = [f for f in os.listdir(f"{tmp_path}/out") if f.endswith(".json")]
    assert len(files) == 60 and len({f.split("-")[1] for f in files}) > 6
    back = io.read_results(spark, f"{tmp_path}/out", "arm string, results array<struct<document: long, seconds: double>>")
    assert sorted(r.document for r in back.collect()) == list(range(60))
