import os

import pytest
from pyspark.errors import PySparkException as SparkException
from pyspark.sql import functions as F

from recordloom.operators import layout, quality, tables
from recordloom.plans.catalog import queries


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_conditional_upsert_keeps_three_valued_logic(spark):
    old = spark.createDataFrame([(1, "a", "p"), (2, "b", None), (3, "c", "p"), (4, "d", "p")], "k int, v string, h string")
    new = spark.createDataFrame([(1, "A", "q"), (2, "B", None), (3, "C", None), (5, "E", "q")], "k int, v string, h string")
    once = tables.upsert_when_changed(old, new, ["k"], "h")
    assert rows(once) == [(1, "A", "q"), (2, "B", None), (3, "c", "p"), (4, "d", "p"), (5, "E", "q")]
    assert rows(tables.upsert_when_changed(once, new, ["k"], "h")) == rows(once)


def test_insert_only_is_idempotent_and_dedupes(spark):
    table = spark.createDataFrame([("x", 1)], "h string, d int")
    new = spark.createDataFrame([("x", 9), ("y", 3), ("y", 2)], "h string, d int")
    out = tables.insert_only(table, new, ["h"], [F.col("d")])
    assert rows(out) == [("x", 1), ("y", 2)] == rows(tables.insert_only(out, new, ["h"], [F.col("d")]))


def test_history_and_versions(spark):
    changes = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 5, "b"), (2, 3, "c")], "k int, v int, s string")
    h = tables.history(tables.only_changes(changes, ["k"], "v", ["s"]), ["k"], "v")
    assert rows(tables.at_version(h, 4).select("k", "s")) == [(1, "a"), (2, "c")]
    assert tables.latest_version(h).first().version == 5
    assert rows(tables.retained(h, 6).select("k", "s")) == [(1, "b"), (2, "c")]


def test_cache(spark):
    r = spark.createDataFrame([("m", "x"), ("m", "y")], "model string, content string")
    cache = r.where("content = 'x'").select(tables.cache_key(["model", "content"]).alias("cache_key"), F.lit("{}").alias("answer"))
    out = {x.content: (x.cached, x.cost) for x in tables.with_cache(r, cache, ["model", "content"], F.lit(2.0)).collect()}
    assert out == {"x": (True, 0.0), "y": (False, 2.0)}


def test_gate(spark):
    df = spark.createDataFrame([(1, 0.5, None), (1, 1.5, "x"), (3, None, "y")], "id int, c double, s string")
    bad = quality.gate(quality.outside(df, "c", 0, 1, "id"), quality.repeated(df, ["id"]), quality.null_in(df, ["c", "s"], "id"), quality.orphans(df, df.where("id = 1"), "id", "id", "id"))
    assert rows(bad) == [("not_null_c", "3"), ("not_null_s", "1"), ("orphan_id", "3"), ("range_c", "1"), ("unique_id", "1")]
    assert not quality.passes(bad) and quality.passes(bad.limit(0))


def test_layout_keeps_rows(spark):
    df = spark.range(1000).select(F.col("id").alias("a"), (F.col("id") * 7 % 1000).alias("b"), F.lit(2 << 20).alias("size"))
    assert layout.z_ordered(df, ["a", "b"], 4).agg(F.sum("a"), F.count("*")).first()[:] == (499500, 1000)
    bins = layout.by_weight(df, "size", "a", ["a"], 8).groupBy("bin").count().collect()
    assert sorted(r["count"] for r in bins) == [125] * 8
    assert layout.skew(df.limit(0), "size").first().partitions == 0


def test_several_incoming_rows_of_a_key(spark):
    old = spark.createDataFrame([(1, "a", "p")], "k int, v string, h string")
    new = spark.createDataFrame([(1, "B", "q"), (1, "C", "r"), (2, "D", None)], "k int, v string, h string")
    for f in (lambda **o: tables.upsert_when_changed(old, new, ["k"], "h", **o), lambda **o: tables.upsert_replace(old, new, ["k"], **o), lambda **o: tables.changes(old, new, ["k"], "h", **o)):
        with pytest.raises(SparkException, match="several incoming rows of one key: k = 1"):
            f().collect()
        with pytest.raises(SparkException, match="k = 1"):
            f().select("k").collect()
        assert [r for r in rows(f(order=[F.col("v")])) if r[0] == 1] == [(1, "B", "q")]
    assert rows(tables.upsert_replace(old, new.where("v <> 'C'"), ["k"])) == [(1, "B", "q"), (2, "D", None)]
    assert {tuple(r) for r in tables.upsert_replace(old, spark.createDataFrame([(None, "x", "y")], new.schema), ["k"]).collect()} == {(1, "a", "p"), (None, "x", "y")}


def test_strings_are_laid_out_in_their_own_order(spark, tmp_path):
    names = [f"doc-{i:08d}" for i in range(20_000)]
    df = spark.createDataFrame([(n, f"https://host/{i % 50:03d}", i % 3 == 0) for i, n in enumerate(names)], "document_id string, url string, flag boolean").repartition(5)
    alone = layout.z_ordered(df, ["document_id"], 8).select("document_id", F.spark_partition_id().alias("p")).groupBy("p").agg(F.min("document_id").alias("low"), F.max("document_id").alias("high")).orderBy("low").collect()
    assert len(alone) == 8 and sum(a.high >= b.low for a, b in zip(alone, alone[1:])) <= 7
    # a rank never falls where the value rises; two files share at most one boundary's values
    r = layout.ranks(df, ["document_id", "url", "flag"], 6).orderBy("document_id").collect()
    assert all(a._r0 <= b._r0 for a, b in zip(r, r[1:])) and len({x._r0 for x in r}) > 50 and len({x._r1 for x in r}) > 40 and len({x._r2 for x in r}) == 2
    layout.z_ordered(df, ["document_id", "url"], 16).drop("_z").write.parquet(f"{tmp_path}/t")
    asked = {"one": {"document_id": (names[77], names[77])}, "url": {"url": ("https://host/007", "https://host/007")}, "none": {"url": ("z", "zz")}}
    out = {x.predicate: (x.files, x.admitted) for x in layout.admitting(spark.read.parquet(f"{tmp_path}/t"), asked).collect()}
    assert out["one"][1] <= 6 and out["url"][1] <= 6 and out["none"] == (16, 0)


def test_layout_of_nulls_equal_values_and_nothing(spark):
    df = spark.createDataFrame([("same", None, i) for i in range(4000)], "a string, b string, n int")
    parts = layout.z_ordered(df, ["a", "b"], 4).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(parts) == 4 and max(x["count"] for x in parts) < 2000
    assert layout.z_ordered(df.limit(0), ["a", "n"], 4).count() == 0


def test_files_are_judged_without_a_sort(spark, tmp_path):
    spark.createDataFrame([("b", 1.0), ("d", float("nan"))], "s string, x double").coalesce(1).write.parquet(f"{tmp_path}/t")
    spark.createDataFrame([(None, None), ("f", 2.0)], "s string, x double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/t")
    spark.createDataFrame([(None, None)], "s string, x double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/t")
    asked = {"gap": {"s": ("c", "c")}, "low": {"s": ("a", "b")}, "high": {"s": ("f", "z")}, "number": {"x": (3.0, 4.0)}, "both": {"s": ("c", "c"), "x": (2.0, 2.0)}, "none": {}}
    out = layout.admitting(spark.read.parquet(f"{tmp_path}/t"), asked)
    assert {r.predicate: (r.files, r.admitted) for r in out.collect()} == {"gap": (3, 1), "low": (3, 1), "high": (3, 1), "number": (3, 1), "both": (3, 1), "none": (3, 3)}
    assert "Sort" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_tasks_of_a_keyed_write_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_A_TASK", 100, raising=False)
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    out = queries()["upsert_replace"](spark, "/root/testdata/sf0.001")
    assert out.rdd.getNumPartitions() >= lines // 100


def test_parts_are_put_together_from_splits(spark, tmp_path, monkeypatch):
    many, one, uneven = (f"{tmp_path}/{x}/lineitem.parquet" for x in ("many", "one", "uneven"))
    spark.range(1600).repartition(16).write.parquet(many)
    spark.range(1600).coalesce(1).write.parquet(one)
    spark.range(1600).coalesce(1).write.parquet(uneven)
    spark.range(10).repartition(10).write.mode("append").parquet(uneven)
    bytes_a_split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")  # a split for each file
    try:
        for folder, n, dealt in ((many, 1600, False), (one, 1600, True), (uneven, 1610, True)):
            out = layout.in_parts(spark.read.parquet(folder), 8)
            assert ("Exchange" in out._jdf.queryExecution().executedPlan().toString()) == dealt
            assert sorted(r.id for r in out.collect()) == sorted(r.id for r in spark.read.parquet(folder).collect())
            assert queries()["table_detail"](spark, folder.rpartition("/")[0]).first().asDict() == {"n_files": 8, "n_rows": n}
        assert layout.in_parts(spark.read.parquet(many).where("id < 0"), 8).count() == 0
        monkeypatch.delattr(type(spark.range(0)), "repartition")
        assert tuple(queries()["table_detail"](spark, f"{tmp_path}/many").first()) == (8, 1600)  # no row is dealt
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_a_split)
