import pytest
from pyspark.sql import functions as F

from recordloom.plans import daily
from recordloom.sources import io


def arrivals(spark, *rows):
    rows = rows or [("a", "a.csv", "h1", "text/csv", 10), ("b", "b.csv", "h1", "text/csv", 10), ("c", "c.zip", "h2", "application/zip", 10)]
    return spark.createDataFrame(list(rows), "document_id string, filename string, content_hash string, mime string, size_bytes long")


def extractor(confidence, prompt="p1", path="/x"):
    return lambda docs: docs.select("document_id", F.lit(1).alias("section"), F.lit(path).alias("path"), F.lit(prompt).alias("value"), F.lit(confidence).alias("confidence"), F.lit(prompt).alias("prompt_hash"), F.lit(0.5).alias("cost"))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_second_day_keeps_the_first(spark, tmp_path):
    base = f"file://{tmp_path}/lake"
    assert daily.run(spark, base, arrivals(spark), extractor(0.9), "2024-01-01") == 1
    assert rows(io.log(spark, base, "quarantine"), "document_id", "reason", "version") == [("c", "mime_not_allowed", 1)]
    more = arrivals(spark, ("a", "a.csv", "h1", "text/csv", 10), ("d", "d.csv", "h3", "text/csv", 5))
    assert daily.run(spark, base, more, extractor(0.8, "p2"), "2024-01-02", "r2") == 2
    gold = lambda upto=None: rows(daily.current(spark, base, "gold", upto), "document_id", "record_json", "silver_version", "run_id")
    assert gold() == [("a", '{"/x":"p1"}', 1, None), ("d", '{"/x":"p2"}', 2, "r2")]
    # the same again adds nothing
    assert daily.run(spark, base, more, extractor(0.8, "p2"), "2024-01-03") == 3 and gold(3) == gold(2)
    # extracted again by another prompt, with a new field
    daily.run(spark, base, more.limit(0), extractor(0.7, "p4"), "2024-01-04", again=spark.createDataFrame([("a",)], "document_id string"))
    daily.run(spark, base, more.limit(0), extractor(0.7, "p4", "/y"), "2024-01-05", again=spark.createDataFrame([("a",)], "document_id string"))
    assert gold()[0][:3] == ("a", '{"/x":"p4","/y":"p4"}', 5) and gold(3)[0][1] == '{"/x":"p1"}'
    assert rows(io.published(spark, base), "version", "bronze_count", "fields_extracted", "extraction_cost", "gold_count") == [(1, 1, 1, 0.5, 1), (2, 1, 1, 0.5, 1), (3, 0, 0, 0.0, 0), (4, 0, 1, 0.5, 1), (5, 0, 1, 0.5, 1)]
    assert all(daily.reproduced(spark, base, v).count() == 0 for v in range(1, 6))
    # versions before the fourth are one
    out = daily.retained(spark, base, f"{base}-kept", 4)
    assert rows(out, "layer", "versions_before", "versions_after") == [(x, 5, 2) for x in ("bronze", "gold", "quarantine", "silver")]
    kept = f"{base}-kept"
    assert rows(daily.current(spark, kept, "gold"), "document_id", "record_json") == [g[:2] for g in gold()] and daily.current(spark, kept, "gold", 3) is None
    assert rows(daily.current(spark, kept, "silver", 4), "document_id", "value") == rows(daily.current(spark, base, "silver", 4), "document_id", "value")
    assert daily.run(spark, kept, more, extractor(0.8), "2024-01-06") == 6


def test_gate_blocks(spark, tmp_path):
    base = f"file://{tmp_path}/lake"
    with pytest.raises(daily.Rejected):
        daily.run(spark, base, arrivals(spark), extractor(0.2), "2024-01-01")
    assert io.published(spark, base) is None and daily.current(spark, base, "gold") is None
    assert spark.read.parquet(f"{base}/gate").count() == 1
    assert daily.run(spark, base, arrivals(spark), extractor(0.9), "2024-01-01") == 1  # what the blocked run staged is replaced
    assert daily.current(spark, base, "gold").count() == 1


def test_tampered_silver_is_found(spark, tmp_path):
    base = f"file://{tmp_path}/lake"
    daily.run(spark, base, arrivals(spark), extractor(0.9), "2024-01-01")
    silver = spark.read.parquet(f"{base}/silver/version=1")
    changed = spark.createDataFrame(silver.withColumn("value", F.lit("other")).collect(), silver.schema)
    io.stage(changed, base, "silver", 1)
    assert sorted(r.side for r in daily.reproduced(spark, base, 1).collect()) == ["again", "stored"]


def test_compaction(spark, tmp_path):
    spark.range(100).withColumn("b", F.col("id") % 7).repartition(10).write.parquet(f"{tmp_path}/in/silver")
    out = {r.layer: (r.files_after, r.status) for r in daily.compacted(spark, f"{tmp_path}/in", f"{tmp_path}/out", {"silver": ["id", "b"], "gold": ["id"]}, 2).collect()}
    assert out["silver"] == (2, "done") and out["gold"][1].startswith("skipped")
    assert spark.read.parquet(f"{tmp_path}/out/silver").count() == 100


def test_io(spark, tmp_path):
    base = f"file://{tmp_path}/lake"
    day = lambda d, **more: spark.createDataFrame([(f"x{d}", d)], "document_id string, ingest_date string").withColumns({k: F.lit(v) for k, v in more.items()})
    io.write_layer(day("2024-01-01"), base, "bronze")
    io.write_layer(day("2024-01-02"), base, "bronze")
    assert rows(io.read_layer(spark, base, "bronze"), "document_id") == [("x2024-01-01",), ("x2024-01-02",)]
    assert rows(io.read_layer(spark, base, "bronze", "2024-01-02"), "document_id") == [("x2024-01-02",)]
    io.write_layer(day("2024-01-01"), base, "silver")
    day("2024-01-02", extra="new").write.mode("append").parquet(f"{base}/silver")
    assert rows(io.read_layer(spark, base, "silver"), "document_id", "extra")[1] == ("x2024-01-02", "new")  # the schema grows
    with pytest.raises(ValueError, match="no layer"):
        io.read_layer(spark, base, "copper")
    (tmp_path / "docs" / "in").mkdir(parents=True)
    for name in ("a.pdf", "b.csv", "c.exe"):
        (tmp_path / "docs" / "in" / name).write_bytes(name.encode())
    found = rows(io.read_documents(spark, f"{tmp_path}/docs"), "content", "size_bytes", "content_hash")
    assert [bytes(r[0]) for r in found] == [b"a.pdf", b"b.csv"] and all(r[1] == 5 and len(r[2]) == 64 for r in found)
    for arm in ("manual", "tool"):
        (tmp_path / f"{arm}.json").write_text(f'{{"arm": "{arm}", "results": [{{"document": 1, "seconds": 5}}, {{"document": 2, "seconds": 7}}]}}')
    assert rows(io.read_results(spark, f"{tmp_path}/*.json"), "arm", "document", "seconds") == [("manual", 1, 5), ("manual", 2, 7), ("tool", 1, 5), ("tool", 2, 7)]
    io.write_lines(spark.createDataFrame([('{"a":1}',)], "line string"), f"{tmp_path}/lines")
    assert spark.read.text(f"{tmp_path}/lines").first().value == '{"a":1}'


def test_a_day_that_is_run_again(spark, tmp_path):
    base = f"file://{tmp_path}/lake"
    assert daily.run(spark, base, arrivals(spark), extractor(0.9), "2024-01-01") == 1
    assert daily.run(spark, base, arrivals(spark), extractor(0.9), "2024-01-01") == 1  # nothing new, no version
    more = arrivals(spark, ("d", "d.csv", "h3", "text/csv", 5))
    assert daily.run(spark, base, more, extractor(0.9), "2024-01-01") == 2
    assert rows(daily.metrics(spark, base), "run_date", "version", "bronze_count", "gold_count") == [("2024-01-01", 2, 2, 2)]
    daily.staging_view(spark, base, "stg")
    view = spark.table("stg")
    assert len(view.columns) == 17 and rows(view, "document_id", "field_path", "source_page") == [("a", "/x", None), ("d", "/x", None)]
    again = rows(daily.reproduced_all(spark, base), "version", "document_id", "record_json")
    assert again == [(1, "a", '{"/x":"p1"}'), (2, "d", '{"/x":"p1"}')]
