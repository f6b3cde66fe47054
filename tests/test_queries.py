import os

import duckdb
import pytest

from recordloom.operators import tables
from recordloom.plans.catalog import oracle_sql, queries

SF = "/root/testdata/sf0.001"
NAMES = ["gold_conform", "proposal_merge_conflict", "upsert_conditional", "asof_version", "token_slots", "commit_gate", "daily_event_counts", "stream_landing", "export_lines", "table_overlap_antijoin", "daily_gold", "gold_reproduction", "nested_validation", "csv_header_merge", "state_changes", "zorder_layout", "lane_slots"]


def test_every_query_has_sql():
    assert set(oracle_sql()) == set(queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    df = queries()[name](spark, SF)
    r = c.execute(oracle_sql()[name])
    order = sorted(df.columns)
    at = [[d[0] for d in r.description].index(k) for k in order]
    text = lambda x: repr(round(x, 6)) if isinstance(x, float) else str(x)
    assert sorted(tuple(text(x[k]) for k in order) for x in df.collect()) == sorted(tuple(text(x[i]) for i in at) for x in r.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["verification_marks", "review_queue"])
def test_tasks_of_merged_fields_grow_in_number(spark, monkeypatch, name):
    monkeypatch.setattr(tables, "ROWS_A_TASK", 100)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert queries()[name](spark, SF).rdd.getNumPartitions() >= lines // 100
    test_against_sql(spark, name)
