import random

import numpy as np
import pytest

from recordloom.functions import maxplus
from recordloom.operators import budget


def slots(requests, rpm, tpm):
    """One request after the other, with the buckets' levels."""
    cap1, cap2, now, at, l1, l2 = rpm, tpm, 0.0, 0.0, rpm, tpm
    for arrival, tokens, duration, refund in requests:
        start = max(arrival, now)
        level = lambda lv, cap, rate, t: min(cap, lv + (t - at) * rate / 60)  # noqa: B023, E731
        start = max(start, start + (1 - level(l1, cap1, rpm, start)) * 60 / rpm, start + (tokens - level(l2, cap2, tpm, start)) * 60 / tpm)
        l1, l2, at = level(l1, cap1, rpm, start) - 1, level(l2, cap2, tpm, start) - tokens, start
        yield start
        now = start + duration
        l1, l2, at = level(l1, cap1, rpm, now), min(cap2, level(l2, cap2, tpm, now) + min(refund, tokens)), now


def made(seed, n):
    r, t, out = random.Random(seed), 0.0, []
    for i in range(n):
        t += r.choice([0, 0, 0, 0.1, 2, 90 if i % 40 == 0 else 0])
        out.append((i, t, r.choice([1, 10, 300, 900]), r.choice([0.0, 0.0, 1.5]), r.choice([0, 5, 2000])))
    return out


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_bucket_slots(spark, partitions):
    rows = made(5, 400)
    df = spark.createDataFrame(rows, "id int, arrival_s double, tokens int, duration_s double, refund int").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        out = {r.id: r.start_s for r in budget.bucket_slots(df, ["id"], rpm=30, tpm=1000).collect()}
        lanes = {r.id: (r.lane, r.start_s, r.wait_s) for r in budget.lane_bucket_slots(df, "id", ["id"], 3, 90, 3000).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [out[i] for i in range(400)] == pytest.approx(list(slots([r[1:] for r in rows], 30, 1000)), abs=1e-6)
    for lane in range(3):
        own = [r for r in rows if r[0] % 3 == lane]
        assert [lanes[r[0]][1] for r in own] == pytest.approx(list(slots([r[1:] for r in own], 30, 1000)), abs=1e-6)
        assert all(lanes[r[0]][2] == pytest.approx(lanes[r[0]][1] - r[1]) for r in own)


def test_fixtures(spark):
    """Ten at once pass, the eleventh waits; after the bucket is empty five need five refills; a gap fills it up to the cap and no further."""
    df = spark.createDataFrame([(i, 0.0) for i in range(11)] + [(11, 10_000.0)] + [(12 + i, 10_000.0) for i in range(11)], "id int, arrival_s double").selectExpr("*", "1 as tokens")
    out = {r.id: r.start_s for r in budget.bucket_slots(df, ["id"], rpm=10, tpm=10_000).collect()}
    assert [out[i] for i in range(10)] == [0.0] * 10 and out[10] == pytest.approx(6.0)
    assert [out[i] for i in range(11, 21)] == [10_000.0] * 10 and out[21] == pytest.approx(10_006.0)
    wait = spark.createDataFrame([(0, 60), (1, 5)], "id int, tokens int")
    assert budget.bucket_slots(wait, ["id"], rpm=1000, tpm=60).orderBy("id").collect()[1].start_s == pytest.approx(5.0)
    assert budget.bucket_slots(wait.limit(0), ["id"]).count() == 0
    odd = spark.createDataFrame([(0, None, 200_000), (1, None, 5)], "id int, arrival_s double, tokens int")
    assert [tuple(r) for r in budget.bucket_slots(odd, ["id"]).select("id", "start_s").collect()] == [(1, 0.0)]


def test_products_are_associative():
    m = np.random.default_rng(1).normal(size=(37, 3, 3))
    m[5, 1, 2] = maxplus.NEVER
    one = m[0]
    for k, p in enumerate(maxplus.running_products(m)):
        one = maxplus.product(m[k], one) if k else m[0]
        assert np.allclose(p, one)


def test_debts_keep_requests_that_no_bucket_holds(spark, tmp_path):
    from recordloom.plans.catalog import queries

    spark.createDataFrame([(4, 300, 2), (8, 140_000, 2), (12, 300, 2), (16, 1_700_000, 2), (17, 300, 2)], "doc_id long, n_chars long, x int").write.parquet(f"{tmp_path}/documents.parquet")
    seconds = lambda n: max(0.0, round((n - 25_000) / (25_000 / 60), 6))
    lanes = {r.request_id: (r.lane, r.start_s) for r in queries()["lane_slots"](spark, str(tmp_path)).collect()}
    assert lanes == {4: (0, 0.0), 8: (0, seconds(575 + 35_500)), 12: (0, seconds(2 * 575 + 35_500)), 16: (0, seconds(2 * 575 + 35_500 + 425_500)), 17: (1, 0.0)}
    assert sorted(r.request_id for r in queries()["token_slots"](spark, str(tmp_path)).collect()) == [4, 8, 12, 16, 17]
