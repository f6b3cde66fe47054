"""Rate and cost limits as plans over a table of requests: earliest starts, minute slots, admission, refunds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import maxplus
from recordloom.functions.prefix import running_sums

# Requests and tokens a minute, and USD a run.
REQUESTS_A_MINUTE, TOKENS_A_MINUTE, CEILING = 50, 100_000, 50.0


def wait(need: Column, available: Column, per_minute: float) -> Column:
    """Seconds until a bucket that refills evenly holds what is needed."""
    return F.greatest(F.lit(0.0), (need - available) / F.lit(per_minute / 60.0))


def _start(requests: Column, tokens: Column, rpm: float, tpm: float) -> Column:
    return F.greatest(F.lit(0.0), (requests - rpm) / F.lit(rpm / 60.0), (tokens - tpm) / F.lit(tpm / 60.0))


def oversize(requests: DataFrame, tpm: float = TOKENS_A_MINUTE) -> DataFrame:
    """Requests that need more than a full bucket would wait for ever: for quarantine."""
    return requests.where(F.col("tokens") > tpm).withColumn("reason", F.lit("oversize_request"))


def token_slots(requests: DataFrame, order: list[str], rpm: float = REQUESTS_A_MINUTE, tpm: float = TOKENS_A_MINUTE, debts: bool = False) -> DataFrame:
    """start_s, the earliest second at which both full buckets let a request through, and its minute. Requests that no bucket can hold are left out (see ``oversize``); with ``debts`` they start once the refill since the beginning has covered them."""
    ok = requests.where(F.lit(True) if debts else F.col("tokens") <= tpm).withColumn("_one", F.lit(1))
    summed = running_sums(ok, order, {"_cum_requests": "_one", "_cum_tokens": "tokens"})
    start = _start(F.col("_cum_requests"), F.col("_cum_tokens"), rpm, tpm)
    return summed.withColumn("start_s", start).withColumn("minute", F.floor(F.col("start_s") / 60)).drop("_one", "_cum_requests", "_cum_tokens")


def bucket_slots(requests: DataFrame, order: list[str], by: list[str] | None = None, rpm: float = REQUESTS_A_MINUTE, tpm: float = TOKENS_A_MINUTE) -> DataFrame:
    """start_s and wait_s of requests that arrive over time (arrival_s, seconds; null or absent: 0) and are let through one after the other in ``order`` (unique), with buckets of their own for each value of ``by``.

    Both buckets are full at first, refill evenly, and never hold more than a minute's worth. A request starts once it has arrived, the one before it has started (and taken its duration_s, if there is such a column), and both buckets hold what
    it needs. With a column refund, that many tokens (at most those taken) come back when it ends, up to the cap. Requests that no full bucket can hold are left out: see ``oversize``.

    A bucket is told by the second at which it will be full again: with c taken at s it becomes max(full, s) + c / rate, and c is there from full - (cap - c) / rate on. That and the end of the request before are greatest values of sums, so ``maxplus.scanned``
    computes them over ranges of the order."""
    r1, r2, have = rpm / 60.0, tpm / 60.0, {c.lower() for c in requests.columns}
    number = lambda c: (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)).alias(f"_{c}")
    ok = requests.where(F.col("tokens") <= tpm).select("*", number("arrival_s"), number("duration_s"), F.least(number("refund"), F.col("tokens").cast("double")).alias("_refund"), F.col("tokens").cast("double").alias("_tokens"))

    def matrices(b: pa.RecordBatch) -> np.ndarray:
        arrival, duration, refund, tokens = (b.column(f"_{c}").to_numpy() for c in ("arrival_s", "duration_s", "refund", "tokens"))
        zero = np.zeros(b.num_rows)
        # the start, from: end of the one before, first and second bucket full again, and what doesn't depend on the state
        start = np.stack([zero, zero + (1 - rpm) / r1, (tokens - tpm) / r2, arrival], 1)
        first = start + 1 / r1
        first[:, 1] = np.maximum(first[:, 1], 1 / r1)
        left = (tokens - refund) / r2
        second = start + np.maximum(left, duration)[:, None]
        second[:, 2] = np.maximum(second[:, 2], left)
        last = np.full_like(start, maxplus.NEVER)
        last[:, 3] = 0
        return np.stack([start + duration[:, None], first, second, last], 1)

    s = maxplus.scanned(ok, order, matrices, [0.0, 0.0, 0.0, 0.0], by)
    state = lambda k: F.get("state", F.lit(k))
    start = F.greatest(F.col("_arrival_s"), state(0), state(1) + F.lit((1 - rpm) / r1), state(2) + (F.col("_tokens") - tpm) / F.lit(r2))
    return s.withColumn("start_s", start).withColumn("wait_s", F.col("start_s") - F.col("_arrival_s")).select(*requests.columns, "start_s", "wait_s")


def laned(requests: DataFrame, key: str, lanes: int) -> DataFrame:
    """A request belongs to the lane of its key (its number, or its hash) by remainder."""
    number = F.col(key) if dict(requests.dtypes)[key] in ("bigint", "int") else F.hash(key)
    return requests.withColumn("lane", F.pmod(number, F.lit(lanes)))


def lane_slots(requests: DataFrame, key: str, order: list[str], lanes: int, rpm: float = REQUESTS_A_MINUTE, tpm: float = TOKENS_A_MINUTE, debts: bool = False) -> DataFrame:
    """Each lane has its share of the limits: start_s of the requests that a lane's bucket can hold; see ``lane_oversize`` for the others. With ``debts`` these start too, once the refill since the beginning has covered them. However few lanes there are, the sums run over ranges of their orders."""
    ok = laned(requests, key, lanes).where(F.lit(True) if debts else F.col("tokens") <= tpm / lanes).withColumn("_one", F.lit(1))
    summed = running_sums(ok, order, {"_cum_requests": "_one", "_cum_tokens": "tokens"}, by=["lane"])
    return summed.withColumn("start_s", _start(F.col("_cum_requests"), F.col("_cum_tokens"), rpm / lanes, tpm / lanes)).drop("_one", "_cum_requests", "_cum_tokens")


def lane_oversize(requests: DataFrame, key: str, lanes: int, tpm: float = TOKENS_A_MINUTE) -> DataFrame:
    """Requests that need more than a full bucket of their lane: for quarantine."""
    return oversize(laned(requests, key, lanes), tpm / lanes)


def lane_bucket_slots(requests: DataFrame, key: str, order: list[str], lanes: int, rpm: float = REQUESTS_A_MINUTE, tpm: float = TOKENS_A_MINUTE) -> DataFrame:
    """``bucket_slots`` of each lane, which has its share of the limits; lanes are runs of one order, so few lanes still make many ranges."""
    return bucket_slots(laned(requests, key, lanes), order, ["lane"], rpm / lanes, tpm / lanes)


def admitted(requests: DataFrame, order: list[str], ceiling: float = CEILING) -> DataFrame:
    """A request is admitted while the cost of those before it is below the ceiling."""
    summed = running_sums(requests, order, {"_cum": "cost"})
    return summed.withColumn("admitted", F.col("_cum") - F.col("cost") < ceiling).drop("_cum")


def refunds(usage: DataFrame) -> DataFrame:
    """What an overestimate gives back; underestimates are ignored."""
    return usage.withColumn("refund", F.greatest(F.col("estimated") - F.col("actual"), F.lit(0)))


def limiter_statistics(slots: DataFrame, ceiling: float = CEILING) -> DataFrame:
    g = slots.agg(F.count("*").alias("requests"), F.count_if(F.col("start_s") > 0).alias("throttled"), F.round(F.max("start_s"), 2).alias("wait_s"), F.round(F.sum("cost"), 4).alias("cost"))
    return g.withColumn("ceiling", F.lit(ceiling)).withColumn("per_minute", F.when(F.col("wait_s") > 0, F.round(F.col("requests") / (F.col("wait_s") / 60), 4)))
