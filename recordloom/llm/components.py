"""Connected components by alternating large and small stars; every round is written, none is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b), a > b. Large: each node's larger neighbours point to its least; small: its smaller ones and itself do."""
    around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = written(around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    joined = around.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
    return written(out.where("a <> b").distinct(), "star")


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """node, root: the least node of each component, for the nodes of ``links`` (a, b)."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    known = None
    for _ in range(rounds):
        edges = _star(_star(edges, True), False)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == known:
            break
        known = state
    else:
        raise RuntimeError("components did not settle")
    return written(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root")), "components")
