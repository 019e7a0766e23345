"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), each a join and an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _least(rows: DataFrame) -> DataFrame:
    return rows.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``edges`` of two longs to (node, component): the least node that can be reached, for every node of an edge between two
    different nodes.  Null ends are left out; edges may repeat and point either way.  Each step is written to the shared folder."""
    now = durable(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    mark = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = _least(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small = large.join(_least(large), "u")  # v < u in each row already
        now = durable(small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == mark:
            break
        mark = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
