"""Connected components of a distributed edge list, without collecting it: large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _least(directed: DataFrame, upto: bool) -> DataFrame:
    """For each u the least of itself and its neighbours, aggregated before the shuffle, joined back to the edges."""
    low = directed.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
    both = directed.join(low, "u")
    if upto:  # neighbours not above u go to the least of them, and so does u
        moved = both.select(F.col("v").alias("u"), F.col("low").alias("v"))
        return moved.unionByName(low.select("u", F.col("low").alias("v")))
    return both.filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of an edge; the component is its least node. Nulls and loops are dropped."""
    now = checkpoint(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct())
    seen = None
    if not now.take(1):
        most_rounds = 0
    for _ in range(most_rounds):
        twice = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(twice.distinct(), False).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        now = checkpoint(_least(down, True).filter("u <> v").distinct())
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    else:
        if most_rounds:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    # settled edges are stars around the least node
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
