"""The related graph: hops, reciprocity, in-degree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hops(edges: DataFrame, seeds: DataFrame, most: int, group: str | None = None) -> DataFrame:
    """Documents within `most` hops of the seeds: doc, hop and via, each once, the seeds never.

    edges: src, dst, pos. seeds: doc, seed_no (and a group column for several walks at once). `via` is the first
    discoverer in breadth-first order: paths are compared by (seed_no, pos, pos, ...). One join for each hop; only the
    newly found go on.
    """
    keys = [group] if group else []
    start = seeds.select(*keys, "doc", F.array(F.col("seed_no").cast("long")).alias("order")).groupBy(*keys, "doc").agg(F.min("order").alias("order"))
    seen, frontier = start.select(*keys, "doc"), start
    found: list[DataFrame] = []
    steps = edges.select(F.col("src").alias("doc"), "dst", F.col("pos").cast("long").alias("pos"))
    for hop in range(1, most + 1):
        reached = frontier.join(steps, "doc").select(*keys, F.col("dst").alias("next"), F.concat("order", F.array("pos")).alias("order"), F.col("doc").alias("via"))
        first = reached.groupBy(*keys, "next").agg(F.min(F.struct("order", "via")).alias("_m"))
        new = first.select(*keys, F.col("next").alias("doc"), F.col("_m.order").alias("order"), F.col("_m.via").alias("via")).join(seen, [*keys, "doc"], "left_anti")
        found.append(new.select(*keys, "doc", F.lit(hop).alias("hop"), "via"))
        frontier = new.select(*keys, "doc", "order")
        seen = seen.unionByName(new.select(*keys, "doc"))
    if not found:
        return seeds.select(*keys, "doc", F.lit(0).alias("hop"), F.col("doc").alias("via")).limit(0)
    return reduce(lambda a, b: a.unionByName(b), found)


def inverted(edges: DataFrame) -> DataFrame:
    """For each target the set of documents that refer to it, ordered."""
    return edges.groupBy("dst").agg(F.array_sort(F.collect_set("src")).alias("sources"))


def one_way(edges: DataFrame) -> DataFrame:
    """Edges whose reverse is not there."""
    return edges.join(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct(), ["src", "dst"], "left_anti")


def search_with_hops(found: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """Hits (query_id, id, rank) with the documents that hops from them reach."""
    seeds = found.select("query_id", F.col("id").alias("doc"), F.col("rank").alias("seed_no"))
    return hops(edges, seeds, most, "query_id")
