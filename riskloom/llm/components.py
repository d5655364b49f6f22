"""Connected components by alternating large-star and small-star.

Every step is a partial aggregation (least neighbour of each node) and a join of two written tables, so a hot node's
edges are combined before they move and AQE can split its side of the join.  No edge list or component reaches the driver:
only a count and a checksum do, to see that nothing changes any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def _stars(edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """edges (u, v) with each u's least neighbour or itself, m."""
    least = store.put(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), name)
    return edges.join(least, "u"), least


def _sum(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node reachable, for each node that has an edge to another.  Nulls and loops link nothing."""
    pairs = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    now = store.put(pairs.distinct(), "edges")
    mark = _sum(now)
    while mark[0]:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        both = store.put(both, "both")
        starred, least = _stars(both, "least")
        large = store.put(starred.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        store.drop(both, least, now)
        starred, least = _stars(large, "least")
        small = starred.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = store.put(small.distinct(), "edges")
        store.drop(large, least)
        before, mark = mark, _sum(now)
        if before == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
