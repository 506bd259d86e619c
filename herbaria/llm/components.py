"""Distributed union-find: connected components of an edge table.

Alternating large-star and small-star rounds on grouped minima. Every round is
joins and hash aggregates on (u, v) pairs; partial aggregation reduces a hub
before the shuffle and AQE splits its rows in the join. Each round is written
to the shared checkpoint folder, so lineage stays short and a lost executor
costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herbaria.llm.common import cut, drop_cut


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct())


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    rest = e.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return low.select("u", F.col("m").alias("v")).unionByName(rest).distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Return (node, component): the smallest node reachable, for every node with an edge.

    ``edges`` holds pairs of one orderable type in columns ``a`` and ``b``;
    repeated pairs, either direction and self pairs are fine, pairs with a null
    are ignored. Nodes without an edge to another node do not appear.
    """
    e = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
         .filter(F.col(a).isNotNull() & F.col(b).isNotNull()).filter("u <> v").distinct())
    e = cut(e, "edges")
    while True:
        new = cut(_small_star(_large_star(e)), "edges")
        drop_cut(e)
        e = new
        # Done when the graph is a set of stars: one centre for each node, no centre below another.
        multi = e.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").limit(1)
        chain = e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1)
        if not multi.select("u").unionByName(chain.select("u")).take(1):
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
