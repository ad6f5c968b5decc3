"""Connected components of a large graph, by large-star and small-star rounds (Kiveris et al., 2014).

Each round is two grouped minima and joins on the node; a hot node is a hot join key whose partitions
Spark splits, and nothing is gathered. Each round's edges are cut into the checkpoint folder. The
number of rounds grows with the logarithm of the node count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagepress.llm.common import cut


def _star(arcs: DataFrame) -> DataFrame:
    """Arcs (u, v) with the least of u and its neighbours v as ``m``."""
    least = arcs.groupBy("u").agg(F.min("v").alias("least"))
    least = least.select(F.col("u").alias("_u"), F.least("u", "least").alias("m"))
    return arcs.join(least, F.col("u") == F.col("_u")).select("u", "v", "m")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both).filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Edges lead from the larger node to the smaller."""
    arcs = _star(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    linked = arcs.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(arcs.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for all nodes of edges (a, b).

    Loops and repeated edges do not matter; edges with a null end are left out.
    """
    pairs = edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v"))
    state = cut(pairs.filter("u <> v").distinct())
    before = None
    while True:
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).collect()[0]
        if now == before:
            break
        before = now
        if not now[0]:
            break
        state = cut(_small(_large(state)))
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
