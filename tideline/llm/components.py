"""Connected components by alternating large-star and small-star, with hubs of any size.

Every step joins the edges to one row per node (its smallest neighbour); the rows of nodes with more than 1/256 of the edges
meet a broadcast of those fewer than 256 rows, so a hub that holds a third of all edges is not gathered in one task. The
edges are written to the shared folder after each step.

Before the first step nodes with one edge, to a smaller node, are set aside: they have the root of that neighbour and can change
nobody's. Where most entities are seen once, what is stepped over is a small part of the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.plans.skew import join_unique
from tideline.session import Rounds, cut_lineage


def _large_star(e: DataFrame, n: int) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return join_unique(both.filter("v > u"), least, "u", "inner", total=n).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(e: DataFrame, n: int) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = join_unique(down, least, "u", "inner", total=n).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node of its component. Nulls and loops are dropped.

    Nodes are of any one type with an order. No edges give no rows. Raises if it has not settled after ``rounds`` rounds
    (the number of rounds grows with the logarithm of the number of nodes).
    """
    e = edges.select("u", "v").filter("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = cut_lineage(e)
    single = e.select(F.explode(F.array("u", "v")).alias("u")).groupBy("u").agg(F.count("*").alias("deg")).filter("deg = 1")
    e = cut_lineage(e.join(single, "u", "left").select("u", "v", F.col("deg").isNotNull().alias("leaf")))
    leaves = e.filter("leaf").select(F.col("u").alias("node"), "v")
    core = _settle(e.filter("not leaf").select("u", "v"), rounds)
    roots = core.select(F.col("node").alias("v"), "root")
    hung = join_unique(leaves, roots, "v", "left").select("node", F.coalesce("root", "v").alias("root"))
    alone = leaves.select("v").distinct().join(roots, "v", "left_anti").select(F.col("v").alias("node"), F.col("v").alias("root"))
    return core.unionByName(hung).unionByName(alone)


def _settle(e: DataFrame, rounds: int) -> DataFrame:
    table = Rounds()
    # Taken from the edges of each step: when both stay, the steps have settled.
    state = {"n": F.count("*"), "h": F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))}
    e, before = table.put(e, **state)
    for _ in range(rounds):
        if before["n"] == 0:
            break
        e, now = table.put(_small_star(_large_star(e, before["n"]), before["n"]), **state)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    # Settled: every node but the roots has one edge, to its root.
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
