"""Exact counts per key by hash, without ranking whole keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def take_smallest(df: DataFrame, keys: list[str], u: Column, want: str, tie: str, ranges: int = 4096) -> DataFrame:
    """Of each key the ``want`` rows with the smallest u in [0, 1): counts per range of u show in which range the cut falls, and
    only that one is ranked."""
    d = df.withColumn("_u", u).withColumn("_b", F.floor(F.col("_u") * ranges))
    c = d.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(c.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))), [*keys, "_b"])
    sure = d.filter(F.col("_before") + F.col("_c") <= F.col(want))
    edge = d.filter((F.col("_before") < F.col(want)) & (F.col("_before") + F.col("_c") > F.col(want)))
    edge = edge.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_u", tie))).filter(F.col("_before") + F.col("_r") <= F.col(want)).drop("_r")
    return sure.unionByName(edge).drop("_u", "_b", "_c", "_before")
