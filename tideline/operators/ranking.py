"""Ranks, running sums and fronts along a value, cut into ranges of the value so that no task sorts the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_by_value(df: DataFrame, keys: list[str], value: str, width: float, sums: dict[str, Column], descending: bool = False, tie: list[str] | None = None) -> DataFrame:
    """For each row the sums over the rows of its keys that come before it by value (and tie), not with it.

    Rows are cut into ranges of ``width`` of the value; the sums of ranges are added up over one row per range.
    """
    sign = -1 if descending else 1
    d = df.withColumn("_b", F.floor(F.col(value) * sign / width).cast("bigint")).withColumn("_o", F.col(value) * sign)
    for n, c in sums.items():
        d = d.withColumn(f"_x_{n}", c)
    w = Window.partitionBy(*keys, "_b").orderBy("_o", *(tie or [])).rowsBetween(Window.unboundedPreceding, -1)
    per = d.groupBy(*keys, "_b").agg(*[F.sum(f"_x_{n}").alias(f"_t_{n}") for n in sums])
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "_b", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_p_{n}") for n in sums])
    for n in sums:
        d = d.withColumn(f"_i_{n}", F.coalesce(F.sum(f"_x_{n}").over(w), F.lit(0)))
    d = d.join(per, [*keys, "_b"])
    for n in sums:
        d = d.withColumn(n, F.col(f"_p_{n}") + F.col(f"_i_{n}"))
    return d.drop("_b", "_o", *[f"_{k}_{n}" for n in sums for k in "xpi"])


def auroc(df: DataFrame, keys: list[str], score: str, positive: Column, width: float) -> DataFrame:
    """Share of (positive, negative) pairs in which the positive scores higher, ties half; null if a class is empty."""
    c = df.groupBy(*keys, score).agg(F.sum(positive.cast("bigint")).alias("_pos"), F.sum((~positive).cast("bigint")).alias("_neg"))
    c = running_by_value(c, keys, score, width, {"_below": F.col("_neg")})
    g = c.groupBy(*keys).agg(F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"), F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2)).alias("_u"))
    return g.select(*keys, F.when((F.col("_P") > 0) & (F.col("_N") > 0), F.col("_u") / (F.col("_P") * F.col("_N"))).alias("auroc"))


def average_precision(df: DataFrame, keys: list[str], score: str, positive: Column, tie: list[str], width: float) -> DataFrame:
    """Mean over the positives of the precision at their rank, by falling score; ties in the order of ``tie``."""
    d = df.withColumn("_y", positive.cast("bigint"))
    d = running_by_value(d, keys, score, width, {"hits": F.col("_y"), "rank": F.lit(1)}, descending=True, tie=tie)
    g = d.groupBy(*keys).agg(F.sum("_y").alias("P"), F.sum(F.when(F.col("_y") == 1, (F.col("hits") + 1) / (F.col("rank") + 1)).otherwise(0.0)).alias("s"))
    return g.select(*keys, F.when(F.col("P") > 0, F.col("s") / F.col("P")).alias("average_precision"))


def pareto(df: DataFrame, x: str, y: str, tie: str, width: float) -> DataFrame:
    """Rows with a higher y than every row of smaller x (or equal x and higher y): first the best y of each range of x, so that
    only rows that beat the ranges before are ordered at all."""
    d = df.withColumn("_b", F.floor(F.col(x) / width).cast("bigint"))
    tops = d.groupBy("_b").agg(F.max(y).alias("_t"))
    before = Window.partitionBy(F.lit(1)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_b", F.max("_t").over(before).alias("_before"))
    d = d.join(tops, "_b").filter(F.col("_before").isNull() | (F.col(y) > F.col("_before")))
    w = Window.partitionBy("_b").orderBy(x, F.desc(y), tie).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_p", F.max(y).over(w))
    return d.filter(F.col("_p").isNull() | (F.col(y) > F.col("_p"))).drop("_b", "_before", "_p")


def value_at(df: DataFrame, keys: list[str], value: str, width: float, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """keys, n and for each name the value at rank f(n), from 0, of the n non-null values in order.

    Equal values are counted first and their counts added up in ranges of the value, so neither a key nor a value is gathered.
    """
    c = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    c = running_by_value(c, keys, value, width, {"_before": F.col("_c")})
    n = c.groupBy(*keys).agg(F.sum("_c").alias("n"))
    c = c.join(n, keys) if keys else c.crossJoin(F.broadcast(n))  # one row
    at = {k: f(F.col("n")) for k, f in ranks.items()}
    return c.groupBy(*keys).agg(F.first("n").alias("n"), *[F.max(F.when((F.col("_before") <= r) & (r < F.col("_before") + F.col("_c")), F.col(value))).alias(k) for k, r in at.items()])


def quantile(df: DataFrame, keys: list[str], value: str, q: float, width: float) -> DataFrame:
    """keys, n, quantile: with linear interpolation between the two ranks."""
    h = lambda n: q * (n - 1)
    v = value_at(df, keys, value, width, {"_lo": lambda n: F.floor(h(n)), "_hi": lambda n: F.ceil(h(n))})
    return v.select(*keys, "n", (F.col("_lo") + (h(F.col("n")) - F.floor(h(F.col("n")))) * (F.col("_hi") - F.col("_lo"))).alias("quantile"))
