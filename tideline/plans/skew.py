"""Joins and prefix sums that hold when one key has a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.session import cut_lineage

#: A key is heavy if it has more than 1/HEAVY of all rows, so there are fewer than HEAVY heavy keys whatever the data.
HEAVY = 256


def heavy_keys(df: DataFrame, key: str, share: int = HEAVY, least: int = 10_000, total: int | None = None) -> list:
    """The keys with more than 1/share of the rows (and more than ``least`` rows): fewer than ``share`` values by construction.

    ``total`` is the number of rows, if the caller knows it (or a smaller number, which only makes the bar lower).
    """
    counts = df.groupBy(key).count()
    total = df.count() if total is None else total
    bar = max(least, total // share)
    if total <= least:
        return []
    return [r[0] for r in counts.filter(F.col("count") > bar).select(key).collect() if r[0] is not None]


def join_unique(left: DataFrame, right: DataFrame, key: str, how: str = "left", heavy: Sequence | None = None, total: int | None = None) -> DataFrame:
    """Join ``left`` to ``right``, in which each key has one row.

    Rows of heavy keys meet a broadcast of the fewer than HEAVY rows of ``right`` they need and are never shuffled; the rest
    is an ordinary shuffled join. With no heavy key it is the ordinary join alone.
    """
    hot = list(heavy_keys(left, key, total=total) if heavy is None else heavy)
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    cold = left.filter(~F.coalesce(is_hot, F.lit(False))).join(right.filter(~is_hot), key, how)
    warm = left.filter(is_hot).join(F.broadcast(right.filter(is_hot)), key, how)
    return cold.unionByName(warm)


#: Keys are counted in so many groups by hash before any is counted by itself.
GROUPS = 1 << 20


def _crowded(df: DataFrame, keys: Sequence[str], side: int) -> DataFrame | None:
    """keys and count of those with more than ``side`` rows; None if there is none. Only keys in a group of so many rows are counted
    exactly, so for most data this is one aggregate to at most GROUPS rows."""
    d = df.select(*keys).dropna().withColumn("_g", F.pmod(F.xxhash64(*keys), F.lit(GROUPS)))
    full = [r["_g"] for r in d.groupBy("_g").count().filter(F.col("count") > side).select("_g").collect()]
    if not full:
        return None
    groups = df.sparkSession.createDataFrame([(g,) for g in full], "_g bigint")
    return d.join(F.broadcast(groups), "_g").groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(side)).cast("int").alias("_c")).filter("_c > 1")


def join_grid(left: DataFrame, right: DataFrame, keys: Sequence[str], side: int = 2000) -> DataFrame:
    """Every pair of rows of ``left`` and ``right`` with equal ``keys``, for results that are pairs by definition.

    A key with m rows on the left and n on the right is cut into ceil(m / side) x ceil(n / side) cells. A row stands in each
    cell of its line, so no task holds more than ``side`` rows of a key on either side, however hot the key is; keys under
    ``side`` rows are one cell and nothing is repeated. Rows with a null key are dropped. Both inputs are read twice: give
    written tables where they are dear.
    """
    keys = list(keys)
    m, n = _crowded(left, keys, side), _crowded(right, keys, side)
    if m is None and n is None:
        return left.join(right, keys)
    none = (left if m is None else right).select(*keys).limit(0).withColumn("_c", F.lit(1))
    many = (none if m is None else m).withColumnRenamed("_c", "_m").join((none if n is None else n).withColumnRenamed("_c", "_n"), keys, "full").fillna(1, ["_m", "_n"])
    many = cut_lineage(many)
    own = lambda d, n: F.pmod(F.xxhash64(*d.columns), F.coalesce(F.col(n), F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))
    a = left.join(many, keys, "left").select(*left.columns, own(left, "_m").alias("_i"), every("_n").alias("_j"))
    b = right.join(many, keys, "left").select(*right.columns, own(right, "_n").alias("_j"), every("_m").alias("_i"))
    return a.join(b, [*keys, "_i", "_j"]).drop("_i", "_j")


def running_total(df: DataFrame, keys: Sequence[str], order: Column, value: Column, out: str, buckets: int = 8192, tie: Sequence[str] = ()) -> DataFrame:
    """``out`` = sum of ``value`` over the rows of the same keys that come before this one in a pseudo-random but fixed order.

    ``order`` must be a hash (any bigint); rows are cut into ``buckets`` by its value, so no task holds a whole key. Sums per
    bucket are added up over at most keys x buckets rows.
    """
    b = df.withColumn("_b", F.pmod(F.shiftrightunsigned(order, 40), F.lit(buckets))).withColumn("_o", order).withColumn("_v", value)
    sums = b.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_o", *tie).rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return b.join(sums, [*keys, "_b"]).withColumn(out, F.col("_base") + F.col("_in")).drop("_b", "_o", "_v", "_in", "_base")
