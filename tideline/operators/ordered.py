"""Operators over ordered rows of a key.

Sums, minima and sliding windows are cut into chunks of the order column, so a key of any size spreads over many tasks. What is
truly sequential is folded: each partition is sorted and streamed through the step function with a small state, so a key's rows
are never held together in memory (but pass one task).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Callable, values: Sequence[str], out: str) -> DataFrame:
    """keys, order and the step's outputs for every row; ``out`` is the DDL of the outputs. Rows with equal order keep no promise."""
    names = [*keys, *order, *[v for v in values if v not in order]]
    src = df.select(*names)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name in (*keys, *order))
    outs = [x.split()[0] for x in out.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, step.initial
        for pdf in batches:
            rows = []
            cols = [_plain(pdf[c]) for c in names]
            pos = [names.index(v) for v in values]
            nk = len(keys)
            for r in zip(*cols):
                if r[:nk] != key:
                    key, state = r[:nk], step.initial
                state, got = step(state, *(r[p] for p in pos))
                rows.append(got)
            res = pdf[[*keys, *order]].reset_index(drop=True)
            yield pd.concat([res, pd.DataFrame(rows, columns=outs)], axis=1)

    sorted_ = src.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)
    return sorted_.mapInPandas(run, f"{ddl}, {out}")


def _plain(s: pd.Series) -> list:
    """Python values, with None for missing ones."""
    return [None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v for v in s.tolist()]


def reflected_sum(df: DataFrame, keys: Sequence[str], order: str, x: str, chunk: int = 4096) -> DataFrame:
    """``stat`` = max(0, previous + x) along each key, in closed form and in chunks of ``order`` (an integer column).

    The statistic is the running sum less its running minimum (0 included); sums and minima of chunks are carried over.
    """
    d = df.withColumn("_c", F.floor(F.col(order) / chunk))
    inside = Window.partitionBy(*keys, "_c").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_p", F.sum(x).over(inside))
    d = d.withColumn("_m", F.min("_p").over(inside))
    chunks = d.groupBy(*keys, "_c").agg(F.sum(x).alias("_b"), F.min("_p").alias("_cm"))
    before = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("_base", F.coalesce(F.sum("_b").over(before), F.lit(0.0)))
    chunks = chunks.withColumn("_low", F.min(F.col("_base") + F.col("_cm")).over(before)).select(*keys, "_c", "_base", "_low")
    d = d.join(chunks, [*keys, "_c"])
    low = F.least(F.lit(0.0), F.coalesce("_low", F.lit(0.0)), F.col("_base") + F.col("_m"))
    return d.withColumn("stat", F.col("_base") + F.col("_p") - low).drop("_c", "_p", "_m", "_base", "_low")


def sliding(df: DataFrame, keys: Sequence[str], t: str, width: int, aggs: dict[str, Callable[[Window], Column]]) -> DataFrame:
    """Aggregates over [t - width, t] of each row: every row also stands in the next chunk of ``width``, so a window never
    leaves its chunk and a long key becomes many groups. Rows of the same time are all in."""
    b = F.floor(F.col(t) / width).cast("bigint")
    d = df.withColumn("_own", F.array(F.lit(True), F.lit(False))).withColumn("_bucket", b)
    d = d.select("*", F.explode("_own").alias("_native")).withColumn("_bucket", F.when(F.col("_native"), F.col("_bucket")).otherwise(F.col("_bucket") + 1))
    w = Window.partitionBy(*keys, "_bucket").orderBy(t).rangeBetween(-width, 0)
    for name, f in aggs.items():
        d = d.withColumn(name, f(w))
    return d.filter("_native").drop("_own", "_native", "_bucket")


def carry_last(df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, chunk: int = 4096) -> DataFrame:
    """``out`` = the last non-null ``value`` up to this row, in chunks of the integer column ``order``."""
    d = df.withColumn("_c", F.floor(F.col(order) / chunk)).withColumn("_v", value)
    inside = Window.partitionBy(*keys, "_c").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_l", F.last("_v", ignorenulls=True).over(inside))
    chunks = d.groupBy(*keys, "_c").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_cv"))
    before = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(*keys, "_c", F.last("_cv", ignorenulls=True).over(before).alias("_in"))
    return d.join(chunks, [*keys, "_c"]).withColumn(out, F.coalesce("_l", "_in")).drop("_c", "_v", "_l", "_in")


def running(df: DataFrame, keys: Sequence[str], order: str, x: Column, out: str, chunk: int = 4096, inclusive: bool = True, tie: Sequence[str] = ()) -> DataFrame:
    """Running sum of ``x`` up to (and with) this row, in chunks of the integer column ``order``; equal ones go by ``tie``."""
    d = df.withColumn("_c", F.floor(F.col(order) / chunk)).withColumn("_x", x)
    inside = Window.partitionBy(*keys, "_c").orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    d = d.withColumn("_s", F.coalesce(F.sum("_x").over(inside), F.lit(0)))
    sums = d.groupBy(*keys, "_c").agg(F.sum("_x").alias("_b"))
    before = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_c", F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_base"))
    return d.join(sums, [*keys, "_c"]).withColumn(out, F.col("_base") + F.col("_s")).drop("_c", "_x", "_s", "_base")


def previous(df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, chunk: int = 4096) -> DataFrame:
    """``out`` = ``value`` of the row before along each key (null for the first), in chunks of the integer column ``order``."""
    d = df.withColumn("_c", F.floor(F.col(order) / chunk)).withColumn("_v", F.struct(value.alias("v")))
    d = d.withColumn("_l", F.lag("_v").over(Window.partitionBy(*keys, "_c").orderBy(order)))
    chunks = d.groupBy(*keys, "_c").agg(F.max_by("_v", order).alias("_cv"))
    chunks = chunks.select(*keys, "_c", F.lag("_cv").over(Window.partitionBy(*keys).orderBy("_c")).alias("_in"))
    return d.join(chunks, [*keys, "_c"]).withColumn(out, F.coalesce("_l", "_in")["v"]).drop("_c", "_v", "_l", "_in")


def last_rows(df: DataFrame, keys: Sequence[str], order: str, n: int, aggs: dict[str, Callable[[Window], Column]], chunk: int = 4096) -> DataFrame:
    """Aggregates over each row and the n - 1 before it, and ``pos``, the row's number from 1. Rows are numbered in chunks of
    ``order``, then cut into chunks of numbers; the last n - 1 rows of a chunk stand in the next one too."""
    d = running(df, keys, order, F.lit(1), "pos", chunk)
    wide = max(chunk, n)
    b = F.floor((F.col("pos") - 1) / wide)
    late = (F.col("pos") - 1) % wide >= wide - n + 1
    d = d.withColumn("_b", F.explode(F.when(late, F.array(b, b + 1)).otherwise(F.array(b))))
    w = Window.partitionBy(*keys, "_b").orderBy("pos").rangeBetween(1 - n, 0)
    for name, f in aggs.items():
        d = d.withColumn(name, f(w))
    return d.filter(b == F.col("_b")).drop("_b")
