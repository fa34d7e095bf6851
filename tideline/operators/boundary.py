"""Boundaries from few examples: prototypes, cached exemplars, linear heads, conformal thresholds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import vectors
from tideline.operators.bounds import recall_lower_bound
from tideline.operators.ranking import running_by_value


def class_means(df: DataFrame, label: str, vector: str) -> DataFrame:
    """label, proto: the unit mean of the unit vectors of each class; sums per dimension, so classes may be of any size."""
    v = df.filter(F.col(vector).isNotNull()).withColumn("_v", vectors.doubles(F.col(vector)))
    v = v.withColumn("_n", F.greatest(vectors.norm(F.col("_v")), F.lit(1e-12)))
    d = v.select(label, F.posexplode(F.transform("_v", lambda x: x / F.col("_n"))).alias("i", "x")).groupBy(label, "i").agg(F.avg("x").alias("x"))
    m = d.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("_m"))
    m = m.withColumn("_n", F.greatest(vectors.norm(F.col("_m")), F.lit(1e-12)))
    return m.select(label, F.transform("_m", lambda x: x / F.col("_n")).alias("proto"))


#: References go out in blocks of at most so many.
BLOCK = 4096


def against(rows: DataFrame, refs: DataFrame, key: str, vector: str, weight: str, block: int = BLOCK) -> DataFrame:
    """``key``, cache, ood: per row the mean of weight * exp(-5 (1 - cos)) over the references, and 1 less the largest cosine,
    within [0, 1]. References are a stated set; blocks of bounded size are broadcast and their sums and maxima joined."""
    r = refs.select(key, vector, weight).filter(F.col(vector).isNotNull())
    n = r.count()
    if not n:
        return rows.select(F.col(key).cast("bigint"), F.lit(None).cast("double").alias("cache"), F.lit(0.0).alias("ood"))
    blocks, out = max(1, -(-n // block)), None
    for i in range(blocks):
        part = r.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == i).collect()
        if not part:
            continue
        shared = rows.sparkSession.sparkContext.broadcast((np.array([p[1] for p in part], float), np.array([p[2] for p in part], float)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m, w = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                v = b.column(1)
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)[v.offsets[0].as_py() : v.offsets[-1].as_py()].reshape(b.num_rows, -1)
                cos = x @ m.T
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array((np.exp(-5 * (1 - cos)) * w).sum(1)), pa.array(cos.max(1))], names=[key, "s", "m"])

        one = rows.select(F.col(key).cast("bigint"), vector).filter(F.col(vector).isNotNull()).mapInArrow(run, f"{key} bigint, s double, m double")
        out = one if out is None else out.unionByName(one)
    if blocks > 1:
        out = out.groupBy(key).agg(F.sum("s").alias("s"), F.max("m").alias("m"))
    return out.select(key, (F.col("s") / n).alias("cache"), vectors.clip(1 - F.col("m"), 0.0, 1.0).alias("ood"))


def most_misses(n: int, target: float, delta: float = 0.1) -> int | None:
    """The largest number of misses of n under which the recall is still bounded by target; null if not even 0 is."""
    if n <= 0 or recall_lower_bound(n, 0, delta) < target:
        return None
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if recall_lower_bound(n, mid, delta) >= target else (lo, mid - 1)
    return lo


def conformal(scores: DataFrame, key: str, score: str, target: float = 0.9, delta: float = 0.1) -> DataFrame:
    """key, n, n_miss, tau, status: the highest threshold whose recall bound still holds; ESTIMATED (the lowest score) if none
    does, UNCALIBRATED without positives."""
    n = scores.filter(F.col(score).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    sizes = [r.n for r in n.select("n").distinct().collect()]  # one per distinct size
    table = scores.sparkSession.createDataFrame([(int(x), most_misses(int(x), target, delta)) for x in sizes], "n bigint, allowed int")
    n = n.join(F.broadcast(table), "n")
    # Only one rank of a key is needed: equal scores are counted, counts added up in ranges of the score.
    c = scores.filter(F.col(score).isNotNull()).groupBy(key, score).agg(F.count("*").alias("_c"))
    c = running_by_value(c, [key], score, 0.01, {"_before": F.col("_c")}).join(n, key)
    at = F.coalesce("allowed", F.lit(0))
    hit = c.filter((F.col("_before") <= at) & (at < F.col("_before") + F.col("_c")))
    return hit.select(key, "n", at.cast("bigint").alias("n_miss"), F.col(score).alias("tau"), F.when(F.col("allowed").isNotNull(), "CALIBRATED").otherwise("ESTIMATED").alias("status"))


def decide(scores: DataFrame, thresholds: DataFrame, key: str, score: str, target: float) -> DataFrame:
    """``scores`` with unsafe and recall_bound: the bound is there only under a threshold that is CALIBRATED."""
    t = thresholds.select(key, "tau", "status")
    j = scores.join(t, key)
    return j.withColumn("unsafe", F.col(score) >= F.col("tau")).withColumn("recall_bound", F.when(F.col("status") == "CALIBRATED", F.lit(target)))


def recalibrate(boundaries: DataFrame, changed: str) -> DataFrame:
    """Status and epoch after a change: a threshold belongs to the boundary it was found on."""
    c = F.col(changed)
    return boundaries.withColumn("status", F.when(c, "UNCALIBRATED").otherwise("CALIBRATED")).withColumn("epoch", F.when(c, 2).otherwise(1).cast("bigint"))
