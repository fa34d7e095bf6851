"""Upper bounds of a mean risk, lower bounds of a recall, and how many samples they need."""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators.ordered import running

#: A chunk of 4096 ticks is as wide as 4096 of the 2^32 places of a random order times so much.
CHUNK_TICKS = 256


def binomial_cdf(k: int, n: int, p: float) -> float:
    """In logarithms, so that coefficients of any size do."""
    if p <= 0:
        return 1.0
    if p >= 1:
        return 1.0 if k >= n else 0.0
    i = np.arange(k + 1)
    lg = np.vectorize(math.lgamma)
    t = math.lgamma(n + 1) - lg(i + 1) - lg(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    m = t.max()
    return float(min(1.0, math.exp(m) * np.exp(t - m).sum()))


def exact_ucb(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest risk under which k or fewer of n still have probability delta."""
    if n < 1:
        return 1.0
    if k >= n:
        return 1.0
    if k == 0:
        return 1 - delta ** (1 / n)
    lo, hi = k / n, 1.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if binomial_cdf(k, n, mid) > delta else (lo, mid)
    return hi


def recall_lower_bound(n: int, miss: int, delta: float = 0.1) -> float:
    return 0.0 if n <= 0 or miss >= n else 1 - exact_ucb(miss, n, delta)


def min_calibration_n(target: float, delta: float = 0.1, miss: int = 0) -> int:
    n = max(1, math.ceil(math.log(delta) / math.log(target))) if miss == 0 else miss + 1
    while recall_lower_bound(n, miss, delta) < target - 1e-12:
        n += 1
    return n


def hoeffding_ucb(mean: Column, n: Column, delta: float) -> Column:
    return F.when(n < 1, 1.0).otherwise(mean + F.sqrt(math.log(2 / delta) / (2 * n)))


def bernstein_ucb(mean: Column, var: Column, n: Column, delta: float) -> Column:
    """Empirical Bernstein, with the variance over n."""
    log = math.log(2 / delta)
    return F.when(n < 2, 1.0).otherwise(mean + F.sqrt(2 * var * log / n) + 7 * log / (3 * (n - 1)))


def summary(df: DataFrame, key: str, risk: str, delta: float) -> DataFrame:
    """key, n, mean, hoeffding, bernstein, exact: the bounds from sums per key. The exact one holds for risks of 0 and 1 only;
    where there are others it is Hoeffding's. Missing risks are no samples."""
    g = df.filter(F.col(risk).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.avg(risk).alias("mean"), F.var_pop(risk).alias("_v"), F.sum(risk).alias("_k"), F.bool_and(F.col(risk).isin(0.0, 1.0)).alias("_01"))
    h = hoeffding_ucb(F.col("mean"), F.col("n"), delta)
    exact = F.when(F.col("_01"), exact_ucb_col(F.when(F.col("_01"), F.round("_k")).otherwise(0).cast("bigint"), "n", F.lit(delta))).otherwise(h)
    return g.select(key, "n", "mean", h.alias("hoeffding"), bernstein_ucb(F.col("mean"), F.col("_v"), F.col("n"), delta).alias("bernstein"), exact.alias("exact"))


def ecrc(df: DataFrame, key: str, order: str, risk: str, alpha: float, delta: float, orderings: int = 22, seed: int = 0) -> DataFrame:
    """key, n, min_wealth, certified: certification by betting against 'risk above alpha'.

    The wealth is the product of 1 + bet * (alpha - risk); a bet is (alpha - mean of the risks before) / (alpha * (1 - alpha)), within
    [0, .5], none before the first. It is taken in natural order (``order``, an integer column), in reverse and in random orders by
    hash; the least final wealth must reach 1 / delta, and one sample is not enough. Bets need sums of the risks before only, which are
    added up in chunks of each order, so a key of any size spreads over many tasks.
    """
    x = df.filter(F.col(risk).isNotNull()).select(key, order, risk)
    at = lambda k: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), k.cast("string"), F.col(key).cast("string"), F.col(order).cast("string"))), 1, 8), 16, 10).cast("bigint")
    # The tick of a natural order is spread out, so that one width of chunks does for all.
    place = F.when(F.col("_k") == 0, F.col(order) * CHUNK_TICKS).when(F.col("_k") == 1, -F.col(order) * CHUNK_TICKS).otherwise(at(F.col("_k")))
    x = x.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(orderings - 1)))).withColumn("_o", place)
    x = running(x, [key, "_k"], "_o", F.col(risk), "_sum", CHUNK_TICKS * 4096, inclusive=False, tie=[order])
    x = running(x, [key, "_k"], "_o", F.lit(1), "_before", CHUNK_TICKS * 4096, inclusive=False, tie=[order])
    mean = F.col("_sum") / F.col("_before")
    bet = F.when(F.col("_before") == 0, 0.0).otherwise(F.least(F.lit(0.5), F.greatest(F.lit(0.0), (alpha - mean) / max(alpha * (1 - alpha), 1e-6))))
    factor = 1 + bet * (alpha - F.col(risk))
    w = x.groupBy(key, "_k").agg(F.count("*").alias("n"), F.sum(F.log(F.when(factor > 0, factor))).alias("_l"), F.bool_or(factor <= 0).alias("_broke"))
    w = w.withColumn("_w", F.when(F.col("_broke"), 0.0).otherwise(F.exp("_l")))
    g = w.groupBy(key).agg(F.first("n").alias("n"), F.min("_w").alias("min_wealth"))
    return g.select(key, "n", "min_wealth", ((F.col("n") > 1) & (F.col("min_wealth") >= 1 / delta)).alias("certified"))


@F.pandas_udf(T.DoubleType())
def exact_ucb_col(k: pd.Series, n: pd.Series, delta: pd.Series) -> pd.Series:
    memo: dict[tuple, float] = {}
    return pd.Series([memo.setdefault((a, b, c), exact_ucb(int(a), int(b), float(c))) for a, b, c in zip(k, n, delta)])
