"""Selection of a few rows out of many, per group: eviction policies by name, and whether a judge agrees with what is left.

Each policy takes (df, keys, order, keep, cols): ``order`` is an integer column, ``cols`` says where a policy finds what it needs.
Groups may be of any size: ranks are taken in parts of a group first, places are running counts in chunks, coverage adds one centre to
all groups a round. Groups of ``keep`` rows or fewer stay whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.vectors import dot, norm
from tideline.operators.ordered import previous, running
from tideline.session import Rounds, cut_lineage

#: A group is ranked in so many parts by hash before the best of all parts are ranked together.
PARTS = 64
#: Vectors that rows only name are sent to the tasks up to so many bytes; a group of up to so many rows is walked by one task.
VECTOR_BYTES, GROUP = 32 << 20, 1 << 22


@dataclass(frozen=True)
class Known:
    """Vectors of unit length that rows refer to by number."""

    ids: np.ndarray
    unit: np.ndarray

    @classmethod
    def of(cls, vectors: DataFrame, number: str, vector: str) -> Known | None:
        """None if they are too many to be sent along, or if a number has two vectors."""
        n, m, size = vectors.agg(F.count("*"), F.count_distinct(number), F.sum(F.size(vector)) * 8).collect()[0]
        if not n or n != m or size > VECTOR_BYTES:
            return None
        t = vectors.select(number, vector).orderBy(number).toPandas()
        v = np.array(t[vector].tolist(), float)
        return cls(t[number].to_numpy(), v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12))


@dataclass(frozen=True)
class Columns:
    """What rows are judged by: a vector (its number if the vectors are ``known``), a score, whether the row is a keyframe, its time."""

    vector: str = "v"
    score: str = "score"
    keyframe: str = "keyframe"
    time: str = "t_s"
    known: Known | None = None


def top(df: DataFrame, keys: list[str], by: Column, tie: str, k: int, rank: str = "_r") -> DataFrame:
    """The k rows of each group with the largest ``by``; equal ones go by the smallest ``tie``. ``rank`` is kept, from 1, if it has a name of its own."""
    d = df.withColumn("_by", by).withColumn("_p", F.pmod(F.xxhash64(tie), F.lit(PARTS)))
    for part in ([*keys, "_p"], keys):
        w = Window.partitionBy(*part).orderBy(F.desc("_by"), tie)
        d = d.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
    return d.drop("_r", "_p", "_by")


def newest(df: DataFrame, keys: list[str], order: str, k: int, cols: Columns = Columns()) -> DataFrame:
    """The last k rows of each group; k = 0 keeps all."""
    return top(df, keys, F.col(order), order, k) if k else df


def stride(df: DataFrame, keys: list[str], order: str, k: int, cols: Columns = Columns()) -> DataFrame:
    """Rows at k evenly spaced places, rounded half to even."""
    d = running(df, keys, order, F.lit(1), "_i", inclusive=False)
    d = d.join(df.groupBy(*keys).agg(F.count("*").alias("_n")), keys)
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.bround(j * (F.col("_n") - 1) / F.lit(float(max(1, k - 1)))).cast("bigint"))
    return d.filter((F.col("_n") <= k) | F.array_contains(places, F.col("_i").cast("bigint"))).drop("_i", "_n")


def salience(score: Column, motion: Column, keyframe: Column, recency: Column) -> Column:
    return score + 0.5 * motion + 0.3 * keyframe.cast("double") + 0.2 * recency


def with_salience(df: DataFrame, keys: list[str], order: str, cols: Columns = Columns()) -> DataFrame:
    """``salience`` of each row, to nine digits: score, motion (change of the score since the row before), keyframe and recency."""
    sc = F.coalesce(F.col(cols.score), F.lit(0.0))
    d = previous(df, keys, order, F.col(cols.score), "_prev")
    d = d.join(df.groupBy(*keys).agg(F.min(cols.time).alias("_t0"), F.max(cols.time).alias("_t1")), keys)
    recency = (F.col(cols.time) - F.col("_t0")) / F.greatest(F.col("_t1") - F.col("_t0"), F.lit(1e-9))
    return d.withColumn("salience", F.round(salience(sc, F.abs(sc - F.coalesce("_prev", F.lit(0.0))), F.col(cols.keyframe), recency), 9)).drop("_prev", "_t0", "_t1")


def salient(df: DataFrame, keys: list[str], order: str, k: int, cols: Columns = Columns()) -> DataFrame:
    return top(with_salience(df, keys, order, cols), keys, F.col("salience"), order, k)


def coverage(df: DataFrame, key: str | list[str], order: str, vector: str, k: int) -> DataFrame:
    """Greedy farthest-first centres by cosine distance, from the newest; ties go to the lowest place. key, order, rank.

    Every round is a join of the rows to the one centre added last in their group, so a group is never gathered: k rounds
    over all rows for any number of groups and any size. Distances are written each round, the last table is dropped.
    """
    keys = [key] if isinstance(key, str) else list(key)
    unit = F.transform(F.col(vector), lambda x: x / F.greatest(norm(F.col(vector)), F.lit(1e-12)))
    d = df.select(*keys, order, unit.alias("_v"))
    last = d.groupBy(*keys).agg(F.max_by(F.struct(order, "_v"), order).alias("c"))
    last = cut_lineage(last)
    kept = last.select(*keys, F.col(f"c.{order}").alias(order), F.lit(0).alias("rank"))
    far, table = d.withColumn("_d", F.lit(float("inf"))), Rounds()
    for i in range(1, k):
        c = last.select(*keys, F.col(f"c.{order}").alias("_co"), F.col("c._v").alias("_cv"))
        far, _ = table.put(far.join(c, keys).filter(F.col(order) != F.col("_co")).withColumn("_d", F.least("_d", F.round(1 - dot(F.col("_v"), F.col("_cv")), 9))).drop("_co", "_cv"))
        last = cut_lineage(far.groupBy(*keys).agg(F.max_by(F.struct(order, "_v"), F.struct("_d", -F.col(order))).alias("c")))
        kept = kept.unionByName(last.select(*keys, F.col(f"c.{order}").alias(order), F.lit(i).alias("rank")))
    return kept


def _greedy(refs: np.ndarray, unit: np.ndarray, k: int) -> list[int]:
    """Places of the centres among rows in order, as :func:`coverage` takes them."""
    at, d = [len(refs) - 1], np.full(len(refs), np.inf)
    few = unit[refs] if len(refs) <= len(unit) else None
    for _ in range(1, min(k, len(refs))):
        c = unit[refs[at[-1]]]
        d = np.minimum(d, np.round(1 - (few @ c if few is not None else (unit @ c)[refs]), 9))
        d[at] = -np.inf
        at.append(int(np.argmax(d)))
    return at


def coverage_of_known(df: DataFrame, keys: list[str], order: str, number: str, known: Known, k: int) -> DataFrame:
    """:func:`coverage` of rows that name their vector: three columns are shuffled, once, and each group is walked where it comes to lie.
    Groups of more than GROUP rows, of which there are few, go by rounds."""
    d = df.select(*keys, F.col(order).cast("bigint").alias(order), F.col(number).alias("_n")).dropna(subset=keys)
    sizes = d.groupBy(*keys).count().filter(F.col("count") > GROUP).select(*keys).collect()
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name != "_n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []

        def centres() -> list[tuple]:
            if not held:
                return []
            t, numbers = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            return [(*key, int(t[i]), r) for r, i in enumerate(_greedy(np.searchsorted(known.ids, numbers), known.unit, k))]

        for pdf in batches:
            own = list(zip(*[pdf[c].tolist() for c in keys]))
            cuts = [i for i in range(len(own)) if i == 0 or own[i] != own[i - 1]]
            t, numbers, out = pdf[order].to_numpy(), pdf["_n"].to_numpy(), []
            for a, b in zip(cuts, [*cuts[1:], len(own)]):
                if own[a] != key:
                    out += centres()
                    key, held = own[a], []
                held.append((t[a:b], numbers[a:b]))
            yield pd.DataFrame(out, columns=[*keys, order, "rank"])
        yield pd.DataFrame(centres(), columns=[*keys, order, "rank"])

    small = d
    if sizes:
        large = F.broadcast(df.sparkSession.createDataFrame(sizes, d.select(*keys).schema))  # fewer than rows / GROUP
        small = d.join(large, keys, "left_anti")
    out = small.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run, f"{kinds}, rank int")
    if sizes:
        v = df.sparkSession.createDataFrame(pd.DataFrame({"_n": known.ids, "_v": known.unit.tolist()}), "_n bigint, _v array<double>")
        out = out.unionByName(coverage(d.join(large, keys, "left_semi").join(F.broadcast(v), "_n"), keys, order, "_v", k))
    return out


def _centres(df: DataFrame, keys: list[str], order: str, k: int, cols: Columns) -> DataFrame:
    return coverage_of_known(df, keys, order, cols.vector, cols.known, k) if cols.known else coverage(df, keys, order, cols.vector, k)


def covering(df: DataFrame, keys: list[str], order: str, k: int, cols: Columns = Columns()) -> DataFrame:
    return df.join(_centres(df, keys, order, k, cols).select(*keys, order), [*keys, order], "left_semi")


def hybrid(df: DataFrame, keys: list[str], order: str, k: int, cols: Columns = Columns(), share: float = 0.5) -> DataFrame:
    """A share of the places by coverage (the newest row always), the rest from the k most salient rows, oldest first. ``why`` says which."""
    cover = _centres(df, keys, order, max(1, int(k * share)), cols).select(*keys, order).withColumn("why", F.lit("coverage"))
    rest = salient(df, keys, order, k, cols).join(cover, [*keys, order], "left_anti")
    n = cover.groupBy(*keys).agg(F.count("*").alias("_have"))
    rest = rest.join(n, keys).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter(F.col("_r") <= k - F.col("_have"))  # k rows of a group at most
    small = df.groupBy(*keys).agg((F.count("*") <= k).alias("_all"))
    out = cover.unionByName(rest.select(*keys, order).withColumn("why", F.lit("salience")))
    return df.join(small, keys).join(out, [*keys, order], "left").filter(F.col("_all") | F.col("why").isNotNull()).withColumn("why", F.coalesce("why", F.lit("all"))).drop("_all")


#: By name; each takes (df, keys, order, keep, cols).
POLICIES: dict[str, Callable[..., DataFrame]] = {"fifo": newest, "stride": stride, "coverage": covering, "salience": salient, "hybrid": hybrid}


def importance(df: DataFrame, keys: list[str], order: str, hit: Column, least: int = 1) -> DataFrame:
    """keys, order, decisive: whether leaving the row out changes the verdict "at least ``least`` hits". That takes exactly so many
    hits, and the row must be one; so the judge is asked through a count per group and not once per row."""
    d = df.select(*keys, order, hit.alias("_h"))
    n = d.groupBy(*keys).agg(F.count_if("_h").alias("_n"))
    return d.join(n, keys).select(*keys, order, (F.col("_h") & (F.col("_n") == least)).alias("decisive"))


def kept(df: DataFrame, keys: list[str], order: str, budgets: list[int], policies: list[str], cols: Columns = Columns()) -> DataFrame:
    """keys, order, policy, keep: what each policy keeps at each budget. Centres and salient rows are ranked once, for the largest
    budget: those of a smaller one are the first of them. Groups with null keys are left out."""
    df, most = df.dropna(subset=keys), max(budgets)
    row, out = [*keys, order], []
    if {"coverage", "hybrid"} & set(policies):
        centres = cut_lineage(_centres(df, keys, order, most, cols).select(*row, "rank"))
    if {"salience", "hybrid"} & set(policies):
        best = cut_lineage(top(with_salience(df, keys, order, cols), keys, F.col("salience"), order, most, "place").select(*row, "place"))
    if "hybrid" in policies:
        small = cut_lineage(df.join(df.groupBy(*keys).agg(F.count("*").alias("_size")).filter(F.col("_size") <= most), keys).select(*row, "_size"))
    for name in policies:
        for k in budgets:
            if name == "coverage":
                d = centres.filter(F.col("rank") < k)
            elif name == "salience":
                d = best.filter(F.col("place") <= k)
            elif name == "hybrid":
                cover = centres.filter(F.col("rank") < max(1, k // 2)).select(*row)
                rest = best.filter(F.col("place") <= k).join(cover, row, "left_anti").join(cover.groupBy(*keys).agg(F.count("*").alias("_have")), keys)
                rest = rest.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter(F.col("_r") <= k - F.col("_have"))
                d = cover.unionByName(rest.select(*row)).unionByName(small.filter(F.col("_size") <= k).select(*row)).distinct()
            else:
                d = POLICIES[name](df, keys, order, k, cols)
            out.append(d.select(*row, F.lit(name).alias("policy"), F.lit(k).cast("bigint").alias("keep")))
    return reduce(DataFrame.unionByName, out)


def agreement(df: DataFrame, keys: list[str], order: str, judge: Column, budgets: list[int], policies: list[str] | None = None, cols: Columns = Columns()) -> DataFrame:
    """policy, keep, n, n_agree: for how many groups the judge (an aggregate) says of the rows a policy keeps what it says of all."""
    chosen = kept(df, keys, order, budgets, policies or list(POLICIES), cols)
    said = df.join(chosen, [*keys, order]).groupBy("policy", "keep", *keys).agg(judge.alias("_kept"))
    both = said.join(df.groupBy(*keys).agg(judge.alias("_all")), keys)
    return both.groupBy("policy", "keep").agg(F.count("*").alias("n"), F.count_if(F.col("_all").eqNullSafe(F.col("_kept"))).alias("n_agree"))
