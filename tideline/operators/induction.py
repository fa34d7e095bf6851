"""Induction of a rule by rounds: propose, score, revise, keep the best."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import cut_lineage


def _f1(c) -> float:
    return 0.0 if not c.tp else 2 * c.tp / (2 * c.tp + c.fp + c.fn)


def induce(items: DataFrame, key: str, text: str, label: str, rounds: int = 5, gain: float = 0.01) -> DataFrame:
    """round, words, dev_f1, best: words are proposed on one half (by hash) and scored on the other.

    A round counts, for every word at once, how F1 on the proposing half would change if it joined the list; only the best word
    comes to the driver. Ties go to the first word in order. Stops when the gain on the other half is ``gain`` or less.
    """
    x = items.select(F.col(key).alias("k"), F.array_distinct(F.split(F.lower(F.col(text)), r"[^\p{L}]+")).alias("w"), F.col(label).alias("y"))
    half = F.pmod(F.xxhash64("k"), F.lit(2)) == 0
    x = cut_lineage(x.withColumn("half", half))  # read in every round
    propose, dev = x.filter("half"), x.filter("not half")
    n_pos, n_all = propose.filter("y").count(), propose.count()
    words: list[str] = []
    out, last = [], 0.0
    for r in range(rounds):
        hit = F.arrays_overlap("w", F.array(*map(F.lit, words))) if words else F.lit(False)
        base = propose.agg(F.count(F.when(hit & F.col("y"), 1)).alias("tp"), F.count(F.when(hit & ~F.col("y"), 1)).alias("fp")).collect()[0]
        per = propose.filter(~hit).select("y", F.explode("w").alias("word")).filter(F.length("word") > 3).groupBy("word").agg(F.count(F.when(F.col("y"), 1)).alias("a"), F.count(F.when(~F.col("y"), 1)).alias("b"))
        per = per.filter(F.col("a") + F.col("b") < 0.9 * n_all)  # a word of every item tells nothing
        tp, fp = base.tp + F.col("a"), base.fp + F.col("b")
        best = per.withColumn("f", 2 * tp / (tp + fp + n_pos)).orderBy(F.desc("f"), "word").limit(1).collect()
        if not best:
            break
        words = [*words, best[0].word]
        on = F.arrays_overlap("w", F.array(*map(F.lit, words)))
        c = dev.agg(F.count(F.when(on & F.col("y"), 1)).alias("tp"), F.count(F.when(on & ~F.col("y"), 1)).alias("fp"), F.count(F.when(~on & F.col("y"), 1)).alias("fn")).collect()[0]
        f = _f1(c)
        out.append((r, ",".join(words), round(f, 6)))
        if r > 0 and f - last <= gain:
            break
        last = f
    top = max((o[2] for o in out), default=0.0)
    return items.sparkSession.createDataFrame([(*o, o[2] == top) for o in out], "round int, words string, dev_f1 double, best boolean")
