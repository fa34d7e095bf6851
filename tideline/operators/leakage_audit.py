"""Whether labels can be told from how files were encoded."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.session import cut_lineage


def audit(rows: DataFrame, features: list[str], label: str, key: Column, folds: int = 5, trees: int = 50, permutations: int = 200) -> DataFrame:
    """One row: n, held-out auc (mean over folds and its deviation), accuracy, majority (what always saying the commoner label would get), p,
    leaked, underpowered, top_features. Missing features count as -1; folds keep the shares of the labels.

    p is that of a permutation test: labels are shuffled over the held-out scores of all folds, which changes the counts per score alone,
    so shuffles are drawn from counts and no forest is fitted again. With one label or fewer than two of one there is no audit: nulls.
    """
    y = F.col(label).cast("double")
    order = Window.partitionBy("_y", "_s").orderBy(F.xxhash64(key))
    # Within each label and each of 64 parts by hash, folds take turns.
    x = rows.withColumn("_y", y).withColumn("_s", F.pmod(F.xxhash64(F.lit(5), key), F.lit(64))).withColumn("_f", (F.row_number().over(order) + F.col("_s")) % folds)
    x = VectorAssembler(inputCols=features, outputCol="_x").transform(x.fillna(-1, subset=features).select(*features, "_y", "_f")).select("_x", "_y", "_f")
    x = cut_lineage(x)
    ddl = "n bigint, auc double, auc_std double, accuracy double, majority double, p double, leaked boolean, underpowered boolean, top_features array<string>"
    n = x.agg(F.count("*").alias("n"), F.coalesce(F.sum("_y"), F.lit(0.0)).alias("pos")).collect()[0]
    n, pos = int(n.n), int(n.pos)
    if min(pos, n - pos) < 2:
        return rows.sparkSession.createDataFrame([(n, None, None, None, None, None, None, n < 200, [])], ddl)
    scored, importance = None, np.zeros(len(features))
    for k in range(folds):
        m = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=8, seed=k).fit(x.filter(F.col("_f") != k))
        importance += m.featureImportances.toArray()
        p = m.transform(x.filter(F.col("_f") == k)).select("_f", F.round(vector_to_array("probability")[1], 3).alias("p"), (F.col("_y") > 0).alias("y"))
        scored = p if scored is None else scored.unionByName(p)
    # Scores of three digits: at most 1001 rows per fold reach the driver, whatever the number of clips.
    c = scored.groupBy("_f", "p").agg(F.count_if("y").alias("a"), F.count_if(~F.col("y")).alias("b")).orderBy("_f", "p").collect()
    fold, a, b = (np.array([r[i] for r in c]) for i in ("_f", "a", "b"))
    right = sum(int(r.a) if r.p > 0.5 else int(r.b) for r in c)
    aucs = [_auc(a[fold == k], b[fold == k]) for k in range(folds)]
    aucs = [v for v in aucs if v is not None]
    auc = float(np.mean(aucs))
    rng = np.random.default_rng(0)
    ge = 0
    for _ in range(permutations):
        v = []
        for k in range(folds):
            t = (a + b)[fold == k]
            if t.sum():
                s = rng.multivariate_hypergeometric(t, int(a[fold == k].sum()), method="marginals")
                v.append(_auc(s, t - s))
        ge += np.mean([q for q in v if q is not None]) >= auc - 1e-12
    p = (ge + 1) / (permutations + 1)
    top = [features[i] for i in np.argsort(-importance, kind="stable")[:3]]
    row = (n, round(auc, 6), round(float(np.std(aucs)), 6), round(right / n, 6), round(max(pos, n - pos) / n, 6), round(float(p), 6), bool(p < 0.05 and auc > 0.5), n < 200, top)
    return rows.sparkSession.createDataFrame([row], ddl)


def _auc(a: np.ndarray, b: np.ndarray) -> float | None:
    """From counts of positives and negatives per score, in rising order of the score; ties count half."""
    if not a.sum() or not b.sum():
        return None
    below = np.concatenate([[0], np.cumsum(b)[:-1]])
    return float((a * (below + b / 2)).sum() / (a.sum() * b.sum()))


def position_test(counts: dict[int, tuple[int, int]], permutations: int = 500, seed: int = 0) -> tuple[float, float]:
    """Total variation between the positions of two labels and its permutation p.

    Shuffling labels over positions changes the counts per bin alone, and these are multivariate hypergeometric; so the
    permutations are drawn from the counts, whatever the number of rows.
    """
    a = np.array([v[0] for v in counts.values()], np.int64)
    b = np.array([v[1] for v in counts.values()], np.int64)
    if not a.sum() or not b.sum():
        return 0.0, 1.0
    tvd = lambda x, y: 0.5 * np.abs(x / x.sum(-1, keepdims=True) - y / y.sum(-1, keepdims=True)).sum(-1)
    seen, total = float(tvd(a, b)), a + b
    rng = np.random.default_rng(seed)
    draws = rng.multivariate_hypergeometric(total, int(a.sum()), size=permutations, method="marginals")
    return seen, float(((tvd(draws, total - draws) >= seen - 1e-12).sum() + 1) / (permutations + 1))
