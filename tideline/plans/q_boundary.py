"""Boundaries from few examples and learned scoring, over the embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import vectors
from tideline.operators import boundary, ranking
from tideline.plans.registry import core
from tideline.plans.sqlparts import EMB, clopper_pearson, with_
from tideline.rng import u01, u01_sql
from tideline.session import table

R6 = lambda c: F.round(c, 6)
#: Exemplars are the ids divisible by this; positive if their label is below 5.
EXEMPLARS = 50
_UN = EMB + ", un AS (SELECT vec_id, label, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS u, v FROM em), ds AS (SELECT label, i, avg(u[i]) AS x FROM un, range(1, 65) t(i) GROUP BY label, i), ms AS (SELECT label, list(x ORDER BY i) AS m FROM ds GROUP BY label), pt AS (SELECT label, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS p FROM ms)"


def emb(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id", "label", vectors.doubles(F.col("embedding")).alias("v"))


def exemplars(s: SparkSession, d: str) -> DataFrame:
    return emb(s, d).filter(F.col("vec_id") % EXEMPLARS == 0).select("vec_id", "v", F.when(F.col("label") < 5, 1.0).otherwise(-1.0).alias("y"))


@core.query("bound01_prototype", with_(_UN) + " SELECT un.vec_id, round(list_dot_product(un.v, pt.p), 6) AS own_cos FROM un JOIN pt ON pt.label = un.label")
def prototype(s: SparkSession, d: str) -> DataFrame:
    e = emb(s, d)
    return e.join(boundary.class_means(e, "label", "v"), "label").select("vec_id", R6(vectors.dot(F.col("v"), F.col("proto"))).alias("own_cos"))


_CACHE = EMB + ", ex AS (SELECT v, CASE WHEN label < 5 THEN 1.0 ELSE -1.0 END AS y FROM em WHERE vec_id % 50 = 0)"


@core.query("bound02_exemplar_cache", with_(_CACHE) + " SELECT em.vec_id, round(avg(y * exp(-5 * (1 - list_dot_product(em.v, ex.v)))), 6) AS cache_score, round(greatest(0, least(1, 1 - max(list_dot_product(em.v, ex.v)))), 6) AS ood FROM em, ex GROUP BY em.vec_id")
def exemplar_cache(s: SparkSession, d: str) -> DataFrame:
    """Kernel mean over the cached exemplars (L2) and distance to the nearest of them (P12)."""
    x = boundary.against(emb(s, d), exemplars(s, d), "vec_id", "v", "y")
    return x.select("vec_id", R6("cache").alias("cache_score"), R6("ood").alias("ood"))


_HEAD = EMB + ", dm AS (SELECT i, avg(v[i]) FILTER (label < 5) - avg(v[i]) FILTER (label >= 5) AS x FROM em, range(1, 65) t(i) GROUP BY i), w0 AS (SELECT list(x ORDER BY i) AS w FROM dm), wn AS (SELECT list_transform(w, lambda x: x / greatest(sqrt(list_dot_product(w, w)), 1e-12)) AS w FROM w0)"


@core.query("bound03_mean_difference_head", with_(_HEAD) + " SELECT vec_id, round(list_dot_product(v, w), 6) AS head_score FROM em, wn")
def mean_difference_head(s: SparkSession, d: str) -> DataFrame:
    """The direction between the class means: the head that needs no fitting."""
    e = emb(s, d)
    y = F.col("label") < 5
    w = e.select(y.alias("y"), F.posexplode("v").alias("i", "x")).groupBy("i").agg((F.avg(F.when(F.col("y"), F.col("x"))) - F.avg(F.when(~F.col("y"), F.col("x")))).alias("x")).orderBy("i").collect()  # a row per dimension
    vec = np.array([r.x for r in w])
    unit = (vec / max(float(np.linalg.norm(vec)), 1e-12)).tolist()
    return e.select("vec_id", R6(vectors.dot(F.col("v"), F.array(*map(F.lit, unit)))).alias("head_score"))


@core.query("bound03_logistic_head")
def logistic_head(s: SparkSession, d: str) -> DataFrame:
    """Logistic regression with balanced weights, fitted by the cluster; AUC of its own scores (rows L3 and L7)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = emb(s, d).withColumn("y", (F.col("label") < 5).cast("double"))
    n = e.agg(F.avg("y").alias("p")).collect()[0].p
    e = e.withColumn("w", F.when(F.col("y") == 1, 0.5 / max(n, 1e-9)).otherwise(0.5 / max(1 - n, 1e-9))).withColumn("x", array_to_vector("v"))
    m = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=0.01, maxIter=50).fit(e)
    sc = m.transform(e).select(F.round(vector_to_array("rawPrediction")[1], 6).alias("s"), (F.col("y") == 1).alias("y"))
    return ranking.auroc(sc, [], "s", F.col("y"), 0.1).select(R6("auroc").alias("auroc"))


@core.query("bound04_combined_score", with_(_HEAD, _CACHE.replace(EMB + ", ", "")) + " SELECT em.vec_id, round(0.5 * any_value(list_dot_product(em.v, w)) + 0.5 * avg(y * exp(-5 * (1 - list_dot_product(em.v, ex.v)))), 6) AS score FROM em, wn, ex GROUP BY em.vec_id")
def combined_score(s: SparkSession, d: str) -> DataFrame:
    c = boundary.against(emb(s, d), exemplars(s, d), "vec_id", "v", "y")
    e = emb(s, d)
    lab = F.col("label") < 5
    w = e.select(lab.alias("y"), F.posexplode("v").alias("i", "x")).groupBy("i").agg((F.avg(F.when(F.col("y"), F.col("x"))) - F.avg(F.when(~F.col("y"), F.col("x")))).alias("x")).orderBy("i").collect()
    vec = np.array([r.x for r in w])
    unit = (vec / max(float(np.linalg.norm(vec)), 1e-12)).tolist()
    h = e.select("vec_id", vectors.dot(F.col("v"), F.array(*map(F.lit, unit))).alias("h"))
    return h.join(c, "vec_id").select("vec_id", R6(0.5 * F.col("h") + 0.5 * F.col("cache")).alias("score"))


_OWN = _UN + ", sc AS (SELECT un.vec_id, un.label, round(list_dot_product(un.v, pt.p), 6) AS score FROM un JOIN pt ON pt.label = un.label), rk AS (SELECT label, score, row_number() OVER (PARTITION BY label ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM sc)"
# For each label the misses that the bound allows: the largest k whose lower bound is still .9 (a bound per k up to a tenth of n).
_CONF = f"WITH RECURSIVE {_OWN}, kn AS (SELECT DISTINCT n, k FROM (SELECT DISTINCT n FROM rk), range(100000) t(k) WHERE k <= n / 10), {clopper_pearson('k', 'n', '0.1', 'kn', 'cp')}, al AS (SELECT n, max(k) FILTER (1 - ucb >= 0.9) AS allowed FROM cp GROUP BY n), th AS (SELECT label, rk.n, CAST(coalesce(allowed, 0) AS BIGINT) AS n_miss, score AS tau, CASE WHEN allowed IS NULL THEN 'ESTIMATED' ELSE 'CALIBRATED' END AS status FROM rk JOIN al USING (n) WHERE i = coalesce(allowed, 0))"


def _own_scores(s: SparkSession, d: str) -> DataFrame:
    e = emb(s, d)
    return e.join(boundary.class_means(e, "label", "v"), "label").select("vec_id", "label", R6(vectors.dot(F.col("v"), F.col("proto"))).alias("score"))


@core.query("bound05_conformal_threshold", _CONF + " SELECT label, n, n_miss, tau, status FROM th")
def conformal_threshold(s: SparkSession, d: str) -> DataFrame:
    """Per label the threshold on the own-prototype cosine whose recall is bounded by .9 (row L5)."""
    return boundary.conformal(_own_scores(s, d), "label", "score")


@core.query("bound06_decide", _CONF + " SELECT vec_id, score >= tau AS unsafe, CASE WHEN status = 'CALIBRATED' THEN 0.9::DOUBLE END AS recall_bound FROM sc JOIN th USING (label)")
def decide(s: SparkSession, d: str) -> DataFrame:
    """What the thresholds decide of each row, with the recall they guarantee: none unless calibrated (row L6)."""
    sc = _own_scores(s, d)
    return boundary.decide(sc, boundary.conformal(sc, "label", "score"), "label", "score", 0.9).select("vec_id", "unsafe", "recall_bound")


@core.query("bound06_epochs", with_(_UN) + ", a AS (SELECT label, count(*) AS n0 FROM em WHERE vec_id % 2 = 0 GROUP BY label), b AS (SELECT label, count(*) AS n1 FROM em GROUP BY label) SELECT label, n0, n1, n1 <> n0 AS boundary_changed, CASE WHEN n1 <> n0 THEN 'UNCALIBRATED' ELSE 'CALIBRATED' END AS status, CAST(CASE WHEN n1 <> n0 THEN 2 ELSE 1 END AS BIGINT) AS epoch FROM a JOIN b USING (label)")
def epochs(s: SparkSession, d: str) -> DataFrame:
    """A boundary that got new examples (here the odd ids, after the even ones) begins another epoch and has lost its calibration."""
    e = emb(s, d)
    a = e.filter("vec_id % 2 = 0").groupBy("label").agg(F.count("*").alias("n0"))
    b = a.join(e.groupBy("label").agg(F.count("*").alias("n1")), "label").withColumn("boundary_changed", F.col("n1") != F.col("n0"))
    return boundary.recalibrate(b, "boundary_changed")


@core.query("bound07_fusion_head")
def fusion_head(s: SparkSession, d: str) -> DataFrame:
    """A linear head over score, strangeness and the sum of channels, positives weighed by how rare they are; fitted by the cluster to three
    quarters of the streams (by hash) and judged by average precision on the others, so no stream is on both sides (row L7)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from tideline.functions.scores import channel_sum
    from tideline.session import cut_lineage
    from tideline.sources.tables import frames

    f = frames(s, d, "score", "ood", "channels", "t_s", "nu_s")
    nu = f.groupBy("stream_id").agg(F.first("nu_s", ignorenulls=True).alias("nu"))
    x = f.filter("score is not null").join(nu, "stream_id").withColumn("y", F.coalesce(F.col("t_s") >= F.col("nu"), F.lit(False)).cast("double"))
    feats = F.array("score", F.coalesce("ood", F.lit(0.0)), F.coalesce(channel_sum(F.col("channels")), F.lit(0.0)))
    x = cut_lineage(x.select("stream_id", "tick", "y", feats.alias("f"), (u01(7, F.col("stream_id")) < 0.25).alias("held")))
    n = x.filter("not held").agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("p")).collect()[0]
    w = max(n.n - n.p, 1.0) / max(n.p, 1.0)
    train = x.filter("not held").withColumn("w", F.when(F.col("y") == 1, w).otherwise(1.0)).withColumn("x", array_to_vector("f"))
    m = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=1e-3, maxIter=50, standardization=False).fit(train)
    sc = m.transform(x.filter("held").withColumn("x", array_to_vector("f"))).select("stream_id", "tick", vector_to_array("rawPrediction")[1].alias("logit"), (F.col("y") == 1).alias("y"))
    ap = ranking.average_precision(sc, [], "logit", F.col("y"), ["stream_id", "tick"], 0.05).select(R6("average_precision").alias("average_precision"))
    base = sc.agg(F.count("*").alias("n_held"), R6(F.avg(F.col("y").cast("double"))).alias("share"))
    return base.crossJoin(F.broadcast(ap)).withColumn("n_train", F.lit(int(n.n)).cast("bigint"))  # one row each


@core.query("bound08_grouped_split", f"WITH g AS (SELECT DISTINCT channel_id FROM documents WHERE channel_id IS NOT NULL), r AS (SELECT channel_id, row_number() OVER (ORDER BY {u01_sql(8, 'channel_id')}, channel_id) AS r, count(*) OVER () AS n FROM g) SELECT channel_id FROM r WHERE r <= greatest(1, round(n * 0.2))")
def grouped_split(s: SparkSession, d: str) -> DataFrame:
    """A fifth of the groups, by hash, as the validation side."""
    from tideline.operators.sampling import take_smallest

    g = table(s, d, "documents").select("channel_id").filter("channel_id is not null").distinct().withColumn("k", F.lit(1))
    n = g.count()
    g = g.withColumn("want", F.lit(max(1, int(n * 0.2 + 0.5))))
    return take_smallest(g, ["k"], u01(8, F.col("channel_id")), "want", "channel_id").select("channel_id")


@core.query("bound09_zero_shot_viability", with_(_UN) + ", z AS (SELECT un.vec_id, any_value(un.label) < 5 AS y, round(max(list_dot_product(un.v, pt.p)) FILTER (pt.label < 5) - max(list_dot_product(un.v, pt.p)) FILTER (pt.label >= 5), 6) AS s FROM un, pt GROUP BY un.vec_id), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM z) SELECT round((sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 6) AS auroc FROM r")
def zero_shot(s: SparkSession, d: str) -> DataFrame:
    """Nearest prototype of one side less nearest of the other; a row per label, so the prototypes are literals."""
    e = emb(s, d)
    p = boundary.class_means(e, "label", "v").orderBy("label").collect()
    side = lambda ok: [vectors.dot(F.col("v"), F.array(*map(F.lit, r.proto))) for r in p if ok(r.label)]
    sc = e.select((F.col("label") < 5).alias("y"), R6(F.greatest(*side(lambda x: x < 5)) - F.greatest(*side(lambda x: x >= 5))).alias("s"))
    return ranking.auroc(sc, [], "s", F.col("y"), 0.02).select(R6("auroc").alias("auroc"))


@core.query("bound10_blended_needle", with_(EMB) + ", b AS (SELECT a.vec_id, list_transform(range(1, 65), lambda i: 0.7 * a.v[i] + 0.3 * b.v[i]) AS m FROM em a JOIN em b ON b.vec_id = a.vec_id - 1) SELECT vec_id, round(m[1] / greatest(sqrt(list_dot_product(m, m)), 1e-12), 6) AS first_, round(list_sum(m) / greatest(sqrt(list_dot_product(m, m)), 1e-12), 6) AS total FROM b")
def blended_needle(s: SparkSession, d: str) -> DataFrame:
    e = emb(s, d).select("vec_id", "v")
    m = e.join(e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("v").alias("w")), "vec_id").select("vec_id", F.zip_with("v", "w", lambda a, b: 0.7 * a + 0.3 * b).alias("m"))
    n = F.greatest(vectors.norm(F.col("m")), F.lit(1e-12))
    return m.select("vec_id", R6(F.get("m", F.lit(0)) / n).alias("first_"), R6(F.aggregate("m", F.lit(0.0), lambda a, x: a + x) / n).alias("total"))
