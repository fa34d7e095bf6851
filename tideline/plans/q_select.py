"""Selection of frames: eviction policies, diversity, importance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import vectors
from tideline.operators import evict
from tideline.plans.registry import core
from tideline.plans.sqlparts import EMB, FRAMES, with_
from tideline.session import cut_lineage, table
from tideline.sources.tables import frames

R6 = lambda c: F.round(c, 6)


@core.query("select01_fifo", with_(FRAMES) + " SELECT stream_id, tick FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY tick DESC) AS r FROM fr) WHERE r <= 8")
def fifo(s: SparkSession, d: str) -> DataFrame:
    return evict.newest(frames(s, d), ["stream_id"], "tick", 8)


@core.query(
    "select02_stride",
    with_(FRAMES) + ", i AS (SELECT stream_id, tick, row_number() OVER (PARTITION BY stream_id ORDER BY tick) - 1 AS i, count(*) OVER (PARTITION BY stream_id) AS n FROM fr) SELECT stream_id, tick FROM i WHERE n <= 8 OR list_contains(list_transform(range(8), lambda j: CAST(round_even(j * (n - 1) / 7.0, 0) AS BIGINT)), i)",
)
def stride(s: SparkSession, d: str) -> DataFrame:
    return evict.stride(frames(s, d), ["stream_id"], "tick", 8)


def _cover(rows: str, key: str, order: str, k: int, name: str) -> str:
    """CTEs of greedy coverage over ``rows`` (key, order, v, all of unit length): ``name`` has key, order, rank."""
    ctes = [f"{name}_c0 AS (SELECT {key}, {order}, v FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order} DESC) AS r FROM {rows}) WHERE r = 1)", f"{name}_d0 AS (SELECT {key}, {order}, v, 'Infinity'::DOUBLE AS d FROM {rows})"]
    for i in range(1, k):
        ctes.append(f"{name}_d{i} AS (SELECT a.{key}, a.{order}, a.v, least(a.d, round(1 - list_dot_product(a.v, c.v), 9)) AS d FROM {name}_d{i - 1} a JOIN {name}_c{i - 1} c USING ({key}) WHERE a.{order} <> c.{order})")
        ctes.append(f"{name}_c{i} AS (SELECT {key}, {order}, v FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY d DESC, {order}) AS r FROM {name}_d{i}) WHERE r = 1)")
    return ", ".join(ctes) + f", {name} AS (" + " UNION ALL ".join(f"SELECT {key}, {order}, {i} AS rank FROM {name}_c{i}" for i in range(k)) + ")"


_UNIT = EMB + ", un AS (SELECT label, vec_id, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v FROM em)"


@core.query("select03_coverage", with_(_UNIT, _cover("un", "label", "vec_id", 5, "cv")) + " SELECT * FROM cv")
def coverage(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings").select("label", "vec_id", vectors.doubles(F.col("embedding")).alias("v"))
    return evict.coverage(e, "label", "vec_id", "v", 5)


# Frames carry no vectors: the frame of tick t takes the vector t mod the number of vectors. Every seventh frame counts as a keyframe.
_SEEN = (
    FRAMES
    + ", em AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12)) AS v FROM embeddings), sn AS (SELECT stream_id, tick, t_s, score, v FROM fr JOIN em ON em.vec_id = tick % (SELECT count(*) FROM embeddings))"
    + ", sl AS (SELECT *, round(coalesce(score, 0) + 0.5 * abs(coalesce(score, 0) - coalesce(lag(score) OVER (PARTITION BY stream_id ORDER BY tick), 0)) + 0.3 * CAST(tick % 7 = 0 AS INT) + 0.2 * (t_s - min(t_s) OVER (PARTITION BY stream_id)) / greatest(max(t_s) OVER (PARTITION BY stream_id) - min(t_s) OVER (PARTITION BY stream_id), 1e-9), 9) AS salience, row_number() OVER (PARTITION BY stream_id ORDER BY tick) - 1 AS i, count(*) OVER (PARTITION BY stream_id) AS n FROM sn)"
)


def _top(k: int) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY salience DESC, tick) AS r FROM sl) WHERE r <= {k})"


def _hybrid(k: int) -> str:
    c = f"cv{k // 2}"
    return f"(SELECT stream_id, tick, 'coverage' AS why FROM {c} UNION ALL SELECT stream_id, tick, 'salience' FROM (SELECT t.stream_id, t.tick, row_number() OVER (PARTITION BY t.stream_id ORDER BY t.tick) AS q, h.have FROM {_top(k)} t JOIN (SELECT stream_id, count(*) AS have FROM {c} GROUP BY stream_id) h USING (stream_id) WHERE NOT EXISTS (SELECT 1 FROM {c} x WHERE x.stream_id = t.stream_id AND x.tick = t.tick)) WHERE q <= {k} - have)"


def _stream_rows(s: SparkSession, d: str, vector: bool = True) -> DataFrame:
    """Frames with their vector, or with its number only (of vectors few enough to be sent along)."""
    e = table(s, d, "embeddings").select("vec_id", vectors.doubles(F.col("embedding")).alias("v"))
    n = e.count()
    f = frames(s, d, "t_s", "score").withColumn("vec_id", F.col("tick") % n).withColumn("keyframe", F.col("tick") % 7 == 0)
    return f.join(e, "vec_id").drop("vec_id") if vector else f.join(F.broadcast(e.select("vec_id")), "vec_id")


@core.query("select04_salience", with_(_SEEN) + f" SELECT stream_id, tick, round(salience, 6) AS salience FROM {_top(8)}")
def salience(s: SparkSession, d: str) -> DataFrame:
    return evict.salient(_stream_rows(s, d).drop("v"), ["stream_id"], "tick", 8).select("stream_id", "tick", R6("salience").alias("salience"))


@core.query("select05_hybrid", with_(_SEEN, _cover("sn", "stream_id", "tick", 4, "cv4")) + f" SELECT h.stream_id, h.tick, why FROM {_hybrid(8)} h JOIN (SELECT DISTINCT stream_id FROM sl WHERE n > 8) USING (stream_id) UNION ALL SELECT sl.stream_id, sl.tick, coalesce(why, 'all') FROM sl LEFT JOIN {_hybrid(8)} h USING (stream_id, tick) WHERE n <= 8")
def hybrid(s: SparkSession, d: str) -> DataFrame:
    """Half by coverage, from the newest, then filled by salience."""
    return evict.hybrid(_stream_rows(s, d), ["stream_id"], "tick", 8).select("stream_id", "tick", "why")


def _agree(k: int) -> str:
    places = f"list_contains(list_transform(range({k}), lambda j: CAST(round_even(j * (n - 1) / {float(k - 1)}, 0) AS BIGINT)), i)"
    kept = {
        "fifo": f"SELECT stream_id, tick FROM sl WHERE i >= n - {k}",
        "stride": f"SELECT stream_id, tick FROM sl WHERE n <= {k} OR {places}",
        "coverage": f"SELECT stream_id, tick FROM cv{k}",
        "salience": f"SELECT stream_id, tick FROM {_top(k)}",
        "hybrid": f"SELECT stream_id, tick FROM {_hybrid(k)} UNION SELECT stream_id, tick FROM sl WHERE n <= {k}",
    }
    return " UNION ALL ".join(f"SELECT '{p}' AS policy, {k} AS keep, stream_id, tick FROM ({q})" for p, q in kept.items())


@core.query(
    "select09_agreement_at_budget",
    with_(_SEEN, *[_cover("sn", "stream_id", "tick", k, f"cv{k}") for k in (2, 4, 8)], f"ke AS ({_agree(4)} UNION ALL {_agree(8)}), ba AS (SELECT stream_id, bool_or(coalesce(score, 0) >= 1.5) AS a FROM sl GROUP BY stream_id), ju AS (SELECT policy, keep, stream_id, bool_or(coalesce(score, 0) >= 1.5) AS b FROM ke JOIN sl USING (stream_id, tick) GROUP BY ALL)")
    + " SELECT policy, CAST(keep AS BIGINT) AS keep, count(*) AS n, count(*) FILTER (a = b) AS n_agree FROM ju JOIN ba USING (stream_id) GROUP BY ALL",
)
def agreement_at_budget(s: SparkSession, d: str) -> DataFrame:
    """All five policies at two budgets: for how many streams "any score of 1.5 or more" is still answered alike (rows E8 and E9)."""
    judge = F.bool_or(F.coalesce("score", F.lit(0.0)) >= 1.5)
    e = table(s, d, "embeddings").select("vec_id", vectors.doubles(F.col("embedding")).alias("v"))
    known = evict.Known.of(e, "vec_id", "v")
    if known is None:
        return evict.agreement(cut_lineage(_stream_rows(s, d)), ["stream_id"], "tick", judge, [4, 8])
    return evict.agreement(cut_lineage(_stream_rows(s, d, vector=False)), ["stream_id"], "tick", judge, [4, 8], cols=evict.Columns(vector="vec_id", known=known))


_IMP = FRAMES + ", y AS (SELECT stream_id, tick, coalesce(score, 0) >= 1 AS hit FROM fr), im AS (SELECT *, count(*) FILTER (hit) OVER (PARTITION BY stream_id) AS pos, count(*) OVER (PARTITION BY stream_id) AS n FROM y)"


@core.query("select06_leave_one_out", with_(_IMP) + " SELECT stream_id, tick, hit AND pos = 1 AS decisive FROM im")
def leave_one_out(s: SparkSession, d: str) -> DataFrame:
    """Whether leaving the frame out changes the verdict 'any score of 1 or more': only a sole hit does."""
    return evict.importance(frames(s, d, "score"), ["stream_id"], "tick", F.coalesce("score", F.lit(0.0)) >= 1)


@core.query(
    "select07_concentration",
    with_(FRAMES) + ", w AS (SELECT stream_id, greatest(coalesce(score, 0), 0) AS w FROM fr), p AS (SELECT stream_id, w / sum(w) OVER (PARTITION BY stream_id) AS p, count(*) OVER (PARTITION BY stream_id) AS n FROM w WHERE w > 0), c AS (SELECT stream_id, -sum(p * ln(p)) AS h FROM p GROUP BY stream_id), n AS (SELECT stream_id, count(*) AS n FROM fr GROUP BY stream_id) SELECT n.stream_id, round(coalesce(1 - h / ln(greatest(n, 2)), 0), 6) AS concentration FROM n LEFT JOIN c USING (stream_id)",
)
def concentration(s: SparkSession, d: str) -> DataFrame:
    """One less the entropy of the weights over its maximum: from sums alone, so no group is gathered."""
    w = F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0))
    g = frames(s, d, "score").withColumn("w", w).groupBy("stream_id").agg(F.count("*").alias("n"), F.sum("w").alias("z"), F.sum(F.when(F.col("w") > 0, F.col("w") * F.ln("w")).otherwise(0.0)).alias("l"))
    h = F.ln("z") - F.col("l") / F.col("z")
    return g.select("stream_id", F.when(F.col("z") > 0, R6(1 - h / F.ln(F.greatest("n", F.lit(2))))).otherwise(0.0).alias("concentration"))


@core.query(
    "select08_hindsight_agreement",
    with_(_IMP + ", r AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY hit DESC, tick DESC) AS r FROM im)") + " SELECT stream_id, bool_or(hit) AS verdict_all, bool_or(hit) FILTER (r <= 4) AS verdict_kept, bool_or(hit) = bool_or(hit) FILTER (r <= 4) AS agrees FROM r GROUP BY stream_id",
)
def hindsight(s: SparkSession, d: str) -> DataFrame:
    """Targets in hindsight: of four places, first the hits, then the newest."""
    f = frames(s, d, "score").withColumn("hit", F.coalesce("score", F.lit(0.0)) >= 1)
    kept = evict.top(f.withColumn("old", -F.col("tick")), ["stream_id"], F.col("hit"), "old", 4)
    g = f.groupBy("stream_id").agg(F.bool_or("hit").alias("verdict_all")).join(kept.groupBy("stream_id").agg(F.bool_or("hit").alias("verdict_kept")), "stream_id")
    return g.withColumn("agrees", F.col("verdict_all") == F.col("verdict_kept"))
