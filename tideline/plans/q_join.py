"""Joins: citations, gaps, intervals, nearest rows, retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions import protocol, vectors
from tideline.plans.registry import core
from tideline.plans.sqlparts import CLIPS, EMB, STEPS, with_
from tideline.session import table
from tideline.sources.tables import clips, frames

R6 = lambda c: F.round(c, 6)
#: A policy is a document of at most so many clauses; more are joined by shuffle.
CLAUSES = 10_000


def stepped(s: SparkSession, d: str, *cols: str) -> DataFrame:
    return protocol.with_step(frames(s, d, "action_raw", *cols, where="action_raw is not null"))


def resolve(citations: DataFrame, clauses: DataFrame, column: str) -> DataFrame:
    """Adds clause_id and reason: exact, not_enforced, ordinal, prefix, ambiguous_prefix, unknown or empty.

    Distinct citations meet the clauses, each by all prefixes of the clauses' ids: an equality, not a comparison of all pairs.
    """
    enforced = clauses.filter(F.col("status").isin("active", "deprecated")).select("id")
    cites = citations.select(F.col(column).alias("c")).filter("c is not null").distinct()
    exact = clauses.select(F.col("id").alias("c"), F.col("status").isin("active", "deprecated").alias("enforced"))
    prefixes = enforced.select("id", F.explode(F.expr("transform(sequence(1, length(id)), n -> substr(id, 1, n))")).alias("c")).groupBy("c").agg(F.count("*").alias("n"), F.min("id").alias("one"))
    r = cites.join(exact, "c", "left").join(prefixes, "c", "left")
    reason = F.when(F.col("enforced"), "exact").when(F.col("enforced").isNotNull(), "not_enforced").when(F.col("c").rlike("^[0-9]+$"), "ordinal").when(F.col("n") == 1, "prefix").when(F.col("n") > 1, "ambiguous_prefix").otherwise("unknown")
    r = r.withColumn("reason", reason).select(F.col("c").alias(column), F.when(F.col("reason") == "exact", F.col("c")).when(F.col("reason") == "prefix", F.col("one")).alias("clause_id"), "reason")
    return citations.join(r, column, "left").withColumn("reason", F.coalesce("reason", F.lit("empty")))


_RESOLVED = (
    STEPS
    + ", en AS (SELECT id FROM policy_clauses WHERE status IN ('active', 'deprecated')), ci AS (SELECT DISTINCT citation AS c FROM st WHERE citation IS NOT NULL), px AS (SELECT ci.c, count(en.id) AS n, min(en.id) AS one FROM ci LEFT JOIN en ON starts_with(en.id, ci.c) GROUP BY ci.c),"
    + " rs AS (SELECT px.c, px.one, CASE WHEN p.status IN ('active', 'deprecated') THEN 'exact' WHEN p.id IS NOT NULL THEN 'not_enforced' WHEN regexp_full_match(px.c, '[0-9]+') THEN 'ordinal' WHEN n = 1 THEN 'prefix' WHEN n > 1 THEN 'ambiguous_prefix' ELSE 'unknown' END AS reason FROM px LEFT JOIN policy_clauses p ON p.id = px.c),"
    + " re AS (SELECT st.*, CASE WHEN reason = 'exact' THEN c WHEN reason = 'prefix' THEN one END AS clause_id, coalesce(reason, 'empty') AS reason FROM st LEFT JOIN rs ON rs.c = st.citation)"
)


@core.query("join01_resolve_citation", with_(_RESOLVED) + " SELECT stream_id, tick, citation, clause_id, reason FROM re")
def resolve_citation(s: SparkSession, d: str) -> DataFrame:
    f = stepped(s, d).select("stream_id", "tick", F.col("s.policy_citation").alias("citation"))
    return resolve(f, table(s, d, "policy_clauses"), "citation").select("stream_id", "tick", "citation", "clause_id", "reason")


_GAPS = "cv AS (SELECT DISTINCT category FROM policy_clauses WHERE status IN ('active', 'deprecated')), un AS (SELECT * FROM st WHERE action = 'uncovered' AND (suggested IS NULL OR suggested NOT IN (SELECT category FROM cv)))"


def uncovered(s: SparkSession, d: str) -> DataFrame:
    f = stepped(s, d, "t_s").filter("s.action = 'uncovered'").select("stream_id", "tick", "t_s", F.col("s.suggested_category").alias("category"))
    covered = table(s, d, "policy_clauses").filter(F.col("status").isin("active", "deprecated")).select("category").distinct()
    return f.join(covered, "category", "left_anti")


@core.query("join02_uncovered_cases", with_(STEPS, _GAPS) + " SELECT stream_id, tick, suggested AS category FROM un")
def uncovered_cases(s: SparkSession, d: str) -> DataFrame:
    return uncovered(s, d).select("stream_id", "tick", "category")


_GRID = CLIPS + ", cd AS (SELECT id, media.duration_s AS dur, label.events AS ev FROM cl WHERE media.duration_s IS NOT NULL AND granularity = 'temporal'), gr AS (SELECT id, dur, ev, unnest(range(1, CAST(floor(dur / 60) AS BIGINT) + 1)) * 60.0 AS t FROM cd)"


@core.query("join03_interval_anti", with_(_GRID) + " SELECT id, count(*) AS n_free FROM gr WHERE len(list_filter(ev, lambda e: e.t_start_s - 60 < t AND t < e.t_end_s + 60)) = 0 GROUP BY id")
def interval_anti(s: SparkSession, d: str) -> DataFrame:
    """Grid windows of a clip that touch none of its events: both stand in one row, so no join is needed at all."""
    c = clips(s, d, "media.duration_s", "label.events", "granularity").filter("media_duration_s is not null and granularity = 'temporal'")
    g = c.filter("media_duration_s >= 60").select("id", F.col("label_events").alias("ev"), F.explode(F.expr("sequence(1, cast(floor(media_duration_s / 60) as int))")).alias("k")).withColumn("t", F.col("k") * 60.0)
    free = g.filter(~F.exists("ev", lambda e: (e["t_start_s"] - 60 < F.col("t")) & (F.col("t") < e["t_end_s"] + 60)))
    return free.groupBy("id").agg(F.count("*").alias("n_free"))


@core.query(
    "join04_nearest_order",
    "WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT event_id AS vid, user_id, ts AS vts FROM events WHERE event_type = 'view'), j AS (SELECT e.event_id, vid, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(epoch_us(ts) - epoch_us(vts)), vts, vid) AS r FROM e JOIN v ON v.user_id = e.user_id AND abs(epoch_us(ts) - epoch_us(vts)) <= 86400000000) SELECT event_id, vid AS nearest_view FROM j WHERE r = 1",
)
def nearest_order(s: SparkSession, d: str) -> DataFrame:
    """The view nearest to each purchase of the same user within a day, before or after: an as-of join on day-long chunks."""
    e = table(s, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    day = 86_400_000_000
    p = e.filter("event_type = 'purchase'").select("event_id", "user_id", "us").withColumn("b", F.explode(F.expr(f"sequence(cast(floor(us / {day}) as bigint) - 1, cast(floor(us / {day}) as bigint) + 1)")))
    v = e.filter("event_type = 'view'").select(F.col("event_id").alias("vid"), "user_id", F.col("us").alias("vus")).withColumn("b", F.floor(F.col("vus") / day).cast("bigint"))
    j = p.join(v, ["user_id", "b"]).filter(F.abs(F.col("us") - F.col("vus")) <= day)
    best = j.groupBy("event_id").agg(F.min(F.struct(F.abs(F.col("us") - F.col("vus")).alias("dt"), "vus", "vid")).alias("m"))
    return best.select("event_id", F.col("m.vid").alias("nearest_view"))


@core.query(
    "join05_retrieval_top3",
    with_(EMB) + ", q AS (SELECT * FROM em WHERE vec_id % 50 = 0), j AS (SELECT q.vec_id AS query_id, em.vec_id, round(list_dot_product(q.v, em.v), 6) AS cos, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.v, em.v), 6) DESC, em.vec_id) AS r FROM q JOIN em ON em.vec_id <> q.vec_id) SELECT query_id, vec_id, cos FROM j WHERE r <= 3",
)
def retrieval_top3(s: SparkSession, d: str) -> DataFrame:
    """The three nearest of all vectors for the stated query set, the ids divisible by 50."""
    from tideline.operators.retrieval import top_similar

    e = table(s, d, "embeddings").select("vec_id", "embedding")
    return top_similar(e.filter("vec_id % 50 = 0"), e, "vec_id", "embedding", 3)


@core.query(
    "join06_default_left",
    with_(STEPS) + ", o AS (SELECT DISTINCT * FROM stream_outcomes), es AS (SELECT stream_id, bool_or(action = 'flag') AS flagged FROM st GROUP BY stream_id) SELECT o.stream_id, coalesce(es.flagged, o.tau_s IS NOT NULL) AS escalated FROM o LEFT JOIN es USING (stream_id)",
)
def default_left(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "stream_outcomes").distinct()
    es = stepped(s, d).groupBy("stream_id").agg(F.bool_or(F.col("s.action") == "flag").alias("flagged"))
    return o.join(es, "stream_id", "left").select("stream_id", F.coalesce("flagged", F.col("tau_s").isNotNull()).alias("escalated"))


@core.query("join07_pool_overlap", "SELECT count(*) AS n_shared FROM (SELECT DISTINCT video_path FROM annotations) a JOIN (SELECT DISTINCT source.video_path AS video_path FROM clips WHERE source.video_path IS NOT NULL) c USING (video_path)")
def pool_overlap(s: SparkSession, d: str) -> DataFrame:
    """Keys that two sets share, as a semi join."""
    a = table(s, d, "annotations").select("video_path").distinct()
    c = table(s, d, "clips").select(F.col("source.video_path").alias("video_path"))
    return a.join(c, "video_path", "left_semi").agg(F.count("*").alias("n_shared"))


@core.query(
    "join08_nearest_duration",
    "WITH p AS (SELECT p_partkey, p_retailprice FROM part), s AS (SELECT s_suppkey, s_acctbal FROM supplier), j AS (SELECT s_suppkey, p_partkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(p_retailprice - s_acctbal), p_partkey) AS r FROM s JOIN p ON p_retailprice BETWEEN s_acctbal - 100 AND s_acctbal + 100) SELECT s_suppkey, p_partkey FROM j WHERE r = 1",
)
def nearest_duration(s: SparkSession, d: str) -> DataFrame:
    """The nearest value within 100: a join on neighbouring chunks of the value."""
    p = table(s, d, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("v")).withColumn("b", F.floor(F.col("v") / 100).cast("bigint"))
    q = table(s, d, "supplier").select("s_suppkey", F.col("s_acctbal").cast("double").alias("x")).withColumn("b", F.explode(F.expr("sequence(cast(floor(x / 100) as bigint) - 1, cast(floor(x / 100) as bigint) + 1)")))
    j = q.join(p, "b").filter("v between x - 100 and x + 100")
    return j.groupBy("s_suppkey").agg(F.min(F.struct(F.abs(F.col("v") - F.col("x")).alias("dv"), "p_partkey")).alias("m")).select("s_suppkey", F.col("m.p_partkey").alias("p_partkey"))


_PAIRS = STEPS + ", pr AS (SELECT a.stream_id, a.tick, a.action AS covering, b.action AS not_covering, a.citation FROM st a JOIN st b ON b.stream_id = a.stream_id AND b.tick = a.tick + 1)"


def step_pairs(s: SparkSession, d: str) -> DataFrame:
    f = stepped(s, d).select("stream_id", "tick", F.col("s.action").alias("covering"), F.col("s.policy_citation").alias("citation"))
    g = f.select("stream_id", (F.col("tick") - 1).alias("tick"), F.col("covering").alias("not_covering"))
    return f.join(g, ["stream_id", "tick"])


@core.query("join10_counterfactual_pairs", with_(_PAIRS) + " SELECT covering, not_covering, count(*) AS n FROM pr GROUP BY ALL")
def counterfactual_pairs(s: SparkSession, d: str) -> DataFrame:
    """Answers side by side with those of the next tick (rows J9 and J10)."""
    return step_pairs(s, d).groupBy("covering", "not_covering").agg(F.count("*").alias("n"))


@core.query(
    "join11_strata_2x2",
    with_(STEPS) + ", o AS (SELECT DISTINCT stream_id, nu_s, tau_s FROM stream_outcomes WHERE nu_s IS NOT NULL), f AS (SELECT stream_id, bool_or(action = 'flag') AS b FROM st GROUP BY stream_id) SELECT CASE WHEN a AND b THEN 'A' WHEN b THEN 'B' WHEN NOT a THEN 'C' END AS stratum, count(*) AS n FROM (SELECT coalesce(tau_s >= nu_s, false) AS a, coalesce(f.b, false) AS b FROM o LEFT JOIN f USING (stream_id)) GROUP BY 1",
)
def strata(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "stream_outcomes").select("stream_id", "nu_s", "tau_s").filter("nu_s is not null").distinct()
    f = stepped(s, d).groupBy("stream_id").agg(F.bool_or(F.col("s.action") == "flag").alias("b"))
    j = o.join(f, "stream_id", "left").select(F.coalesce(F.col("tau_s") >= F.col("nu_s"), F.lit(False)).alias("a"), F.coalesce("b", F.lit(False)).alias("b"))
    return j.groupBy(F.when(F.col("a") & F.col("b"), "A").when(F.col("b"), "B").when(~F.col("a"), "C").alias("stratum")).agg(F.count("*").alias("n"))
