"""Aggregations, statistics and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.operators import bounds, ranking
from tideline.operators.ordered import previous
from tideline.plans.q_join import _GAPS, _PAIRS, _RESOLVED, resolve, step_pairs, stepped, uncovered
from tideline.plans.q_scalar import _ROUTE, routed
from tideline.plans.registry import core
from tideline.plans.sqlparts import FRAMES, STEPS, clopper_pearson, with_
from tideline.rng import u01, u01_sql
from tideline.session import table
from tideline.sources.tables import frames

R6 = lambda c: F.round(c, 6)
_OUT = "o AS (SELECT *, nu_s IS NOT NULL AND tau_s IS NOT NULL AND tau_s >= nu_s AS detected, CASE WHEN tau_s >= nu_s THEN tau_s - nu_s END AS delay FROM (SELECT DISTINCT * FROM stream_outcomes))"


def outcomes(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "stream_outcomes").distinct()
    return o.withColumn("detected", F.coalesce(F.col("tau_s") >= F.col("nu_s"), F.lit(False))).withColumn("delay", F.when(F.col("tau_s") >= F.col("nu_s"), F.col("tau_s") - F.col("nu_s")))


_CONF = STEPS + ", nu AS (SELECT stream_id, any_value(nu_s) AS nu FROM fr GROUP BY stream_id), cf AS (SELECT st.stream_id, action = 'flag' AS pred, coalesce(t_s >= nu, false) AS truth FROM st JOIN nu USING (stream_id))"


@core.query(
    "agg01_confusion",
    with_(_CONF) + ", c AS (SELECT count(*) FILTER (pred AND truth) AS tp, count(*) FILTER (pred AND NOT truth) AS fp, count(*) FILTER (NOT pred AND truth) AS fn, count(*) FILTER (NOT pred AND NOT truth) AS tn FROM cf) SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision_, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c",
)
def confusion(s: SparkSession, d: str) -> DataFrame:
    f = stepped(s, d, "t_s")
    nu = frames(s, d, "nu_s").groupBy("stream_id").agg(F.first("nu_s", ignorenulls=True).alias("nu"))
    c = f.join(nu, "stream_id").select((F.col("s.action") == "flag").alias("p"), F.coalesce(F.col("t_s") >= F.col("nu"), F.lit(False)).alias("t"))
    n = lambda x: F.count(F.when(x, 1))
    c = c.agg(n(F.col("p") & F.col("t")).alias("tp"), n(F.col("p") & ~F.col("t")).alias("fp"), n(~F.col("p") & F.col("t")).alias("fn"), n(~F.col("p") & ~F.col("t")).alias("tn"))
    r = lambda a, b: R6(F.when(b > 0, a / b).otherwise(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("*", r(tp, tp + fp).alias("precision_"), r(tp, tp + fn).alias("recall"), r(2 * tp, 2 * tp + fp + fn).alias("f1"))


@core.query(
    "agg02_operating_point",
    with_(_OUT) + """, g AS (SELECT coalesce(stratum, '?') AS stratum, detected, delay, nu_s, n_false_alarms, cost, row_number() OVER (PARTITION BY coalesce(stratum, '?') ORDER BY delay NULLS LAST) - 1 AS i, count(delay) OVER (PARTITION BY coalesce(stratum, '?')) AS nd FROM o)
 SELECT stratum, count(*) AS n, round(CASE WHEN count(nu_s) > 0 THEN count(*) FILTER (detected) / count(nu_s) END, 6) AS recall, round(sum(n_false_alarms) / (count(*) / 60.0), 6) AS fa_per_hour, round(avg(delay), 6) AS mean_delay_s, round(min(delay) FILTER (i = CAST(round_even(0.9 * (nd - 1), 0) AS BIGINT)), 6) AS p90_delay_s, round(avg(cost), 6) AS cost FROM g GROUP BY stratum""",
)
def operating_point(s: SparkSession, d: str) -> DataFrame:
    """Recall, false alarms per hour, delays and cost together (rows A2 and A3); p90 is the nearest rank, rounded half to even."""
    o = outcomes(s, d).withColumn("stratum", F.coalesce("stratum", F.lit("?")))
    p90 = ranking.value_at(o, ["stratum"], "delay", 1.0, {"p90": lambda n: F.bround(0.9 * (n - 1))}).select("stratum", "p90")
    g = o.groupBy("stratum").agg(F.count("*").alias("n"), F.count("nu_s").alias("u"), F.count(F.when(F.col("detected"), 1)).alias("det"), F.sum("n_false_alarms").alias("fa"), F.avg("delay").alias("md"), F.avg("cost").alias("c")).join(p90, "stratum", "left")
    return g.select("stratum", "n", R6(F.when(F.col("u") > 0, F.col("det") / F.col("u"))).alias("recall"), R6(F.col("fa") / (F.col("n") / 60.0)).alias("fa_per_hour"), R6("md").alias("mean_delay_s"), R6("p90").alias("p90_delay_s"), R6("c").alias("cost"))


@core.query(
    "agg04_pareto",
    "WITH p AS (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS x, (o_orderkey * 7919) % 100003 AS y FROM orders), m AS (SELECT *, max(y) OVER (ORDER BY x, y DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM p) SELECT o_orderkey, round(x, 6) AS x, y FROM m WHERE best IS NULL OR y > best",
)
def pareto(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("x"), (F.col("o_orderkey") * 7919 % 100003).alias("y"))
    return ranking.pareto(p, "x", "y", "o_orderkey", 1000.0).select("o_orderkey", R6("x").alias("x"), "y")


_PTS = _OUT + ", pt AS (SELECT coalesce(category, '?') AS k, round(count(*) FILTER (detected) / greatest(count(nu_s), 1), 9) AS r, round(avg(n_false_alarms), 9) AS f, round(coalesce(avg(delay), 'Infinity'::DOUBLE), 9) AS dl, round(avg(cost), 9) AS c FROM o GROUP BY 1)"


@core.query("agg05_dominance", with_(_PTS) + " SELECT a.k AS winner, b.k AS loser FROM pt a JOIN pt b ON a.k <> b.k AND a.r >= b.r AND a.f <= b.f AND a.dl <= b.dl AND a.c <= b.c AND (a.r > b.r OR a.f < b.f OR a.dl < b.dl OR a.c < b.c)")
def dominance(s: SparkSession, d: str) -> DataFrame:
    """Which operating point is nowhere worse than another and somewhere better; one point per category, so few rows meet."""
    r9 = lambda c: F.round(c, 9)
    p = outcomes(s, d).groupBy(F.coalesce("category", F.lit("?")).alias("k")).agg(r9(F.count(F.when(F.col("detected"), 1)) / F.greatest(F.count("nu_s"), F.lit(1))).alias("r"), r9(F.avg("n_false_alarms")).alias("f"), r9(F.coalesce(F.avg("delay"), F.lit(float("inf")))).alias("dl"), r9(F.avg("cost")).alias("c"))
    pts = p.groupBy(F.lit(1).alias("one")).agg(F.collect_list(F.struct("k", "r", "f", "dl", "c")).alias("ps"))  # a row per category
    a, b = F.col("a"), F.col("b")
    ge = (a["r"] >= b["r"]) & (a["f"] <= b["f"]) & (a["dl"] <= b["dl"]) & (a["c"] <= b["c"])
    gt = (a["r"] > b["r"]) | (a["f"] < b["f"]) | (a["dl"] < b["dl"]) | (a["c"] < b["c"])
    x = pts.select("ps", F.explode("ps").alias("a")).select("a", F.explode("ps").alias("b"))
    return x.filter((a["k"] != b["k"]) & ge & gt).select(a["k"].alias("winner"), b["k"].alias("loser"))


@core.query("agg06_stratified_roc", with_(_OUT) + " SELECT coalesce(stratum, '?') AS stratum, count(nu_s) AS n_pos, count(*) - count(nu_s) AS n_neg, round(count(*) FILTER (detected) / nullif(count(nu_s), 0), 6) AS recall, round(count(*) FILTER (nu_s IS NULL AND n_false_alarms > 0) / nullif(count(*) - count(nu_s), 0), 6) AS fpr, round(avg(CASE WHEN tau_s IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS escalation_rate FROM o GROUP BY 1")
def stratified_roc(s: SparkSession, d: str) -> DataFrame:
    g = outcomes(s, d).groupBy(F.coalesce("stratum", F.lit("?")).alias("stratum")).agg(F.count("nu_s").alias("n_pos"), F.count(F.when(F.col("nu_s").isNull(), 1)).alias("n_neg"), F.count(F.when(F.col("detected"), 1)).alias("det"), F.count(F.when(F.col("nu_s").isNull() & (F.col("n_false_alarms") > 0), 1)).alias("fp"), R6(F.avg(F.col("tau_s").isNotNull().cast("double"))).alias("escalation_rate"))
    return g.select("stratum", "n_pos", "n_neg", R6(F.when(F.col("n_pos") > 0, F.col("det") / F.col("n_pos"))).alias("recall"), R6(F.when(F.col("n_neg") > 0, F.col("fp") / F.col("n_neg"))).alias("fpr"), "escalation_rate")


@core.query("agg07_graceful_degradation", with_(_OUT) + ", g AS (SELECT category, count(*) AS n, count(*) FILTER (detected) / count(*) AS p FROM o WHERE nu_s IS NOT NULL GROUP BY category) SELECT category, n, round(p, 6) AS recall, p >= 0.8 - 1.96 * sqrt(0.8 * 0.2 / n) AS ok FROM g")
def graceful_degradation(s: SparkSession, d: str) -> DataFrame:
    g = outcomes(s, d).filter("nu_s is not null").groupBy("category").agg(F.count("*").alias("n"), F.avg(F.col("detected").cast("double")).alias("p"))
    return g.select("category", "n", R6("p").alias("recall"), (F.col("p") >= 0.8 - 1.96 * F.sqrt(0.8 * 0.2 / F.col("n"))).alias("ok"))


@core.query(
    "agg10_sensitivity",
    with_(_PAIRS) + ", g AS (SELECT stream_id, count(*) AS n, avg(CASE WHEN covering <> not_covering THEN 1.0 ELSE 0.0 END) AS flip, avg(CASE WHEN covering = 'flag' AND not_covering <> 'flag' THEN 1.0 ELSE 0.0 END) AS correct, bool_and(covering = 'flag' AND not_covering = 'flag') AS always_flag, bool_and(covering = not_covering) AS always_same FROM pr GROUP BY stream_id) SELECT stream_id, n, round(flip, 6) AS flip_rate, round(correct, 6) AS correct_rate, always_flag, always_same, CASE WHEN correct >= 0.8 THEN 'sensitive' WHEN flip >= 0.5 THEN 'unsteady' ELSE 'insensitive' END AS verdict FROM g",
)
def sensitivity(s: SparkSession, d: str) -> DataFrame:
    a, b = F.col("covering"), F.col("not_covering")
    g = step_pairs(s, d).groupBy("stream_id").agg(F.count("*").alias("n"), F.avg((a != b).cast("double")).alias("flip"), F.avg(((a == "flag") & (b != "flag")).cast("double")).alias("correct"), F.bool_and((a == "flag") & (b == "flag")).alias("always_flag"), F.bool_and(a == b).alias("always_same"))
    return g.select("stream_id", "n", R6("flip").alias("flip_rate"), R6("correct").alias("correct_rate"), "always_flag", "always_same", F.when(F.col("correct") >= 0.8, "sensitive").when(F.col("flip") >= 0.5, "unsteady").otherwise("insensitive").alias("verdict"))


_LAB = FRAMES + ", nu AS (SELECT stream_id, any_value(nu_s) AS nu FROM fr GROUP BY stream_id), lb AS (SELECT fr.stream_id, tick, score, coalesce(t_s >= nu, false) AS y FROM fr JOIN nu USING (stream_id) WHERE score IS NOT NULL)"


def labelled(s: SparkSession, d: str) -> DataFrame:
    f = frames(s, d, "score", "t_s", "nu_s")
    nu = f.groupBy("stream_id").agg(F.first("nu_s", ignorenulls=True).alias("nu"))
    return f.filter("score is not null").join(nu, "stream_id").select("stream_id", "tick", "score", F.coalesce(F.col("t_s") >= F.col("nu"), F.lit(False)).alias("y"))


@core.query(
    "agg11_auroc",
    with_(_LAB) + ", r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM lb) SELECT round((sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 6) AS auroc FROM r",
)
def auroc(s: SparkSession, d: str) -> DataFrame:
    return ranking.auroc(labelled(s, d), [], "score", F.col("y"), 0.05).select(R6("auroc").alias("auroc"))


@core.query(
    "agg12_average_precision",
    with_(_LAB) + ", r AS (SELECT y, row_number() OVER w AS r, sum(CAST(y AS INT)) OVER w AS h FROM lb WINDOW w AS (ORDER BY score DESC, stream_id, tick ROWS UNBOUNDED PRECEDING)) SELECT round(sum(h / r) FILTER (y) / count(*) FILTER (y), 6) AS average_precision FROM r",
)
def average_precision(s: SparkSession, d: str) -> DataFrame:
    return ranking.average_precision(labelled(s, d), [], "score", F.col("y"), ["stream_id", "tick"], 0.05).select(R6("average_precision").alias("average_precision"))


_POS = _OUT + ", ps AS (SELECT category, count(*) AS n, count(*) FILTER (NOT detected) AS miss FROM o WHERE nu_s IS NOT NULL GROUP BY category)"


@core.query("agg13_recall_lower_bound", f"WITH RECURSIVE {_POS}, {clopper_pearson('miss', 'n', '0.1', 'ps', 'cp')} SELECT category, ps.n, miss, round(1 - ucb, 6) AS lower_bound, CAST(ceil(ln(0.1) / ln(0.95)) AS BIGINT) AS n_needed FROM ps JOIN cp ON cp.k = ps.miss AND cp.n = ps.n")
def recall_lower_bound(s: SparkSession, d: str) -> DataFrame:
    """Exact lower bound of the recall per category, with the samples a bound of .95 would need (rows A13 and A14)."""
    g = outcomes(s, d).filter("nu_s is not null").groupBy("category").agg(F.count("*").alias("n"), F.count(F.when(~F.col("detected"), 1)).alias("miss"))
    return g.select("category", "n", "miss", R6(1 - bounds.exact_ucb_col("miss", "n", F.lit(0.1))).alias("lower_bound"), F.lit(bounds.min_calibration_n(0.95)).cast("bigint").alias("n_needed"))


_RISK = FRAMES + ", g AS (SELECT stream_id, count(risk) AS n, avg(risk) AS m, var_pop(risk) AS v, sum(risk) AS k, bool_and(risk IN (0, 1)) AS zero_one FROM fr WHERE risk IS NOT NULL GROUP BY stream_id)"
_BOUNDS = f"""WITH RECURSIVE {_RISK}, zo AS (SELECT CAST(round(k) AS BIGINT) AS k, n FROM g WHERE zero_one), {clopper_pearson('k', 'n', '0.1', 'zo', 'cp')},
 bd AS (SELECT stream_id, g.n, m, m + sqrt(ln(20) / (2 * g.n)) AS hoeffding, CASE WHEN g.n < 2 THEN 1.0 ELSE m + sqrt(2 * v * ln(20) / g.n) + 7 * ln(20) / (3 * (g.n - 1)) END AS bernstein, coalesce(ucb, m + sqrt(ln(20) / (2 * g.n))) AS exact FROM g LEFT JOIN cp ON zero_one AND cp.k = round(g.k) AND cp.n = g.n)"""
_WEALTH = """, od AS (SELECT stream_id, tick, risk, k, CASE k WHEN 0 THEN tick WHEN 1 THEN -tick ELSE CAST(concat('0x', substr(md5(concat_ws(':', '0', CAST(k AS VARCHAR), stream_id, CAST(tick AS VARCHAR))), 1, 8)) AS BIGINT) END AS o FROM fr, range(22) t(k) WHERE risk IS NOT NULL),
 bt AS (SELECT *, least(0.5, greatest(0, coalesce((0.2 - avg(risk) OVER w) / 0.16, 0))) AS bet FROM od WINDOW w AS (PARTITION BY stream_id, k ORDER BY o, tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 wl AS (SELECT stream_id, k, count(*) AS n, CASE WHEN bool_or(1 + bet * (0.2 - risk) <= 0) THEN 0 ELSE exp(sum(ln(greatest(1e-300, 1 + bet * (0.2 - risk))))) END AS w FROM bt GROUP BY stream_id, k),
 ew AS (SELECT stream_id, any_value(n) AS n, min(w) AS min_wealth, any_value(n) > 1 AND min(w) >= 10 AS certified FROM wl GROUP BY stream_id)"""


def _risks(s: SparkSession, d: str) -> DataFrame:
    return frames(s, d, "risk", where="risk is not null")


@core.query("agg15_risk_bounds", _BOUNDS + " SELECT stream_id, n, round(hoeffding, 6) AS hoeffding, round(bernstein, 6) AS bernstein, round(exact, 6) AS exact FROM bd")
def risk_bounds(s: SparkSession, d: str) -> DataFrame:
    """Upper bounds of the mean risk, of the risks as they are; the exact one falls back to Hoeffding's where risks are not 0 or 1."""
    b = bounds.summary(_risks(s, d), "stream_id", "risk", 0.1)
    return b.select("stream_id", "n", *[R6(c).alias(c) for c in ("hoeffding", "bernstein", "exact")])


@core.query("agg16_ecrc", f"WITH {FRAMES}{_WEALTH} SELECT stream_id, n, round(min_wealth, 6) AS min_wealth, certified FROM ew")
def ecrc(s: SparkSession, d: str) -> DataFrame:
    """Certification by betting, per stream: the least final wealth over 22 orderings."""
    return bounds.ecrc(_risks(s, d), "stream_id", "tick", "risk", 0.2, 0.1).select("stream_id", "n", R6("min_wealth").alias("min_wealth"), "certified")


@core.query("agg17_compare_bounds", _BOUNDS + _WEALTH + " SELECT stream_id, b.name AS bound, round(b.ucb, 6) AS ucb, b.ok AS certifies FROM (SELECT bd.stream_id, unnest([{'name': 'hoeffding', 'ucb': hoeffding, 'ok': hoeffding <= 0.2}, {'name': 'bernstein', 'ucb': bernstein, 'ok': bernstein <= 0.2}, {'name': 'exact', 'ucb': exact, 'ok': exact <= 0.2}, {'name': 'ecrc', 'ucb': NULL, 'ok': certified}]) AS b FROM bd JOIN ew USING (stream_id))")
def compare_bounds(s: SparkSession, d: str) -> DataFrame:
    """The four bounds side by side, four rows per stream: their value and whether they certify a risk of .2."""
    b = bounds.summary(_risks(s, d), "stream_id", "risk", 0.1).join(bounds.ecrc(_risks(s, d), "stream_id", "tick", "risk", 0.2, 0.1).select("stream_id", "certified"), "stream_id")
    row = lambda name, ucb, ok: F.struct(F.lit(name).alias("bound"), R6(ucb).alias("ucb"), ok.alias("certifies"))
    rows = [row(c, F.col(c), F.col(c) <= 0.2) for c in ("hoeffding", "bernstein", "exact")] + [row("ecrc", F.lit(None).cast("double"), F.col("certified"))]
    return b.select("stream_id", F.explode(F.array(*rows)).alias("b")).select("stream_id", "b.*")


@core.query(
    "agg18_abstention_floor",
    with_(_RISK) + " SELECT stream_id, round(greatest(0, (m - 0.05) / (1 - 0.05)), 6) AS floor, m <= 0.05 AS certifiable, round(CASE WHEN m > 0 THEN 1 / (0.01 * m) END, 6) AS audit_items_per_miss FROM g",
)
def abstention_floor(s: SparkSession, d: str) -> DataFrame:
    """Least share that must abstain to reach a risk of .05, and what one audited miss costs in items (rows A18 and A19)."""
    g = _risks(s, d).groupBy("stream_id").agg(F.avg("risk").alias("m"))
    m = F.col("m")
    return g.select("stream_id", R6(F.greatest(F.lit(0.0), (m - 0.05) / (1 - 0.05))).alias("floor"), (m <= 0.05).alias("certifiable"), R6(F.when(m > 0, 1 / (0.01 * m))).alias("audit_items_per_miss"))


@core.query(
    "agg21_realtime_tiers",
    _ROUTE + ", e AS (SELECT stream_id, avg(CASE WHEN route <> 'decide_safe' THEN 1.0 ELSE 0.0 END) AS r, count(*) / greatest(max(t_s) - min(t_s), 1) AS fps FROM rt GROUP BY stream_id), u AS (SELECT stream_id, fps * 0.0218 AS u1, fps * r * 1.526 AS u2 FROM e) SELECT stream_id, round(u1, 6) AS sentinel, round(u2, 6) AS midtier, u1 < 1 AND u2 < 1 AS feasible, round(CASE WHEN u2 < 1 THEN 1.526 * u2 / (1 - u2) ELSE 'Infinity'::DOUBLE END, 6) AS queue_delay_s, CASE WHEN u1 >= u2 THEN 'sentinel' ELSE 'midtier' END AS bottleneck, CAST(floor(1 / (u1 + u2)) AS BIGINT) AS streams_per_device FROM u",
)
def realtime_tiers(s: SparkSession, d: str) -> DataFrame:
    """Utilisation of each tier at the observed rates, queueing delay, and streams a device holds (rows A21 and A22)."""
    e = routed(s, d).groupBy("stream_id").agg(F.avg((F.col("route") != "decide_safe").cast("double")).alias("r"), (F.count("*") / F.greatest(F.max("t_s") - F.min("t_s"), F.lit(1.0))).alias("fps"))
    u = e.select("stream_id", (F.col("fps") * 0.0218).alias("u1"), (F.col("fps") * F.col("r") * 1.526).alias("u2"))
    u1, u2 = F.col("u1"), F.col("u2")
    return u.select("stream_id", R6(u1).alias("sentinel"), R6(u2).alias("midtier"), ((u1 < 1) & (u2 < 1)).alias("feasible"), F.when(u2 < 1, R6(1.526 * u2 / (1 - u2))).otherwise(F.lit(float("inf"))).alias("queue_delay_s"), F.when(u1 >= u2, "sentinel").otherwise("midtier").alias("bottleneck"), F.floor(1 / (u1 + u2)).cast("bigint").alias("streams_per_device"))


@core.query("agg23_cascade_algebra", _ROUTE + ", g AS (SELECT stream_id, count(*) AS n, sum(0.0218 + CASE WHEN route <> 'decide_safe' THEN 1.526 ELSE 0 END) / count(*) AS overall FROM rt GROUP BY stream_id) SELECT stream_id, round(overall, 6) AS overall_s, round((overall - 0.0218) / 1.526, 6) AS escalation, (overall - 0.0218) / 1.526 BETWEEN -1e-9 AND 1 + 1e-9 AS consistent, round(1.526 / overall, 6) AS speedup, overall <= 2 AS in_time FROM g")
def cascade_algebra(s: SparkSession, d: str) -> DataFrame:
    """Escalation rate and speed-up implied by a stream's mean seconds a frame and the times of the two tiers."""
    fast, slow = 0.0218, 1.526
    g = routed(s, d).groupBy("stream_id").agg((F.sum(fast + F.when(F.col("route") != "decide_safe", slow).otherwise(0.0)) / F.count("*")).alias("o"))
    r = (F.col("o") - fast) / slow
    return g.select("stream_id", R6("o").alias("overall_s"), R6(r).alias("escalation"), r.between(-1e-9, 1 + 1e-9).alias("consistent"), R6(slow / F.col("o")).alias("speedup"), (F.col("o") <= 2).alias("in_time"))


@core.query(
    "agg24_router_stats",
    _ROUTE + " SELECT route, count(*) AS n, round(count(*) / (SELECT count(*) FROM rt), 6) AS share, count(*) FILTER (score < 0 AND o > 0.5) AS blind_spots FROM rt GROUP BY route",
)
def router_stats(s: SparkSession, d: str) -> DataFrame:
    """Counts per route, and the rows a rule on the score alone would wave through although they look unlike anything known."""
    r = routed(s, d).groupBy("route").agg(F.count("*").alias("n"), F.count(F.when((F.col("score") < 0) & (F.coalesce("ood", F.lit(0.0)) > 0.5), 1)).alias("blind_spots"))
    return r.withColumn("share", R6(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))))


@core.query("agg25_policy_gaps", with_(STEPS, _GAPS) + " SELECT coalesce(suggested, '<none>') AS category, count(*) AS n, round(min(t_s), 1) AS first_s, round(max(t_s), 1) AS last_s, count(*) >= 5 AS actionable FROM un GROUP BY 1")
def policy_gaps(s: SparkSession, d: str) -> DataFrame:
    return uncovered(s, d).groupBy(F.coalesce("category", F.lit("<none>")).alias("category")).agg(F.count("*").alias("n"), F.round(F.min("t_s"), 1).alias("first_s"), F.round(F.max("t_s"), 1).alias("last_s"), (F.count("*") >= 5).alias("actionable"))


@core.query("agg26_corpus_diff", "WITH a AS (SELECT DISTINCT category FROM policy_clauses WHERE status = 'active'), b AS (SELECT DISTINCT category FROM policy_clauses WHERE status IN ('active', 'draft')) SELECT coalesce(a.category, b.category) AS category, CASE WHEN a.category IS NULL THEN 'added' ELSE 'removed' END AS change FROM a FULL JOIN b ON a.category = b.category WHERE a.category IS NULL OR b.category IS NULL")
def corpus_diff(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "policy_clauses")
    a = p.filter("status = 'active'").select("category").distinct().withColumn("a", F.lit(1))
    b = p.filter(F.col("status").isin("active", "draft")).select("category").distinct().withColumn("b", F.lit(1))
    return a.join(b, "category", "full").filter("a is null or b is null").select("category", F.when(F.col("a").isNull(), "added").otherwise("removed").alias("change"))


@core.query("agg27_sequence_stats", with_(FRAMES) + ", g AS (SELECT stream_id, t_s - lag(t_s) OVER (PARTITION BY stream_id ORDER BY tick) AS gap FROM fr) SELECT stream_id, count(*) AS n, round(avg(gap), 6) AS gap_mean, round(stddev_pop(gap), 6) AS gap_std, round(max(gap), 6) AS gap_max FROM g GROUP BY stream_id")
def sequence_stats(s: SparkSession, d: str) -> DataFrame:
    f = previous(frames(s, d, "t_s"), ["stream_id"], "tick", F.col("t_s"), "p").withColumn("gap", F.col("t_s") - F.col("p"))
    return f.groupBy("stream_id").agg(F.count("*").alias("n"), R6(F.avg("gap")).alias("gap_mean"), R6(F.stddev_pop("gap")).alias("gap_std"), R6(F.max("gap")).alias("gap_max"))


@core.query("agg31_best_round", with_(_CONF) + ", g AS (SELECT stream_id, count(*) FILTER (pred AND truth) AS tp, count(*) FILTER (pred <> truth) AS bad FROM cf GROUP BY stream_id), f AS (SELECT stream_id, round(2 * tp / greatest(2 * tp + bad, 1), 6) AS f1 FROM g) SELECT max(f1) AS best_f1, min(stream_id) FILTER (f1 = (SELECT max(f1) FROM f)) AS best FROM f")
def best_round(s: SparkSession, d: str) -> DataFrame:
    f = stepped(s, d, "t_s")
    nu = frames(s, d, "nu_s").groupBy("stream_id").agg(F.first("nu_s", ignorenulls=True).alias("nu"))
    p, t = F.col("s.action") == "flag", F.coalesce(F.col("t_s") >= F.col("nu"), F.lit(False))
    g = f.join(nu, "stream_id").groupBy("stream_id").agg(F.count(F.when(p & t, 1)).alias("tp"), F.count(F.when(p != t, 1)).alias("bad"))
    g = g.withColumn("f1", R6(2 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("bad"), F.lit(1))))
    # The largest F1, of equals the smallest id: a minimum over (-F1, id).
    return g.agg(F.min(F.struct((-F.col("f1")).alias("m"), "stream_id")).alias("b")).select((-F.col("b.m")).alias("best_f1"), F.col("b.stream_id").alias("best"))


@core.query(
    "agg32_judge_checks",
    with_(_CONF) + ", g AS (SELECT stream_id, count(*) FILTER (truth) AS p, count(*) FILTER (NOT truth) AS n, count(*) FILTER (pred AND truth) AS tp, count(*) FILTER (pred <> truth) AS bad, count(DISTINCT pred) AS kinds FROM cf GROUP BY stream_id) SELECT stream_id, round(2 * p / greatest(2 * p + n, 1), 6) AS all_flag_f1, round(2 * tp / greatest(2 * tp + bad, 1), 6) AS f1, 2 * tp / greatest(2 * tp + bad, 1) > 2 * p / greatest(2 * p + n, 1) + 1e-9 AS beats_constant, kinds > 1 AS judging FROM g",
)
def judge_checks(s: SparkSession, d: str) -> DataFrame:
    f = stepped(s, d, "t_s")
    nu = frames(s, d, "nu_s").groupBy("stream_id").agg(F.first("nu_s", ignorenulls=True).alias("nu"))
    x = f.join(nu, "stream_id").select("stream_id", (F.col("s.action") == "flag").alias("p"), F.coalesce(F.col("t_s") >= F.col("nu"), F.lit(False)).alias("t"))
    n = lambda c: F.count(F.when(c, 1))
    g = x.groupBy("stream_id").agg(n(F.col("t")).alias("P"), n(~F.col("t")).alias("N"), n(F.col("p") & F.col("t")).alias("tp"), n(F.col("p") != F.col("t")).alias("bad"), (F.max("p") != F.min("p")).alias("judging"))
    base, f1 = 2 * F.col("P") / F.greatest(2 * F.col("P") + F.col("N"), F.lit(1)), 2 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("bad"), F.lit(1))
    return g.select("stream_id", R6(base).alias("all_flag_f1"), R6(f1).alias("f1"), (f1 > base + 1e-9).alias("beats_constant"), "judging")


@core.query("agg33_protocol_scorecard", with_(_RESOLVED) + " SELECT stream_id, count(*) AS n, count(*) FILTER (action = 'flag') AS n_flag, count(*) FILTER (action = 'invalid') AS n_invalid, round(1 - count(*) FILTER (action = 'invalid') / count(*), 6) AS valid_rate, count(*) FILTER (reason = 'exact') AS n_exact, count(*) FILTER (reason = 'prefix') AS n_prefix, count(*) FILTER (reason IN ('ordinal', 'unknown', 'ambiguous_prefix', 'not_enforced')) AS n_unresolved FROM re GROUP BY stream_id")
def protocol_scorecard(s: SparkSession, d: str) -> DataFrame:
    f = stepped(s, d).select("stream_id", F.col("s.action").alias("a"), F.col("s.policy_citation").alias("citation"))
    r = resolve(f, table(s, d, "policy_clauses"), "citation")
    n = lambda c: F.count(F.when(c, 1))
    return r.groupBy("stream_id").agg(F.count("*").alias("n"), n(F.col("a") == "flag").alias("n_flag"), n(F.col("a") == "invalid").alias("n_invalid"), R6(1 - n(F.col("a") == "invalid") / F.count("*")).alias("valid_rate"), n(F.col("reason") == "exact").alias("n_exact"), n(F.col("reason") == "prefix").alias("n_prefix"), n(F.col("reason").isin("ordinal", "unknown", "ambiguous_prefix", "not_enforced")).alias("n_unresolved"))
