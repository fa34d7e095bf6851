"""Sequential and stateful operators over scored frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions import protocol, scores, vectors
from tideline.operators import steps
from tideline.operators.ordered import carry_last, fold, last_rows, previous, reflected_sum, running, sliding
from tideline.operators.ranking import quantile
from tideline.plans.registry import core
from tideline.plans.sqlparts import CLIPS, EMB, FRAMES, STEPS, with_
from tideline.rng import u01, u01_sql
from tideline.session import table
from tideline.sources.tables import clips, frames

R6 = lambda c: F.round(c, 6)

_LIND = FRAMES + ", x AS (SELECT *, score - 0.6 AS x FROM fr WHERE score IS NOT NULL), p AS (SELECT *, sum(x) OVER w AS p FROM x WINDOW w AS (PARTITION BY stream_id ORDER BY tick)), l AS (SELECT *, p - least(0, min(p) OVER (PARTITION BY stream_id ORDER BY tick)) AS stat FROM p)"


def lindley(s: SparkSession, d: str) -> DataFrame:
    f = frames(s, d, "score", "t_s", "nu_s", where="score is not null").withColumn("x", scores.llr(F.col("score")) - 0.1)
    return reflected_sum(f, ["stream_id"], "tick", "x")


@core.query("stream01_cusum_closed_form", with_(_LIND) + " SELECT stream_id, tick, round(stat, 6) AS stat, stat >= 5 AS above FROM l")
def cusum_closed_form(s: SparkSession, d: str) -> DataFrame:
    return lindley(s, d).select("stream_id", "tick", R6("stat").alias("stat"), (F.col("stat") >= 5).alias("above"))


_RESET = f"""WITH RECURSIVE {FRAMES}, o AS (SELECT stream_id, tick, t_s, nu_s, score, row_number() OVER (PARTITION BY stream_id ORDER BY tick) AS rn FROM fr WHERE score IS NOT NULL),
 r AS (SELECT stream_id, rn, greatest(0.0, score - 0.6) AS before FROM o WHERE rn = 1 UNION ALL SELECT o.stream_id, o.rn, greatest(0.0, CASE WHEN r.before >= 5 THEN 0.0 ELSE r.before END + o.score - 0.6) FROM r JOIN o ON o.stream_id = r.stream_id AND o.rn = r.rn + 1),
 a AS (SELECT o.*, r.before, r.before >= 5 AS alarm FROM o JOIN r USING (stream_id, rn))"""


def cusum_reset(s: SparkSession, d: str) -> DataFrame:
    f = frames(s, d, "score", "t_s", "nu_s", where="score is not null")
    return fold(f, ["stream_id"], ["tick", "t_s", "nu_s"], steps.Cusum(), ["score"], "stat_before_reset double, stat double, alarm boolean")


@core.query("stream01_cusum_reset", _RESET + " SELECT stream_id, tick, round(before, 6) AS stat_before_reset, round(CASE WHEN alarm THEN 0 ELSE before END, 6) AS stat, alarm FROM a")
def cusum_with_reset(s: SparkSession, d: str) -> DataFrame:
    """With reset on alarm (rows T1 and T2)."""
    return cusum_reset(s, d).select("stream_id", "tick", R6("stat_before_reset").alias("stat_before_reset"), R6("stat").alias("stat"), "alarm")


@core.query("flagship_first_alarm", with_(_LIND) + ", g AS (SELECT stream_id, min(t_s) FILTER (stat >= 5) AS tau_s, any_value(nu_s) AS nu_s, count(*) AS n FROM l GROUP BY stream_id) SELECT stream_id, n, round(tau_s, 6) AS tau_s, CASE WHEN tau_s IS NOT NULL AND nu_s IS NOT NULL THEN round(greatest(0, tau_s - nu_s), 6) END AS delay_s FROM g")
def first_alarm(s: SparkSession, d: str) -> DataFrame:
    """Per stream the first alarm of the change detector and its delay behind the known change."""
    g = lindley(s, d).groupBy("stream_id").agg(F.min(F.when(F.col("stat") >= 5, F.col("t_s"))).alias("tau_s"), F.first("nu_s", ignorenulls=True).alias("nu_s"), F.count("*").alias("n"))
    return g.select("stream_id", "n", R6("tau_s").alias("tau_s"), R6(F.greatest(F.when(F.col("tau_s").isNotNull() & F.col("nu_s").isNotNull(), F.lit(0.0)), F.col("tau_s") - F.col("nu_s"))).alias("delay_s"))


@core.query(
    "stream03_jittered_schedule",
    with_(FRAMES) + f", j AS (SELECT stream_id, tick, greatest(0.001, CASE WHEN coalesce(score, 0) > 1 THEN 0.25 ELSE 2.0 END + 0.4 * ({u01_sql(3, 'stream_id', 'tick')} - 0.5)) AS gap FROM fr) SELECT stream_id, tick, round(sum(gap) OVER (PARTITION BY stream_id ORDER BY tick), 6) AS next_t FROM j",
)
def jittered_schedule(s: SparkSession, d: str) -> DataFrame:
    """Sampling times: one gap per tick, short after a high score, with jitter from the hash; a running sum, not a recurrence."""
    f = frames(s, d, "score")
    gap = F.greatest(F.lit(0.001), F.when(F.coalesce("score", F.lit(0.0)) > 1, 0.25).otherwise(2.0) + 0.4 * (u01(3, F.col("stream_id"), F.col("tick")) - 0.5))
    return running(f, ["stream_id"], "tick", gap, "t").select("stream_id", "tick", R6("t").alias("next_t"))


@core.query("stream04_expected_delay", with_(FRAMES) + ", nu AS (SELECT stream_id, any_value(nu_s) AS nu FROM fr GROUP BY stream_id HAVING any_value(nu_s) IS NOT NULL), g AS (SELECT stream_id, avg(score) FILTER (t_s < nu) AS m0, avg(score) FILTER (t_s >= nu) AS m1, stddev_pop(score) FILTER (t_s < nu) AS sd FROM fr JOIN nu USING (stream_id) GROUP BY stream_id) SELECT stream_id, round(m0, 4) AS mu0, round(m1, 4) AS mu1, round(CASE WHEN (m1 - m0) * (m1 - m0) / (2 * sd * sd) > 0 THEN 5.0 / ((m1 - m0) * (m1 - m0) / (2 * sd * sd)) ELSE 'Infinity'::DOUBLE END, 4) AS expected_delay FROM g WHERE m0 IS NOT NULL AND m1 IS NOT NULL AND sd > 0")
def expected_delay(s: SparkSession, d: str) -> DataFrame:
    """Threshold over the Kullback-Leibler distance of the Gaussians before and after each stream's change; infinite without any."""
    f = frames(s, d, "score", "t_s", "nu_s")
    nu = f.groupBy("stream_id").agg(F.first("nu_s", ignorenulls=True).alias("nu")).filter("nu is not null")
    late = F.col("t_s") >= F.col("nu")
    # Scores have few digits, so means often lie right between two values of four: they are rounded from exact sums, which no order of rows
    # changes. Where a score doesn't fit such a sum, from the mean as it is.
    digits = F.col("score").try_cast("decimal(30,12)")
    exact = lambda x: F.when(F.count(F.when(x, digits)) == F.count(F.when(x, F.col("score"))), F.sum(F.when(x, digits)) / F.count(F.when(x, digits)))
    means = [F.avg(F.when(~late, F.col("score"))).alias("m0"), F.avg(F.when(late, F.col("score"))).alias("m1"), exact(~late).alias("e0"), exact(late).alias("e1")]
    g = f.join(nu, "stream_id").groupBy("stream_id").agg(*means, F.stddev_pop(F.when(~late, F.col("score"))).alias("sd"))
    kl = (F.col("m1") - F.col("m0")) * (F.col("m1") - F.col("m0")) / (2 * F.col("sd") * F.col("sd"))
    g = g.filter("m0 is not null and m1 is not null and sd > 0")
    return g.select("stream_id", *[F.coalesce(F.round("e" + i, 4).cast("double"), F.round("m" + i, 4)).alias("mu" + i) for i in "01"], F.round(F.when(kl > 0, 5.0 / kl).otherwise(float("inf")), 4).alias("expected_delay"))


@core.query(
    "stream05_ring_buffer",
    with_(FRAMES) + " SELECT a.stream_id, a.tick, count(*) AS n_held, round(min(b.t_s), 6) AS oldest_t, round(sum(coalesce(b.score, 0)), 6) AS score_sum FROM fr a JOIN fr b ON b.stream_id = a.stream_id AND b.t_s BETWEEN a.t_s - 30 AND a.t_s GROUP BY a.stream_id, a.tick",
)
def ring_buffer(s: SparkSession, d: str) -> DataFrame:
    """What the last 30 seconds hold at each frame (rows T5 and T8)."""
    f = frames(s, d, "t_s", "score")
    r = sliding(f, ["stream_id"], "t_s", 30, {"n_held": lambda w: F.count("*").over(w), "oldest": lambda w: F.min("t_s").over(w), "ssum": lambda w: F.sum(F.coalesce("score", F.lit(0.0))).over(w)})
    return r.select("stream_id", "tick", "n_held", R6("oldest").alias("oldest_t"), R6("ssum").alias("score_sum"))


@core.query(
    "stream05_buffer_bytes",
    with_(FRAMES) + """, f AS (SELECT stream_id, tick, 1000 + (tick * 7919) % 9000 AS nbytes FROM fr), c AS (SELECT a.stream_id, a.tick, b.tick AS bt, sum(b.nbytes) OVER (PARTITION BY a.stream_id, a.tick ORDER BY b.tick DESC) AS newer FROM f a JOIN f b ON b.stream_id = a.stream_id AND b.tick BETWEEN a.tick - 40 AND a.tick)
 SELECT stream_id, tick, CAST(count(*) FILTER (newer <= 65536) AS BIGINT) AS n_held FROM c GROUP BY stream_id, tick""",
)
def buffer_bytes(s: SparkSession, d: str) -> DataFrame:
    """How many of the newest frames fit a byte cap: differences of running totals, looked up among the last 40 ticks."""
    f = frames(s, d).withColumn("nbytes", 1000 + F.pmod(F.col("tick") * 7919, F.lit(9000)))
    f = running(f, ["stream_id"], "tick", F.col("nbytes"), "total")
    chunked = f.withColumn("_b", F.floor(F.col("tick") / 40))
    both = chunked.withColumn("_nat", F.lit(1)).unionByName(chunked.withColumn("_b", F.col("_b") + 1).withColumn("_nat", F.lit(0)))
    w = Window.partitionBy("stream_id", "_b").orderBy("tick").rangeBetween(-40, 0)
    both = both.withColumn("hist", F.collect_list(F.col("total") - F.col("nbytes")).over(w)).filter("_nat = 1")
    return both.select("stream_id", "tick", F.size(F.filter("hist", lambda x: F.col("total") - x <= 65536)).cast("bigint").alias("n_held"))


@core.query(
    "stream06_rewind",
    with_(FRAMES) + ", e AS (SELECT DISTINCT stream_id, nu_s FROM stream_outcomes WHERE nu_s IS NOT NULL) SELECT e.stream_id, count(*) AS n_frames, round(min(t_s), 6) AS t_first, round(max(t_s), 6) AS t_last FROM e JOIN fr ON fr.stream_id = e.stream_id AND fr.t_s BETWEEN e.nu_s - 10 AND e.nu_s + 5 GROUP BY e.stream_id",
)
def rewind(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "stream_outcomes").select("stream_id", F.col("nu_s").alias("nu")).filter("nu is not null").distinct()
    j = frames(s, d, "t_s").join(e, "stream_id").filter("t_s between nu - 10 and nu + 5")
    return j.groupBy("stream_id").agg(F.count("*").alias("n_frames"), R6(F.min("t_s")).alias("t_first"), R6(F.max("t_s")).alias("t_last"))


@core.query(
    "stream07_resample_nearest",
    with_(FRAMES) + """, e AS (SELECT DISTINCT stream_id, nu_s FROM stream_outcomes WHERE nu_s IS NOT NULL), tg AS (SELECT stream_id, nu_s - 4 + k AS target FROM e, range(9) t(k)),
 n AS (SELECT tg.stream_id, tg.target, fr.tick, row_number() OVER (PARTITION BY tg.stream_id, tg.target ORDER BY abs(fr.t_s - tg.target), fr.t_s, fr.tick) AS r FROM tg JOIN fr ON fr.stream_id = tg.stream_id AND fr.t_s BETWEEN tg.target - 8 AND tg.target + 8) SELECT DISTINCT stream_id, tick FROM n WHERE r = 1""",
)
def resample_nearest(s: SparkSession, d: str) -> DataFrame:
    """The frame nearest to each of nine target times around the change, each frame once. Targets look 8 seconds to either
    side: both sides are cut into chunks of that length, so the join is an equality on chunks."""
    e = table(s, d, "stream_outcomes").select("stream_id", F.col("nu_s").alias("nu")).filter("nu is not null").distinct()
    tg = e.select("stream_id", F.explode(F.expr("transform(sequence(0, 8), k -> nu - 4 + k)")).alias("target"))
    tg = tg.withColumn("b", F.explode(F.expr("sequence(cast(floor(target / 8) as bigint) - 1, cast(floor(target / 8) as bigint) + 1)")))
    f = frames(s, d, "t_s").withColumn("b", F.floor(F.col("t_s") / 8).cast("bigint"))
    j = f.join(tg, ["stream_id", "b"]).filter("t_s between target - 8 and target + 8")
    best = j.groupBy("stream_id", "target").agg(F.min(F.struct(F.abs(F.col("t_s") - F.col("target")).alias("dt"), "t_s", "tick")).alias("m"))
    return best.select("stream_id", F.col("m.tick").alias("tick")).distinct()


_DEDUP = f"""WITH RECURSIVE {EMB}, o AS (SELECT label, vec_id, v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM em),
 r AS (SELECT label, rn, vec_id, v AS kept, true AS keep FROM o WHERE rn = 1 UNION ALL SELECT o.label, o.rn, o.vec_id, CASE WHEN list_dot_product(o.v, r.kept) > 0.4 THEN r.kept ELSE o.v END, list_dot_product(o.v, r.kept) <= 0.4 FROM r JOIN o ON o.label = r.label AND o.rn = r.rn + 1)"""


@core.query("stream09_perceptual_dedup", _DEDUP + " SELECT label, vec_id, keep FROM r")
def perceptual_dedup(s: SparkSession, d: str) -> DataFrame:
    """Keep a vector unless it is too near to the last one kept; labels stand for streams."""
    e = table(s, d, "embeddings").select("label", "vec_id", vectors.doubles(F.col("embedding")).alias("v"))
    return fold(e, ["label"], ["vec_id"], steps.Dedup(0.6), ["v"], "keep boolean").select("label", "vec_id", "keep")


@core.query(
    "stream10_dedup_calibration",
    with_(EMB) + ", c AS (SELECT list_dot_product(a.v, b.v) AS c FROM em a JOIN em b ON b.vec_id = a.vec_id - 1), q AS (SELECT quantile_cont(c, 0.7) AS thr FROM c) SELECT round(any_value(thr), 6) AS threshold, round(greatest(1e-6, 1 - any_value(thr)), 6) AS delta, round(avg(CASE WHEN c <= thr THEN 1.0 ELSE 0.0 END), 6) AS achieved FROM c, q",
)
def dedup_calibration(s: SparkSession, d: str) -> DataFrame:
    """The threshold under which 70 % of neighbouring pairs fall, and the share it achieves."""
    e = table(s, d, "embeddings").select("vec_id", vectors.doubles(F.col("embedding")).alias("v"))
    c = e.join(e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("v").alias("w")), "vec_id").select(vectors.dot(F.col("v"), F.col("w")).alias("c"))
    thr = quantile(c, [], "c", 0.7, 0.01).collect()[0]["quantile"]  # one row
    return c.agg(R6(F.lit(thr)).alias("threshold"), R6(F.lit(max(1e-6, 1 - thr))).alias("delta"), R6(F.avg((F.col("c") <= thr).cast("double"))).alias("achieved"))


@core.query(
    "stream11_decode_budget",
    with_(FRAMES) + """, l AS (SELECT stream_id, list(t_s ORDER BY tick) AS ts FROM fr GROUP BY stream_id), r AS (SELECT stream_id, list_reduce(ts, lambda a, x: CASE WHEN a[1] IS NULL OR x[1] - a[1] >= 60 THEN [x[1], 1, a[3] + 1, a[4]] WHEN a[2] < 20 THEN [a[1], a[2] + 1, a[3] + 1, a[4]] ELSE [a[1], a[2], a[3], a[4] + 1] END, [NULL, 0, 0, 0]::DOUBLE[]) AS z FROM (SELECT stream_id, list_transform(ts, lambda t: [t]::DOUBLE[]) AS ts FROM l))
 SELECT stream_id, CAST(z[3] AS BIGINT) AS n_decoded, CAST(z[4] AS BIGINT) AS n_refused FROM r""",
)
def decode_budget(s: SparkSession, d: str) -> DataFrame:
    f = fold(frames(s, d, "t_s"), ["stream_id"], ["tick", "t_s"], steps.DecodeBudget(20, 60.0), ["t_s"], "ok boolean")
    return f.groupBy("stream_id").agg(F.count(F.when(F.col("ok"), 1)).alias("n_decoded"), F.count(F.when(~F.col("ok"), 1)).alias("n_refused"))


_ACI = FRAMES + ", l AS (SELECT stream_id, list(CAST(err AS DOUBLE) ORDER BY tick) AS es, count(*) AS t FROM fr WHERE err IS NOT NULL GROUP BY stream_id), r AS (SELECT *, list_reduce(es, lambda a, x: greatest(0.001, least(0.5, a + 0.02 * (x - 0.05))), 0.05) AS alpha FROM l)"


@core.query("stream12_aci", with_(_ACI) + " SELECT stream_id, t AS n_feedback, CAST(list_sum(es) AS BIGINT) AS n_errors, round(alpha, 6) AS alpha_t FROM r")
def aci(s: SparkSession, d: str) -> DataFrame:
    """Adaptive level after each stream's feedback; ticks without feedback don't move it (row T12)."""
    f = fold(frames(s, d, "err", where="err is not null"), ["stream_id"], ["tick", "err"], steps.Aci(gamma=0.02), ["err"], "alpha double")
    return f.groupBy("stream_id").agg(F.count("*").alias("n_feedback"), F.sum(F.col("err").cast("bigint")).alias("n_errors"), R6(F.max_by("alpha", "tick")).alias("alpha_t"))


@core.query("stream14_aci_warm_start", with_(_ACI.replace(", 0.05) AS alpha", ", 0.12) AS alpha")) + " SELECT stream_id, round(alpha, 6) AS alpha_t FROM r")
def aci_warm_start(s: SparkSession, d: str) -> DataFrame:
    """The same from the level an offline calibration gave (row T14), here .12."""
    f = fold(frames(s, d, "err", where="err is not null"), ["stream_id"], ["tick"], steps.Aci(gamma=0.02, start=0.12), ["err"], "alpha double")
    return f.groupBy("stream_id").agg(R6(F.max_by("alpha", "tick")).alias("alpha_t"))


@core.query(
    "stream13_aci_observables",
    with_(FRAMES) + ", g AS (SELECT stream_id, count(err) AS n, avg(CAST(err AS DOUBLE)) AS e FROM fr GROUP BY stream_id HAVING count(err) > 0) SELECT stream_id, n, round(e, 6) AS empirical_error, round(e - 0.05, 6) AS coverage_gap, round((0.05 + 1 / 0.02) / n, 6) AS gap_bound FROM g",
)
def aci_observables(s: SparkSession, d: str) -> DataFrame:
    g = frames(s, d, "err", where="err is not null").groupBy("stream_id").agg(F.count("*").alias("n"), F.avg(F.col("err").cast("double")).alias("e"))
    return g.select("stream_id", "n", R6("e").alias("empirical_error"), R6(F.col("e") - 0.05).alias("coverage_gap"), R6((0.05 + 1 / 0.02) / F.col("n")).alias("gap_bound"))


@core.query(
    "stream15_dtaci",
    f"""WITH RECURSIVE {FRAMES}, o AS (SELECT stream_id, CAST(err AS DOUBLE) AS e, row_number() OVER (PARTITION BY stream_id ORDER BY tick) AS rn FROM fr WHERE err IS NOT NULL), gm AS (SELECT unnest([0.005, 0.02, 0.08, 0.32])::DOUBLE AS gamma),
 r AS (SELECT stream_id, gamma, rn, e, greatest(0.001, least(0.5, 0.05 + gamma * (e - 0.05))) AS a FROM o, gm WHERE rn = 1 UNION ALL SELECT o.stream_id, r.gamma, o.rn, o.e, greatest(0.001, least(0.5, r.a + r.gamma * (o.e - 0.05))) FROM r JOIN o ON o.stream_id = r.stream_id AND o.rn = r.rn + 1),
 l AS (SELECT *, avg(abs(a - e)) OVER (PARTITION BY stream_id, gamma ORDER BY rn ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS loss, max(rn) OVER (PARTITION BY stream_id) AS n FROM r),
 w AS (SELECT stream_id, a, exp(-2 * (loss - min(loss) OVER (PARTITION BY stream_id))) AS w FROM l WHERE rn = n) SELECT stream_id, round(sum(w * a) / sum(w), 6) AS alpha_t FROM w GROUP BY stream_id""",
)
def dtaci(s: SparkSession, d: str) -> DataFrame:
    """Four experts with different rates, mixed by their mean loss |level - error| over the last 200 feedbacks, with the level of each."""
    f = fold(frames(s, d, "err", where="err is not null"), ["stream_id"], ["tick"], steps.DtAci(), ["err"], "alpha double")
    return f.groupBy("stream_id").agg(R6(F.max_by("alpha", "tick")).alias("alpha_t"))


@core.query(
    "stream16_anytime_monitor",
    with_(FRAMES)
    + """, x AS (SELECT stream_id, tick, tau, risk FROM fr, (SELECT unnest([-1.5, -1.0, -0.5, 0.0, 0.5, 1.0, 1.5])::DOUBLE AS tau) WHERE risk IS NOT NULL AND score < tau),
 f AS (SELECT stream_id, tau, tick, 1 + CASE WHEN row_number() OVER w <= 1 THEN 0 ELSE least(0.5, greatest(0, (0.2 - avg(risk) OVER (PARTITION BY stream_id, tau ORDER BY tick ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)) / 0.16)) END * (0.2 - risk) AS k FROM x WINDOW w AS (PARTITION BY stream_id, tau ORDER BY tick)),
 m AS (SELECT stream_id, tau, list_reduce(list_prepend([1.0, 1.0, 0.0]::DOUBLE[], list([k]::DOUBLE[] ORDER BY tick)), lambda a, b: CASE
  WHEN (a[3] = 1 OR a[1] * b[1] >= 10) AND a[1] * b[1] < 0.5 * CASE WHEN a[1] * b[1] >= 10 THEN greatest(a[2], a[1] * b[1]) ELSE a[2] END THEN [1.0, 1.0, 0.0]
  WHEN a[1] * b[1] >= 10 THEN [a[1] * b[1], greatest(a[2], a[1] * b[1]), 1.0] ELSE [greatest(0, a[1] * b[1]), a[2], a[3]] END) AS z FROM f GROUP BY stream_id, tau),
 b AS (SELECT stream_id, max(tau) FILTER (z[3] = 1) AS certified_tau, round(max(z[1]), 6) AS top_wealth FROM m GROUP BY stream_id)
 SELECT b.stream_id, certified_tau, top_wealth, round(1 - avg(CASE WHEN score < certified_tau THEN 1.0 ELSE 0.0 END), 6) AS abstention FROM fr JOIN b USING (stream_id) WHERE risk IS NOT NULL AND score IS NOT NULL GROUP BY ALL""",
)
def anytime_monitor(s: SparkSession, d: str) -> DataFrame:
    """One bet per stream and threshold over the samples below it; the largest certified threshold and the share not emitted
    (rows T16 and T17)."""
    f = frames(s, d, "score", "risk", where="risk is not null and score is not null")
    taus = [-1.5, -1.0, -0.5, 0.0, 0.5, 1.0, 1.5]
    x = f.withColumn("tau", F.explode(F.array(*map(F.lit, taus)))).filter("score < tau")
    m = fold(x, ["stream_id", "tau"], ["tick"], steps.Monitor(alpha=0.2), ["risk"], "wealth double, certified boolean")
    last = m.groupBy("stream_id", "tau").agg(F.max_by("certified", "tick").alias("certified"), F.max_by("wealth", "tick").alias("wealth"), F.count("*").alias("n"))
    best = last.groupBy("stream_id").agg(F.max(F.when(F.col("certified"), F.col("tau"))).alias("certified_tau"), R6(F.max("wealth")).alias("top_wealth"))
    emitted = f.join(best, "stream_id").groupBy("stream_id", "certified_tau", "top_wealth").agg(R6(1 - F.avg(F.coalesce((F.col("score") < F.col("certified_tau")).cast("double"), F.lit(0.0)))).alias("abstention"))
    return emitted


@core.query(
    "stream19_context_buffer",
    f"""WITH RECURSIVE {FRAMES}, o AS (SELECT stream_id, t_s, 40 + (tick * 31) % 60 AS tok, ood, row_number() OVER (PARTITION BY stream_id ORDER BY tick) AS rn FROM fr),
 r AS (SELECT stream_id, rn, [{{'i': rn, 't': t_s, 'k': tok, 'm': ood}}] AS kept, 0::BIGINT AS gone FROM o WHERE rn = 1
  UNION ALL SELECT stream_id, rn, kept, gone + was + 1 - len(kept) FROM (SELECT stream_id, rn, was, gone, list_filter(a, lambda x: x.i = rn OR list_sum(list_transform(a, lambda z: z.k)) - coalesce(list_sum(list_transform(list_filter(a, lambda y: y.i <> rn AND CASE WHEN len(list_filter(a, lambda u: u.m IS NULL)) > 0 THEN y.i < x.i ELSE y.m < x.m OR (y.m = x.m AND y.i < x.i) END), lambda w: w.k)), 0) <= 512) AS kept
   FROM (SELECT o.stream_id, o.rn, len(r.kept) AS was, r.gone, list_append(list_filter(r.kept, lambda x: o.t_s - x.t <= 16), {{'i': o.rn, 't': o.t_s, 'k': o.tok, 'm': o.ood}}) AS a FROM r JOIN o ON o.stream_id = r.stream_id AND o.rn = r.rn + 1)))
 SELECT stream_id, CAST(max(list_sum(list_transform(kept, lambda x: x.k))) AS BIGINT) AS max_tokens, max(gone) AS evicted, max(len(kept)) AS max_held FROM r GROUP BY stream_id""",
)
def context_buffer(s: SparkSession, d: str) -> DataFrame:
    """Token-bounded context per stream with eviction by age and importance (rows T19 and T22)."""
    f = frames(s, d, "t_s", "ood").withColumn("tokens", (40 + F.pmod(F.col("tick") * 31, F.lit(60))).cast("bigint"))
    c = fold(f, ["stream_id"], ["tick", "t_s"], steps.Context(512, 16.0), ["t_s", "tokens", "ood"], "n_held int, tokens_held bigint, evicted int, fits boolean")
    return c.groupBy("stream_id").agg(F.max("tokens_held").alias("max_tokens"), F.max("evicted").alias("evicted"), F.max("n_held").alias("max_held"))


@core.query(
    "stream20_policy_cache_hits",
    with_(STEPS) + ", c AS (SELECT stream_id, tick, citation, lag(citation) OVER (PARTITION BY stream_id ORDER BY tick) AS prev FROM st WHERE action = 'flag') SELECT stream_id, count(*) AS n, count(*) FILTER (citation = prev) AS n_hits FROM c GROUP BY stream_id",
)
def policy_cache_hits(s: SparkSession, d: str) -> DataFrame:
    """A header is reused where its key equals the one before."""
    f = protocol.with_step(frames(s, d, "action_raw", where="action_raw is not null")).filter("s.action = 'flag'").select("stream_id", "tick", F.col("s.policy_citation").alias("c"))
    f = previous(f, ["stream_id"], "tick", F.col("c"), "p")
    return f.groupBy("stream_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("c") == F.col("p"), 1)).alias("n_hits"))


_SESS = (
    STEPS
    + ", e AS (SELECT *, last_value(CASE WHEN action IN ('flag', 'clear') THEN action END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY tick) AS last_a, last_value(CASE WHEN action IN ('flag', 'clear') THEN action END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_a FROM st)"
    + ", se AS (SELECT *, last_a = 'flag' AS is_open, sum(CASE WHEN action = 'clear' AND before_a = 'flag' THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY tick) AS k FROM e)"
)


@core.query("stream23_event_sessions", with_(_SESS) + " SELECT stream_id, tick, coalesce(is_open, false) AS is_open, CAST(k AS BIGINT) AS event_idx FROM se")
def event_sessions(s: SparkSession, d: str) -> DataFrame:
    """flag opens an event, clear closes it (rows T21 and T23), without a fold: the last of the two actions decides."""
    f = protocol.with_step(frames(s, d, "action_raw", where="action_raw is not null")).select("stream_id", "tick", F.col("s.action").alias("a"))
    turn = F.when(F.col("a").isin("flag", "clear"), F.col("a"))
    f = carry_last(f, ["stream_id"], "tick", turn, "last_a")
    f = previous(f, ["stream_id"], "tick", F.col("last_a"), "prev")
    f = running(f, ["stream_id"], "tick", ((F.col("a") == "clear") & (F.coalesce("prev", F.lit("")) == "flag")).cast("bigint"), "k")
    return f.select("stream_id", "tick", F.coalesce(F.col("last_a") == "flag", F.lit(False)).alias("is_open"), F.col("k").cast("bigint").alias("event_idx"))


_PIPE = f"""{_RESET}, {STEPS.replace(FRAMES + ", ", "")}, nu AS (SELECT stream_id, any_value(nu_s) AS nu FROM fr GROUP BY stream_id),
 p1 AS (SELECT fr.stream_id, fr.tick, fr.t_s, nu, a.score, coalesce(a.alarm, false) AS alarm, coalesce(fr.ood, 0) AS ood, st.action AS act, {u01_sql('rho', 'fr.stream_id', 'fr.tick')} < 0.02 AS forced, {u01_sql('audit', 'fr.stream_id', 'fr.tick')} < 0.5 AS audited, exp(-(a.score * a.score)) AS b FROM fr JOIN nu USING (stream_id) LEFT JOIN a USING (stream_id, tick) LEFT JOIN st USING (stream_id, tick)),
 p2 AS (SELECT *, least(1.0, least(1.0, 0.4 * b + 0.6 * ood) + CASE WHEN alarm THEN 0.3 ELSE 0 END) AS u FROM p1),
 p3 AS (SELECT *, CASE WHEN score IS NULL THEN 'hold' WHEN forced THEN 'forced' WHEN u * sqrt(b) + 0.5 * u >= 0.25 OR score >= 0 OR ood >= 0.15 THEN 'escalate' ELSE 'decide_safe' END AS route FROM p2),
 p4 AS (SELECT *, CASE WHEN route IN ('forced', 'escalate') THEN act END AS seen FROM p3),
 p5 AS (SELECT *, last_value(CASE WHEN seen IN ('flag', 'clear') THEN seen END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lb FROM p4),
 pa AS (SELECT stream_id, list_reduce(list_prepend(0.05::DOUBLE, list(CAST(t_s >= nu AND coalesce(seen, '') <> 'flag' AS DOUBLE) ORDER BY tick)), lambda x, e: greatest(0.001, least(0.5, x + 0.002 * (e - 0.05)))) AS alpha FROM p4 WHERE audited AND nu IS NOT NULL GROUP BY stream_id)"""


@core.query(
    "stream24_pipeline_ticks",
    _PIPE
    + " SELECT p5.stream_id, count(*) AS n_ticks, count(*) FILTER (alarm) AS n_alarms, round(avg(CASE WHEN route IN ('forced', 'escalate') THEN 1.0 ELSE 0.0 END), 6) AS escalation_rate, round(min(t_s) FILTER (seen = 'flag'), 6) AS first_flag_s, CAST(count(*) FILTER (seen = 'clear' AND lb = 'flag') AS BIGINT) AS events_closed, round(coalesce(any_value(alpha), 0.05), 6) AS alpha_t FROM p5 LEFT JOIN pa USING (stream_id) GROUP BY p5.stream_id",
)
def pipeline_ticks(s: SparkSession, d: str) -> DataFrame:
    """The whole cascade per stream: detector with reset, route, session, audit feedback; one row per stream."""
    from tideline.operators.cascade import run_cascade

    t = run_cascade(frames(s, d, "t_s", "score", "ood", "action_raw", "nu_s"))
    return t.groupBy("stream_id").agg(F.count("*").alias("n_ticks"), F.count(F.when(F.col("alarm"), 1)).alias("n_alarms"), R6(F.avg(F.col("route").isin("forced", "escalate", "decide_unsafe").cast("double"))).alias("escalation_rate"), R6(F.min(F.when(F.col("action") == "flag", F.col("t_s")))).alias("first_flag_s"), F.max("event_idx").alias("events_closed"), R6(F.max_by("alpha", "tick")).alias("alpha_t"))


@core.query(
    "stream25_stream_result",
    with_(STEPS) + ", nu AS (SELECT stream_id, any_value(nu_s) AS nu_s FROM fr GROUP BY stream_id), g AS (SELECT stream_id, min(t_s) FILTER (action = 'flag') AS first_flag_s, avg(CASE WHEN action <> 'hold' THEN 1.0 ELSE 0.0 END) AS rate FROM st GROUP BY stream_id) SELECT g.stream_id, round(first_flag_s, 6) AS first_flag_s, CASE WHEN nu_s IS NOT NULL AND first_flag_s IS NOT NULL THEN round(greatest(0, first_flag_s - nu_s), 6) END AS delay_s, round(rate, 6) AS active_rate FROM g JOIN nu USING (stream_id)",
)
def stream_result(s: SparkSession, d: str) -> DataFrame:
    f = frames(s, d, "t_s", "action_raw", "nu_s")
    nu = f.groupBy("stream_id").agg(F.first("nu_s", ignorenulls=True).alias("nu_s"))
    g = protocol.with_step(f.filter("action_raw is not null")).withColumn("a", F.col("s.action"))
    g = g.groupBy("stream_id").agg(F.min(F.when(F.col("a") == "flag", F.col("t_s"))).alias("ff"), F.avg((F.col("a") != "hold").cast("double")).alias("rate")).join(nu, "stream_id")
    return g.select("stream_id", R6("ff").alias("first_flag_s"), F.when(F.col("nu_s").isNotNull() & F.col("ff").isNotNull(), R6(F.greatest(F.lit(0.0), F.col("ff") - F.col("nu_s")))).alias("delay_s"), R6("rate").alias("active_rate"))


@core.query(
    "stream26_router_calibration",
    with_(FRAMES) + " SELECT stream_id, count(*) AS n, round(quantile_cont(score, 0.95), 6) AS tau, round(greatest(stddev_pop(score), 1e-3), 6) AS margin FROM fr WHERE score IS NOT NULL AND (nu_s IS NULL OR t_s < nu_s) GROUP BY stream_id HAVING count(*) >= 10",
)
def router_calibration(s: SparkSession, d: str) -> DataFrame:
    f = frames(s, d, "score", "t_s", "nu_s", where="score is not null and (nu_s is null or t_s < nu_s)")
    q = quantile(f, ["stream_id"], "score", 0.95, 0.05).filter("n >= 10")
    g = q.join(f.groupBy("stream_id").agg(F.stddev_pop("score").alias("sd")), "stream_id")
    return g.select("stream_id", "n", R6("quantile").alias("tau"), R6(F.greatest("sd", F.lit(1e-3))).alias("margin"))


# The probe of sequences: labels stand for sequences, vec_id for the place in them; weights are fixed by a rule.
_PW = EMB + ", pw AS (SELECT list_transform(range(64), lambda i: cos(i + 1.0)) AS q, list_transform(range(64), lambda i: sin(i + 1.0)) AS w), sv AS (SELECT label, vec_id, list_dot_product(v, q) / 8 * 4 AS s, list_dot_product(v, w) AS val, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos FROM em, pw)"


def _scalars(s: SparkSession, d: str) -> DataFrame:
    """Per row the two numbers the probe needs; windows then run over numbers, never over vectors."""
    v = vectors.doubles(F.col("embedding"))
    q, w = F.expr("transform(sequence(0, 63), i -> cos(i + 1D))"), F.expr("transform(sequence(0, 63), i -> sin(i + 1D))")
    return table(s, d, "embeddings").select("label", "vec_id", (vectors.dot(v, q) / 8 * 4).alias("s"), vectors.dot(v, w).alias("val"))


@core.query(
    "stream27_rolling_probe",
    with_(_PW) + ", p AS (SELECT label, vec_id, pos, sum(exp(s) * val) OVER r / sum(exp(s)) OVER r AS pooled FROM sv WINDOW r AS (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) SELECT label, count(*) FILTER (pos >= 10) AS n_windows, round(max(pooled) FILTER (pos >= 10), 6) AS score, round(max(pooled), 6) AS online_max FROM p GROUP BY label",
)
def rolling_probe(s: SparkSession, d: str) -> DataFrame:
    """Attention over each window of ten, the largest pooled value; offline over whole windows, online from the first (T27, T28)."""
    p = last_rows(_scalars(s, d), ["label"], "vec_id", 10, {"pooled": lambda w: F.sum(F.exp("s") * F.col("val")).over(w) / F.sum(F.exp("s")).over(w)})
    full = F.when(F.col("pos") >= 10, F.col("pooled"))
    return p.groupBy("label").agg(F.count(full).alias("n_windows"), R6(F.max(full)).alias("score"), R6(F.max("pooled")).alias("online_max"))


@core.query(
    "stream29_pooling_baselines",
    with_(_PW) + ", r AS (SELECT label, pos, s, val, avg(val) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m FROM sv) SELECT label, round(max(m) FILTER (pos >= 10), 6) AS rolling_mean, round(avg(val), 6) AS mean_pool, round(sum(exp(s) * val) / sum(exp(s)), 6) AS global_attention FROM r GROUP BY label",
)
def pooling_baselines(s: SparkSession, d: str) -> DataFrame:
    x = last_rows(_scalars(s, d), ["label"], "vec_id", 10, {"m": lambda w: F.avg("val").over(w)})
    return x.groupBy("label").agg(R6(F.max(F.when(F.col("pos") >= 10, F.col("m")))).alias("rolling_mean"), R6(F.avg("val")).alias("mean_pool"), R6(F.sum(F.exp("s") * F.col("val")) / F.sum(F.exp("s"))).alias("global_attention"))


@core.query(
    "stream30_attention_diagnostics",
    with_(_PW) + ", a AS (SELECT label, s, exp(s) / sum(exp(s)) OVER (PARTITION BY label) AS a FROM sv) SELECT label, round(1 / sum(a * a), 6) AS effective_n, round(max(s) - min(s), 6) AS spread, round(max(a) / min(a), 6) AS ratio, 1 / sum(a * a) > 0.95 * count(*) AS degenerate FROM a GROUP BY label",
)
def attention_diagnostics(s: SparkSession, d: str) -> DataFrame:
    g = _scalars(s, d).withColumn("e", F.exp("s")).groupBy("label").agg(F.sum("e").alias("z"), F.sum(F.col("e") * F.col("e")).alias("z2"), F.max("s").alias("hi"), F.min("s").alias("lo"), F.count("*").alias("n"))
    n = F.col("z") * F.col("z") / F.col("z2")
    return g.select("label", R6(n).alias("effective_n"), R6(F.col("hi") - F.col("lo")).alias("spread"), R6(F.exp("hi") / F.exp("lo")).alias("ratio"), (n > 0.95 * F.col("n")).alias("degenerate"))


@core.query("stream31_probe_fit")
def probe_fit(s: SparkSession, d: str) -> DataFrame:
    """Weights of the probe fitted to labels over 4 by gradient descent on the windows that attain the maximum."""
    from tideline.operators.probe import fit_probe

    return fit_probe(table(s, d, "embeddings"))


@core.query(
    "stream_duplicates_and_late",
    "WITH g AS (SELECT stream_id, tick, count(*) AS n FROM frames GROUP BY stream_id, tick) SELECT f.stream_id, (SELECT count(*) FROM g WHERE g.stream_id = f.stream_id AND n > 1) AS n_repeated, count(*) FILTER (arrived_at - ts > INTERVAL 5 SECOND) AS n_late FROM frames f GROUP BY f.stream_id",
)
def duplicates_and_late(s: SparkSession, d: str) -> DataFrame:
    """Per stream the ticks delivered more than once and the rows more than five seconds late."""
    f = table(s, d, "frames").select("stream_id", "tick", "ts", "arrived_at")
    late = (F.unix_micros("arrived_at") - F.unix_micros("ts") > 5_000_000).cast("bigint")
    t = f.groupBy("stream_id", "tick").agg(F.count("*").alias("n"), F.sum(F.coalesce(late, F.lit(0))).alias("l"))
    return t.groupBy("stream_id").agg(F.count(F.when(F.col("n") > 1, 1)).alias("n_repeated"), F.sum("l").alias("n_late"))


@core.query("stream_structured_cusum", _RESET + " SELECT stream_id, count(*) AS n, count(*) FILTER (alarm) AS n_alarms FROM a GROUP BY stream_id")
def structured_cusum(s: SparkSession, d: str) -> DataFrame:
    """The detector as a streaming query over the table, with its state in the state store; rows folded per stream."""
    import uuid

    from tideline.streaming.processors import run_available, stateful
    from tideline.session import shared_dir

    f = frames(s, d, "score", where="score is not null")
    base = f"{shared_dir(s)}/tideline/stream-{uuid.uuid4().hex}"
    f.write.parquet(f"{base}/in")
    stream = s.readStream.schema(f.schema).option("maxFilesPerTrigger", 1000).parquet(f"{base}/in")
    out = stateful(stream, steps.Cusum(), "stream_id", "tick", ["score"], "stat_before_reset double, stat double, alarm boolean")
    run_available(out, f"{base}/out", f"{base}/checkpoint")
    return s.read.parquet(f"{base}/out").filter("not late").groupBy("stream_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("alarm"), 1)).alias("n_alarms"))
