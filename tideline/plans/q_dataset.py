"""Construction of training data out of manifests and streams, and the analyst's budgeted lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions import protocol, vectors
from tideline.operators.ordered import running
from tideline.operators.sampling import take_smallest
from tideline.plans.q_join import _PAIRS, step_pairs, stepped
from tideline.plans.registry import core
from tideline.plans.sqlparts import CLIPS, EMB, FRAMES, STEPS, with_
from tideline.rng import u01, u01_sql
from tideline.session import cut_lineage, table
from tideline.sources.sft import target
from tideline.sources.tables import clips, frames

R6 = lambda c: F.round(c, 6)
EDGE, SEPARATION = 15.0, 8.0

_PLAN = CLIPS + f""", pl AS (SELECT id, media.duration_s AS dur, CAST(2 + floor({u01_sql('n', 'id')} * (least(6, greatest(2, CAST(floor((media.duration_s - 30) / 8) AS BIGINT))) - 1)) AS BIGINT) AS n FROM cl WHERE media.duration_s >= 90),
 us AS (SELECT id, dur, n, list_sort(list_transform(range(n), lambda i: {u01_sql('pos', 'id', 'i')})) AS u FROM pl), cu AS (SELECT id, n, i, 15 + u[i + 1] * (dur - 30 - (n - 1) * 8) + i * 8 AS t_s, CAST(floor({u01_sql('needle', 'id')} * n) AS BIGINT) = i AS needle FROM us, range(6) t(i) WHERE i < n)"""


def splice_plan(s: SparkSession, d: str) -> DataFrame:
    """Cuts of each clip at least SEPARATION apart: sorted uniforms on what is left of the clip, the gaps added back."""
    c = clips(s, d, "media.duration_s").withColumnRenamed("media_duration_s", "dur").filter("dur >= 90")
    most = F.least(F.lit(6), F.greatest(F.lit(2), F.floor((F.col("dur") - 2 * EDGE) / SEPARATION))).cast("bigint")
    c = c.withColumn("n", (2 + F.floor(u01("n", F.col("id")) * (most - 1))).cast("bigint"))
    c = c.withColumn("u", F.array_sort(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), lambda i: u01("pos", F.col("id"), i))))
    x = c.select("id", "dur", "n", F.posexplode("u").alias("i", "x"))
    t = EDGE + F.col("x") * (F.col("dur") - 2 * EDGE - (F.col("n") - 1) * SEPARATION) + F.col("i") * SEPARATION
    return x.select("id", "n", F.col("i").cast("bigint").alias("i"), t.alias("t_s"), (F.floor(u01("needle", F.col("id")) * F.col("n")).cast("bigint") == F.col("i")).alias("needle"))


@core.query("data01_splice_plan", with_(_PLAN) + " SELECT id, n, i, round(t_s, 6) AS t_s, needle FROM cu")
def plan(s: SparkSession, d: str) -> DataFrame:
    return splice_plan(s, d).withColumn("t_s", R6("t_s"))


@core.query(
    "data02_render_timeline",
    with_(CLIPS) + f", cc AS (SELECT id, unnest(splice.cuts) AS c FROM cl WHERE splice IS NOT NULL), cd AS (SELECT id, c.t_s AS t_s, c.kind AS kind, row_number() OVER (PARTITION BY id ORDER BY c.t_s, c.insert_id NULLS FIRST) AS k FROM cc), cl2 AS (SELECT *, 0.6 + 3.4 * {u01_sql('dur', 'id', 'k')} AS dur FROM cd) SELECT id, k, round(t_s + coalesce(sum(dur) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS out_t, CAST(floor((t_s + coalesce(sum(dur) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * 25) AS BIGINT) AS frame, round(dur, 6) AS dur FROM cl2",
)
def timeline(s: SparkSession, d: str) -> DataFrame:
    """Where each insert begins in the output: its cut plus all inserts before it."""
    c = clips(s, d, "splice.cuts").filter("splice_cuts is not null")
    x = c.select("id", F.posexplode(F.array_sort(F.transform("splice_cuts", lambda c: F.struct(c["t_s"].alias("t_s"), c["insert_id"].alias("insert_id"))))).alias("p", "c")).withColumn("k", (F.col("p") + 1).cast("bigint"))
    x = x.withColumn("dur", 0.6 + 3.4 * u01("dur", F.col("id"), F.col("k")))
    before = F.coalesce(F.sum("dur").over(Window.partitionBy("id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    x = x.withColumn("o", F.col("c.t_s") + before)
    return x.select("id", "k", R6("o").alias("out_t"), F.floor(F.col("o") * 25).cast("bigint").alias("frame"), R6("dur").alias("dur"))


_WIN = CLIPS + f""", wc AS (SELECT id, media.duration_s AS dur, label.events AS ev FROM cl WHERE media.duration_s IS NOT NULL AND granularity = 'temporal'),
 we AS (SELECT id, dur, unnest(ev) AS e FROM wc),
 wf AS (SELECT id, 'pos_full' AS kind, greatest(0.0, least(dur, e.t_end_s + 0.5) - 8) AS a, least(dur, e.t_end_s + 0.5) AS b, e.category AS cat FROM we UNION ALL SELECT id, 'pos_partial', greatest(0.0, e.t_start_s + (e.t_end_s - e.t_start_s) * 0.4 - 8), e.t_start_s + (e.t_end_s - e.t_start_s) * 0.4, e.category FROM we),
 gn AS (SELECT id, ev, unnest(range(1, CAST(floor(dur / 8) AS BIGINT) + 1)) AS k FROM wc WHERE dur >= 8),
 g0 AS (SELECT id, ev, k, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY id) AS n FROM gn WHERE len(list_filter(ev, lambda e: e.t_start_s - 8 < k * 8.0 AND k * 8.0 < e.t_end_s + 8)) = 0),
 gf AS (SELECT id, ev, k FROM g0 WHERE n <= 4 OR i IN (CAST(floor((0 + {u01_sql('neg', 'id', '0')}) * n / 4) AS BIGINT), CAST(floor((1 + {u01_sql('neg', 'id', '1')}) * n / 4) AS BIGINT), CAST(floor((2 + {u01_sql('neg', 'id', '2')}) * n / 4) AS BIGINT), CAST(floor((3 + {u01_sql('neg', 'id', '3')}) * n / 4) AS BIGINT))),
 ws AS (SELECT id, kind, a, b, cat FROM wf WHERE b > a UNION ALL SELECT id, CASE WHEN len(ev) = 0 THEN 'neg_cross' ELSE 'neg_same' END, k * 8.0 - 8, k * 8.0, NULL FROM gf)"""


def windows(s: SparkSession, d: str) -> DataFrame:
    """Causal windows of each clip: whole and partial positives, and at most four negatives clear of every event."""
    c = clips(s, d, "media.duration_s", "label.events", "granularity").filter("media_duration_s is not null and granularity = 'temporal'").withColumnsRenamed({"media_duration_s": "dur", "label_events": "ev"})
    e = c.select("id", "dur", F.explode("ev").alias("e"))
    end, cut = F.least("dur", F.col("e.t_end_s") + 0.5), F.col("e.t_start_s") + (F.col("e.t_end_s") - F.col("e.t_start_s")) * 0.4
    pair = lambda kind, b: F.struct(F.lit(kind).alias("kind"), F.greatest(F.lit(0.0), b - 8).alias("a"), b.alias("b"), F.col("e.category").alias("category"))
    pos = e.select("id", F.explode(F.array(pair("pos_full", end), pair("pos_partial", cut))).alias("w")).select("id", "w.*").filter("b > a")
    # The grid stays in the clip's row: of the free places one is drawn in each quarter, before anything is exploded.
    free = F.filter(F.sequence(F.lit(1).cast("bigint"), F.floor(F.col("dur") / 8).cast("bigint")), lambda k: ~F.exists("ev", lambda x: (x["t_start_s"] - 8 < k * 8.0) & (k * 8.0 < x["t_end_s"] + 8)))
    neg = c.filter("dur >= 8").select("id", F.size("ev").alias("ne"), free.alias("free")).withColumn("n", F.size("free")).filter("n > 0")
    drawn = F.array_distinct(F.array(*[F.get("free", F.floor((j + u01("neg", F.col("id"), F.lit(j))) * F.col("n") / 4).cast("int")) for j in range(4)]))
    neg = neg.select("id", "ne", F.explode(F.when(F.col("n") <= 4, F.col("free")).otherwise(drawn)).alias("k"))
    neg = neg.select("id", F.when(F.col("ne") == 0, "neg_cross").otherwise("neg_same").alias("kind"), (F.col("k") * 8.0 - 8).alias("a"), (F.col("k") * 8.0).alias("b"), F.lit(None).cast("string").alias("category"))
    return pos.unionByName(neg)


@core.query("data03_sft_windows", with_(_WIN) + " SELECT id, kind, round(a, 6) AS t_start_s, round(b, 6) AS t_end_s FROM ws")
def sft_windows(s: SparkSession, d: str) -> DataFrame:
    return windows(s, d).select("id", "kind", R6("a").alias("t_start_s"), R6("b").alias("t_end_s"))


# The target mix of the four kinds.
MIX = {"pos_full": 0.25, "pos_partial": 0.25, "neg_same": 0.35, "neg_cross": 0.15}


@core.query("scan09_sft_kind_counts", with_(_WIN) + " SELECT kind, count(*) AS n FROM ws GROUP BY kind")
def sft_kind_counts(s: SparkSession, d: str) -> DataFrame:
    """Counts per kind of what :func:`tideline.sources.sft.write_sft` writes."""
    return windows(s, d).groupBy("kind").agg(F.count("*").alias("n"))


@core.query("scan09_sft_rows", with_(_WIN) + """ SELECT id, round(a, 6) AS t_start_s, round(b, 6) AS t_end_s, kind, CASE kind WHEN 'pos_full' THEN '{"action":"flag","category":"' || cat || '","policy_citation":"SW-' || cat || '"}' WHEN 'pos_partial' THEN '{"action":"hold"}' ELSE '{"action":"clear"}' END AS target FROM ws""")
def sft_rows(s: SparkSession, d: str) -> DataFrame:
    """What each written row asks and how it is answered."""
    return windows(s, d).select("id", R6("a").alias("t_start_s"), R6("b").alias("t_end_s"), "kind", target(F.col("kind"), F.col("category")).alias("target"))


@core.query(
    "data04_mix_resample",
    with_(_WIN) + f""", tm AS (SELECT * FROM (VALUES ('pos_full', 0.25::DOUBLE), ('pos_partial', 0.25), ('neg_same', 0.35), ('neg_cross', 0.15)) t(kind, share)), nk AS (SELECT kind, count(*) AS n FROM ws GROUP BY kind), tt AS (SELECT CAST(floor(min(n / share)) AS BIGINT) AS total FROM tm JOIN nk USING (kind)),
 rk AS (SELECT ws.*, row_number() OVER (PARTITION BY kind ORDER BY {u01_sql('mix', 'id', 'kind', 'CAST(round(a * 1000) AS BIGINT)')}, id || ':' || CAST(CAST(round(a * 1000) AS BIGINT) AS VARCHAR)) AS r FROM ws) SELECT kind, count(*) AS n FROM rk JOIN tm USING (kind), tt WHERE r <= round_even(total * share, 0) GROUP BY kind""",
)
def mix_resample(s: SparkSession, d: str) -> DataFrame:
    """As many of each kind as the scarcest allows, without repeats."""
    w = cut_lineage(windows(s, d)).withColumn("ms", F.round(F.col("a") * 1000).cast("bigint")).withColumn("tie", F.concat_ws(":", "id", F.col("ms").cast("string")))
    n = {r.kind: r["count"] for r in w.groupBy("kind").count().collect()}
    if any(not n.get(k) for k in MIX):
        return w.groupBy("kind").agg(F.count("*").alias("n"))
    total = int(min(n[k] / t for k, t in MIX.items()))
    want = F.create_map(*[x for k, t in MIX.items() for x in (F.lit(k), F.lit(round(total * t)))])
    got = take_smallest(w.withColumn("want", want[F.col("kind")]), ["kind"], u01("mix", F.col("id"), F.col("kind"), F.col("ms")), "want", "tie")
    return got.groupBy("kind").agg(F.count("*").alias("n"))


@core.query("data07_hindsight_relabel", with_(STEPS) + ", nu AS (SELECT stream_id, any_value(nu_s) AS nu FROM fr GROUP BY stream_id) SELECT stream_id, tick, action, CASE WHEN nu IS NOT NULL AND t_s >= nu THEN 'flag' ELSE 'clear' END AS target FROM st JOIN nu USING (stream_id) WHERE action IN ('flag', 'uncovered', 'invalid')")
def hindsight_relabel(s: SparkSession, d: str) -> DataFrame:
    f = stepped(s, d, "t_s").filter(F.col("s.action").isin("flag", "uncovered", "invalid"))
    nu = frames(s, d, "nu_s").groupBy("stream_id").agg(F.first("nu_s", ignorenulls=True).alias("nu"))
    return f.join(nu, "stream_id").select("stream_id", "tick", F.col("s.action").alias("action"), F.when(F.col("nu").isNotNull() & (F.col("t_s") >= F.col("nu")), "flag").otherwise("clear").alias("target"))


_REWARD = (
    FRAMES
    + ", nu AS (SELECT stream_id, any_value(nu_s) AS nu FROM fr GROUP BY stream_id), oc AS (SELECT stream_id, any_value(category) AS cat FROM (SELECT DISTINCT * FROM stream_outcomes) GROUP BY stream_id), cv AS (SELECT DISTINCT category AS cat, true AS has FROM policy_clauses WHERE status IN ('active', 'deprecated'))"
    + ", sp AS (SELECT stream_id, tick, t_s, floor(length(action_raw) / 2.0) AS tok, CASE WHEN json_valid(action_raw) AND json_extract_string(action_raw, '$.action') IN ('hold', 'flag', 'clear', 'uncovered') THEN json_extract_string(action_raw, '$.action') END AS a, CASE WHEN json_valid(action_raw) THEN json_extract_string(action_raw, '$.category') END AS c, CASE WHEN json_valid(action_raw) THEN json_extract_string(action_raw, '$.policy_citation') END AS p FROM fr WHERE action_raw IS NOT NULL)"
    + ", ep AS (SELECT sp.*, nu, oc.cat IS NULL OR coalesce(cv.has, false) AS covered, a = 'flag' AND nu IS NOT NULL AND t_s >= nu AND (oc.cat IS NULL OR c = oc.cat) AS good, CASE WHEN a IS NULL THEN 'format' WHEN a = 'flag' AND coalesce(p, '') = '' THEN 'citation' END AS void FROM sp JOIN nu USING (stream_id) LEFT JOIN oc USING (stream_id) LEFT JOIN cv ON cv.cat = oc.cat)"
    + ", eg AS (SELECT stream_id, any_value(nu) AS nu, any_value(covered) AS covered, sum(tok) AS tok, arg_min(void, tick) FILTER (void IS NOT NULL) AS gate, count(*) FILTER (a = 'flag') AS nf, count(*) FILTER (good) > 0 AS hit, arg_min(t_s, tick) FILTER (good) AS th, count(*) FILTER (a = 'uncovered') AS nun FROM ep GROUP BY stream_id)"
    + ", er AS (SELECT *, CASE WHEN nu IS NULL THEN -0.3 * nun WHEN covered THEN -0.4 * nun WHEN nun > 0 THEN 0.6 ELSE 0 END AS r_unc, CASE WHEN nu IS NOT NULL AND NOT covered THEN nun ELSE 0 END AS n_right FROM eg)"
)


@core.query(
    "data09_trajectory_reward",
    with_(_REWARD)
    + " SELECT stream_id, gate, gate IS NULL AND hit AS hit, round(CASE WHEN gate IS NULL AND hit THEN th - nu END, 6) AS delay_s, CASE WHEN gate IS NOT NULL THEN 0 WHEN hit THEN nf - 1 ELSE nf END AS n_false_alarms, CAST(tok AS BIGINT) AS tokens, CASE WHEN gate IS NULL THEN n_right ELSE 0 END AS n_uncovered_right, CASE WHEN gate IS NULL THEN nun - n_right ELSE 0 END AS n_uncovered_wrong,"
    + " round(CASE WHEN gate IS NOT NULL THEN 0 ELSE CASE WHEN hit THEN 1 - 0.5 * least((th - nu) / 2, 20) / 20 WHEN nu IS NOT NULL AND NOT (NOT covered AND n_right > 0) THEN -0.5 ELSE 0 END - 0.3 * CASE WHEN hit THEN nf - 1 ELSE nf END - 0.05 * tok / 2000 + r_unc END, 6) AS reward FROM er",
)
def trajectory_reward(s: SparkSession, d: str) -> DataFrame:
    """Reward of each stream's answers: the first right flag counts with its delay, all others as false alarms; tokens cost.

    A flag without citation voids it, and so does an answer that does not parse strictly (``gate``: which came first). "uncovered" is
    right once where the policy has no clause for the stream's category, lazy where it has, and a false alarm on a safe stream; a
    gap rightly named is no miss. Answers carry no token counts, so these are half their characters (row P29)."""
    f = frames(s, d, "t_s", "action_raw", "nu_s")
    nu = f.groupBy("stream_id").agg(F.first("nu_s", ignorenulls=True).alias("nu"))
    covers = table(s, d, "policy_clauses").filter(F.col("status").isin("active", "deprecated")).select(F.col("category").alias("cat"), F.lit(True).alias("has")).distinct()
    cat = table(s, d, "stream_outcomes").groupBy("stream_id").agg(F.first("category", ignorenulls=True).alias("cat")).join(covers, "cat", "left")
    x = f.filter("action_raw is not null").withColumn("p", protocol.parsed(F.col("action_raw"))).withColumn("a", protocol.strict_action(F.col("action_raw")))
    x = x.join(nu, "stream_id").join(cat, "stream_id", "left")
    flag = F.col("a") == "flag"
    good = flag & F.col("nu").isNotNull() & (F.col("t_s") >= F.col("nu")) & (F.col("cat").isNull() | F.coalesce(F.col("p.category") == F.col("cat"), F.lit(False)))
    n = lambda c: F.count(F.when(c, 1))
    void = F.when(F.col("a").isNull(), "format").when(flag & (F.coalesce("p.policy_citation", F.lit("")) == ""), "citation")
    x = x.withColumn("void", void).withColumn("covered", F.col("cat").isNull() | F.coalesce("has", F.lit(False)))
    g = x.groupBy("stream_id").agg(F.first("nu").alias("nu"), F.first("covered").alias("covered"), F.sum(F.floor(F.length("action_raw") / 2.0)).cast("bigint").alias("tok"), F.min_by("void", F.when(F.col("void").isNotNull(), F.col("tick"))).alias("gate"), n(flag).alias("nf"), n(good).alias("ng"), F.min_by("t_s", F.when(good, F.col("tick"))).alias("th"), n(F.col("a") == "uncovered").alias("nun"))
    ok, hit, safe = F.col("gate").isNull(), F.col("ng") > 0, F.col("nu").isNull()
    right = F.when(~safe & ~F.col("covered"), F.col("nun")).otherwise(0)
    uncovered = F.when(safe, -0.3 * F.col("nun")).when(F.col("covered"), -0.4 * F.col("nun")).when(F.col("nun") > 0, 0.6).otherwise(0.0)
    fa = F.when(hit, F.col("nf") - 1).otherwise(F.col("nf"))
    base = F.when(hit, 1 - 0.5 * F.least((F.col("th") - F.col("nu")) / 2, F.lit(20.0)) / 20).when(~safe & ~(right > 0), -0.5).otherwise(0.0)
    total = base - 0.3 * fa - 0.05 * F.col("tok") / 2000 + uncovered
    return g.select("stream_id", "gate", (ok & hit).alias("hit"), R6(F.when(ok & hit, F.col("th") - F.col("nu"))).alias("delay_s"), F.when(ok, fa).otherwise(0).alias("n_false_alarms"), F.col("tok").alias("tokens"), F.when(ok, right).otherwise(0).alias("n_uncovered_right"), F.when(ok, F.col("nun") - right).otherwise(0).alias("n_uncovered_wrong"), R6(F.when(ok, total).otherwise(0.0)).alias("reward"))


# The clause a right flag cites: the first enforced one of the stream's category.
_TARGETS = "tg AS (SELECT stream_id, min(p.id) AS target FROM (SELECT stream_id, any_value(category) AS category FROM (SELECT DISTINCT * FROM stream_outcomes) GROUP BY stream_id) o JOIN policy_clauses p ON p.category = o.category AND p.status IN ('active', 'deprecated') GROUP BY stream_id)"
_CF = "CASE WHEN covering = 'invalid' OR not_covering = 'invalid' THEN 'invalid' WHEN covering = 'flag' AND not_covering <> 'flag' THEN CASE WHEN target IS NULL OR citation = target THEN 'consistent' ELSE 'wrong_citation' END WHEN covering <> 'flag' AND not_covering = 'flag' THEN 'reversed' ELSE 'insensitive' END"


@core.query("data11_counterfactual_reward", with_(_PAIRS, _TARGETS) + f" SELECT verdict, count(*) AS n, CAST(round(sum(CASE verdict WHEN 'consistent' THEN 0.5 WHEN 'reversed' THEN -0.6 WHEN 'insensitive' THEN -0.4 ELSE 0 END), 6) AS DOUBLE) AS reward FROM (SELECT {_CF} AS verdict FROM pr LEFT JOIN tg USING (stream_id)) GROUP BY verdict")
def counterfactual_reward(s: SparkSession, d: str) -> DataFrame:
    """Answers in pairs, judged by direction: only a flag that turns into none, citing the target clause, is consistent."""
    clause = table(s, d, "policy_clauses").filter(F.col("status").isin("active", "deprecated")).groupBy("category").agg(F.min("id").alias("target"))
    target = table(s, d, "stream_outcomes").groupBy("stream_id").agg(F.first("category", ignorenulls=True).alias("category")).join(clause, "category").select("stream_id", "target")
    a, b = F.col("covering"), F.col("not_covering")
    right = F.col("target").isNull() | F.coalesce(F.col("citation") == F.col("target"), F.lit(False))
    v = F.when((a == "invalid") | (b == "invalid"), "invalid").when((a == "flag") & (b != "flag"), F.when(right, "consistent").otherwise("wrong_citation")).when((a != "flag") & (b == "flag"), "reversed").otherwise("insensitive")
    r = F.when(F.col("verdict") == "consistent", 0.5).when(F.col("verdict") == "reversed", -0.6).when(F.col("verdict") == "insensitive", -0.4).otherwise(0.0)
    return step_pairs(s, d).join(target, "stream_id", "left").select(v.alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"), R6(F.sum(r)).alias("reward"))


@core.query("data15_induction_rounds")
def induction_rounds(s: SparkSession, d: str) -> DataFrame:
    """Propose, score, revise: word lists grow by the word that helps most; stops when the gain is .01 or less."""
    from tideline.operators.induction import induce

    i = table(s, d, "eval_items").select("item_id", "text", "label").filter("label is not null and text is not null")
    return induce(i, "item_id", "text", "label")


@core.query("data17_clause_lifecycle", "SELECT category, id, status, CAST(version AS BIGINT) AS version, supersedes, row_number() OVER (PARTITION BY category ORDER BY seq DESC) = 1 AS latest FROM policy_clauses")
def clause_lifecycle(s: SparkSession, d: str) -> DataFrame:
    """The append-only table of clauses, with the newest of each category marked."""
    p = table(s, d, "policy_clauses")
    return p.select("category", "id", "status", F.col("version").cast("bigint").alias("version"), "supersedes", (F.row_number().over(Window.partitionBy("category").orderBy(F.desc("seq"))) == 1).alias("latest"))


# -- budgeted lookups


@core.query("tool01_budget", with_(FRAMES) + ", c AS (SELECT stream_id, tick, sum(100 + tick % 50) OVER (PARTITION BY stream_id ORDER BY tick) AS tokens, row_number() OVER (PARTITION BY stream_id ORDER BY tick) AS calls FROM fr) SELECT stream_id, count(*) AS n_calls, count(*) FILTER (tokens <= 4000 AND calls <= 40) AS n_ok FROM c GROUP BY stream_id")
def tool_budget(s: SparkSession, d: str) -> DataFrame:
    """Calls within budget: charges persist, so running sums decide."""
    f = frames(s, d)
    f = running(f, ["stream_id"], "tick", 100 + F.col("tick") % 50, "tokens")
    f = running(f, ["stream_id"], "tick", F.lit(1), "calls")
    return f.groupBy("stream_id").agg(F.count("*").alias("n_calls"), F.count(F.when((F.col("tokens") <= 4000) & (F.col("calls") <= 40), 1)).alias("n_ok"))


@core.query("tool04_diff", with_(EMB) + " SELECT a.vec_id, round(list_avg(list_transform(range(1, 65), lambda i: abs(a.v[i] - b.v[i]))), 6) AS mean_diff, round(list_max(list_transform(range(1, 65), lambda i: abs(a.v[i] - b.v[i]))), 6) AS max_diff, round(len(list_filter(range(1, 65), lambda i: abs(a.v[i] - b.v[i]) > 0.1)) / 64, 6) AS changed FROM em a JOIN em b ON b.vec_id = a.vec_id - 1")
def diff(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings").select("vec_id", vectors.doubles(F.col("embedding")).alias("v"))
    x = e.join(e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("v").alias("w")), "vec_id").select("vec_id", F.zip_with("v", "w", lambda a, b: F.abs(a - b)).alias("z"))
    return x.select("vec_id", R6(F.aggregate("z", F.lit(0.0), lambda a, b: a + b) / F.size("z")).alias("mean_diff"), R6(F.array_max("z")).alias("max_diff"), R6(F.size(F.filter("z", lambda a: a > 0.1)) / F.size("z")).alias("changed"))


@core.query("tool06_policy_lookup", "SELECT id, category, seq FROM policy_clauses WHERE status IN ('active', 'deprecated') AND (contains(lower(title), 'lad') OR contains(lower(text), 'lad') OR contains(lower(id), 'lad')) ORDER BY seq LIMIT 5")
def policy_lookup(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "policy_clauses").filter(F.col("status").isin("active", "deprecated"))
    hit = F.lit(False)
    for c in ("title", "text", "id"):
        hit = hit | F.lower(F.col(c)).contains("lad")
    return p.filter(hit).orderBy("seq").limit(5).select("id", "category", "seq")


@core.query("tool07_case_lookup", with_(EMB) + ", ex AS (SELECT vec_id, v FROM em WHERE label = 3), q AS (SELECT vec_id AS query_id, v FROM em WHERE vec_id % 50 = 0), j AS (SELECT query_id, ex.vec_id, round(list_dot_product(q.v, ex.v), 6) AS cos, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(q.v, ex.v), 6) DESC, ex.vec_id) AS r FROM q JOIN ex ON ex.vec_id <> query_id) SELECT query_id, vec_id, cos FROM j WHERE r <= 2")
def case_lookup(s: SparkSession, d: str) -> DataFrame:
    from tideline.operators.retrieval import top_similar

    e = table(s, d, "embeddings").select("vec_id", "embedding", "label")
    return top_similar(e.filter("vec_id % 50 = 0"), e.filter("label = 3"), "vec_id", "embedding", 2)
