"""Replayed streams, policies as data, costs: what training sequences and ablations are made of."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.operators import policies, simulate
from tideline.operators.costs import CostModel
from tideline.plans.q_dataset import MIX, _WIN, windows
from tideline.plans.q_join import _GAPS, uncovered
from tideline.plans.q_scalar import _ROUTE, routed
from tideline.plans.registry import core
from tideline.plans.sqlparts import FRAMES, STEPS, with_
from tideline.rng import u01, u01_many, u01_sql
from tideline.session import cut_lineage, table
from tideline.sources.tables import frames

R6 = lambda c: F.round(c, 6)

_SIM = (
    FRAMES
    + ", al AS (SELECT stream_id, min(tau_s) AS alarm FROM stream_outcomes GROUP BY stream_id), sp AS (SELECT fr.stream_id, max(t_s) AS duration, min(nu_s) AS nu, any_value(alarm) AS alarm FROM fr LEFT JOIN al USING (stream_id) GROUP BY fr.stream_id)"
    + f", a0 AS (SELECT sp.*, i, greatest(0.001, 2.0 + 0.4 * (2 * {u01_sql('gap', 'stream_id', 'i')} - 1)) AS g FROM sp, range(100000) r(i) WHERE i <= ceil(duration / 1.6) + 1)"
    + ", a1 AS (SELECT *, coalesce(sum(g) OVER (PARTITION BY stream_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM a0), a2 AS (SELECT * FROM a1 WHERE t < duration), tn AS (SELECT stream_id, min(i) AS m, min(t) AS tm FROM a2 WHERE t >= alarm GROUP BY stream_id)"
    + f", b0 AS (SELECT sp.*, m, tm, k, greatest(0.001, 0.25 + 0.4 * (2 * {u01_sql('burst', 'stream_id', 'k')} - 1)) AS g FROM sp JOIN tn USING (stream_id), range(1000000) r(k) WHERE k <= ceil((duration - tm) * 10) + 100), b1 AS (SELECT *, tm + sum(g) OVER (PARTITION BY stream_id ORDER BY k) AS t FROM b0)"
    + ", sc AS (SELECT stream_id, nu, alarm, i AS x, t FROM a2 LEFT JOIN tn USING (stream_id) WHERE m IS NULL OR i <= m UNION ALL SELECT stream_id, nu, alarm, m + k + 1, t FROM b1 WHERE t < duration)"
    + f", ke AS (SELECT *, coalesce(t >= alarm, false) AS alarmed FROM sc WHERE {u01_sql('skip', 'stream_id', 'x')} >= 0.05), es AS (SELECT *, alarmed OR {u01_sql('up', 'stream_id', 'x')} < 0.05 AS escalated, count(*) OVER (PARTITION BY stream_id ORDER BY t RANGE BETWEEN 16 PRECEDING AND CURRENT ROW) AS held, coalesce(t >= nu AND t <= nu + 10, false) AS in_event FROM ke)"
    + ", sm AS (SELECT *, coalesce(lag(held) OVER (PARTITION BY stream_id ORDER BY x), 0) + 1 - held AS evicted, CASE WHEN alarmed THEN least(2, held) WHEN escalated THEN 1 ELSE 0 END AS window_frames, CASE WHEN NOT in_event THEN 'clear' WHEN (t - nu) / 10 < 0.4 THEN 'hold' ELSE 'flag' END AS label FROM es)"
)


def _states(name: str, action: str) -> str:
    p = "PARTITION BY stream_id ORDER BY x"
    return (
        f"{name}0 AS (SELECT *, CASE WHEN escalated THEN {action} ELSE 'hold' END AS action FROM sm), {name}1 AS (SELECT *, last_value(CASE WHEN action IN ('flag', 'clear') THEN action END IGNORE NULLS) OVER ({p}) AS la FROM {name}0), {name}2 AS (SELECT *, coalesce(la = 'flag', false) AS event_open, lag(la) OVER ({p}) AS lb FROM {name}1), "
        f"{name}3 AS (SELECT *, sum(CASE WHEN action = 'clear' AND lb = 'flag' THEN 1 ELSE 0 END) OVER ({p}) AS ev FROM {name}2), {name} AS (SELECT *, sum(CASE WHEN action = 'flag' THEN 40 ELSE 0 END) OVER (PARTITION BY stream_id, ev ORDER BY x) AS event_tokens, sum(CAST(event_open AS INT)) OVER (PARTITION BY stream_id, ev ORDER BY x) AS n_since_open FROM {name}3)"
    )


# A policy that is right four times in five and else answers the next action in turn.
_ERR = f"CASE WHEN {u01_sql('act', 'stream_id', 'x')} < 0.8 THEN label WHEN label = 'clear' THEN 'flag' WHEN label = 'flag' THEN 'hold' ELSE 'clear' END"


def _streams(s: SparkSession, d: str) -> DataFrame:
    """A repeated delivery changes neither the largest time nor the smallest, so rows need not meet by tick."""
    o = table(s, d, "stream_outcomes").groupBy("stream_id").agg(F.min("tau_s").alias("alarm"))
    f = table(s, d, "frames").groupBy("stream_id").agg(F.max("t_s").alias("duration"), F.min("nu_s").alias("nu"))
    return f.join(o, "stream_id", "left")


def _erring(x: simulate.Ticks) -> np.ndarray:
    """As _ERR: right four times in five, else the next action in turn (clear, flag, hold)."""
    (u,) = u01_many(["act"], x.stream_id, x.frame_idx)
    return np.where(u < 0.8, x.target, (x.target + 2) % 3)


def _walks(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """The policy's own walk (ro) and the one forced to the targets (tf), side by side, where ``columns`` ask for them."""
    all_ = {"ro": _erring, "tf": simulate.targets}
    return simulate.simulate(_streams(s, d), columns=columns, policies={k: p for k, p in all_.items() if any(c.startswith(k + ".") for c in columns)})


@core.query("data05_stream_simulator", with_(_SIM) + " SELECT stream_id, x AS frame_idx, round(t, 4) AS t_s, alarmed, escalated, evicted, window_frames, in_event, label FROM sm")
def stream_simulator(s: SparkSession, d: str) -> DataFrame:
    """Each stream replayed: jittered samples, dense after the alarm, buffered for 16 seconds, with the target action."""
    return simulate.simulate(_streams(s, d)).select("stream_id", "frame_idx", F.round("t", 4).alias("t_s"), "alarmed", "escalated", "evicted", "window_frames", "in_event", "label")


@core.query("data06_rollout", with_(_SIM, _states("ro", _ERR)) + " SELECT stream_id, x AS frame_idx, action, event_open, CAST(event_tokens AS BIGINT) AS event_tokens, CAST(n_since_open AS BIGINT) AS n_since_open FROM ro")
def rollout(s: SparkSession, d: str) -> DataFrame:
    """The state a policy walks into by its own actions."""
    out = ("action", "event_open", "event_tokens", "n_since_open")
    return _walks(s, d, "frame_idx", *[f"ro.{c}" for c in out]).select("stream_id", "frame_idx", *[F.col(f"ro_{c}").alias(c) for c in out])


@core.query("data07_rollout_relabel", with_(_SIM, _states("ro", _ERR)) + " SELECT action, event_open, label AS target, count(*) AS n FROM ro WHERE escalated GROUP BY ALL")
def rollout_relabel(s: SparkSession, d: str) -> DataFrame:
    """States the policy visited with what should have been done there, counted."""
    w = _walks(s, d, "escalated", "label", "ro.action", "ro.event_open").filter("escalated")
    return w.groupBy(F.col("ro_action").alias("action"), F.col("ro_event_open").alias("event_open"), F.col("label").alias("target")).agg(F.count("*").alias("n"))


@core.query("data08_simulate_many", with_(_SIM) + ", gp AS (SELECT *, t - lag(t) OVER (PARTITION BY stream_id ORDER BY x) AS gap FROM sm) SELECT label, count(*) AS n_ticks, count(*) FILTER (escalated) AS n_escalated, CAST(sum(evicted) AS BIGINT) AS evictions, max(window_frames) AS window_max, round(avg(gap), 5) AS gap_mean FROM gp GROUP BY label")
def simulate_many(s: SparkSession, d: str) -> DataFrame:
    """All streams replayed and counted by target: positives come from many streams, not from repeats of one (rows D8 and A27)."""
    g = simulate.simulate(_streams(s, d), columns=("label", "escalated", "evicted", "window_frames", "gap"))
    return g.groupBy("label").agg(F.count("*").alias("n_ticks"), F.count_if("escalated").alias("n_escalated"), F.sum("evicted").alias("evictions"), F.max("window_frames").alias("window_max"), F.round(F.avg("gap"), 5).alias("gap_mean"))


_SHIFT = "SELECT stream_id, avg(CAST(event_open AS INT)) AS o, avg(event_tokens) AS k, avg(n_since_open) AS s FROM {} GROUP BY stream_id"


@core.query("join09_teacher_forced", with_(_SIM, _states("ro", _ERR), _states("tf", "label")) + " SELECT ro.stream_id, count(*) AS n, count(*) FILTER (ro.event_open <> tf.event_open) AS n_mismatch FROM ro JOIN tf USING (stream_id, x) GROUP BY ro.stream_id")
def teacher_forced(s: SparkSession, d: str) -> DataFrame:
    """The two walks side by side, tick by tick."""
    w = _walks(s, d, "ro.event_open", "tf.event_open").filter("stream_id is not null")
    return w.groupBy("stream_id").agg(F.count("*").alias("n"), F.count_if(F.col("ro_event_open") != F.col("tf_event_open")).alias("n_mismatch"))


@core.query(
    "agg28_state_shift",
    with_(_SIM, _states("ro", _ERR), _states("tf", "label"), f"ra AS ({_SHIFT.format('ro')})", f"ta AS ({_SHIFT.format('tf')})", "mm AS (SELECT stream_id, avg(CAST(ro.event_open <> tf.event_open AS INT)) AS mismatch FROM ro JOIN tf USING (stream_id, x) GROUP BY stream_id)")
    + " SELECT stream_id, round(0.5 * (" + " + ".join(f"abs(ta.{c} - ra.{c}) / greatest(abs(ta.{c}), abs(ra.{c}), 1e-9)" for c in "oks") + ") / 3, 6) AS shift, round(mismatch, 6) AS mismatch FROM ra JOIN ta USING (stream_id) JOIN mm USING (stream_id)",
)
def state_shift(s: SparkSession, d: str) -> DataFrame:
    """How far the states of a policy's own walk are from those it is trained on."""
    w = _walks(s, d, *[f"{k}.{c}" for k in ("ro", "tf") for c in ("event_open", "event_tokens", "n_since_open")]).filter("stream_id is not null")
    means = [F.avg(F.col(f"{k}_{c}").cast("bigint")).alias(k + a) for k in ("ro", "tf") for c, a in (("event_open", "o"), ("event_tokens", "k"), ("n_since_open", "s"))]
    rel = lambda c: F.abs(F.col("tf" + c) - F.col("ro" + c)) / F.greatest(F.abs("tf" + c), F.abs("ro" + c), F.lit(1e-9))
    j = w.groupBy("stream_id").agg(*means, F.avg((F.col("ro_event_open") != F.col("tf_event_open")).cast("int")).alias("m"))
    return j.select("stream_id", R6(0.5 * (rel("o") + rel("k") + rel("s")) / 3).alias("shift"), R6("m").alias("mismatch"))


# -- policies

_ID = "chr(CAST(65 + h % 26 AS INT)) || CAST(1 + h % 9 AS VARCHAR) || '_' || translate(substr(md5(concat_ws(':', 'id', CAST(doc_id AS VARCHAR), old)), 7, 6), '0123456789', 'ghijklmnop')"
_AUG = f"""sa AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN 'C' || (1 + doc_id % 6) END AS t FROM documents), cl AS (SELECT id, split_part(category, '_', 1) AS c, seq FROM policy_clauses WHERE status = 'active'),
 s1 AS (SELECT *, coalesce(t IS NOT NULL AND {u01_sql('mm', 'doc_id')} < 0.25, false) AS is_mismatch FROM sa),
 mu AS (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS f FROM s1 JOIN cl ON c = t WHERE NOT is_mismatch), mc AS (SELECT doc_id, count(*) AS n FROM mu GROUP BY doc_id),
 re AS (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY {u01_sql('sub', 'doc_id', 'id')}, id) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM s1, cl WHERE t IS NULL OR c <> t),
 rc AS (SELECT s1.doc_id, coalesce(any_value(re.n), 0) AS n, greatest(least(2 - coalesce(any_value(mc.n), 0), coalesce(any_value(re.n), 0)), 0) AS low FROM s1 LEFT JOIN re USING (doc_id) LEFT JOIN mc USING (doc_id) GROUP BY s1.doc_id),
 kk AS (SELECT doc_id, low + floor({u01_sql('size', 'doc_id')} * (n - low + 1)) AS k FROM rc),
 nv AS (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY {u01_sql('novel', 'doc_id', 'id')}, id) AS r FROM s1, (SELECT unnest({list(policies.NOVEL)}) AS id)),
 ol AS (SELECT doc_id, id AS old, f FROM mu UNION ALL SELECT doc_id, id, NULL FROM re JOIN kk USING (doc_id) WHERE r <= k UNION ALL SELECT doc_id, id, NULL FROM nv WHERE r = 1),
 ni AS (SELECT doc_id, f, {_ID} AS id FROM (SELECT *, CAST(concat('0x', substr(md5(concat_ws(':', 'id', CAST(doc_id AS VARCHAR), old)), 1, 6)) AS BIGINT) AS h FROM ol)),
 al AS (SELECT doc_id, id FROM ni UNION ALL SELECT doc_id, '{policies.SAFE_EXIT}' FROM s1)"""


def _augmented(s: SparkSession, d: str) -> DataFrame:
    clauses = [(r.id, r.category.split("_")[0]) for r in table(s, d, "policy_clauses").filter("status = 'active'").select("id", "category").orderBy("seq").collect()]  # a policy is a document
    x = table(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("C"), (1 + F.col("doc_id") % 6).cast("string"))).alias("t"))
    return policies.augment(x, clauses, "doc_id", "t")


@core.query("data13_policy_augmentation", f"WITH {_AUG} SELECT s1.doc_id, any_value(is_mismatch) AS is_mismatch, any_value(ta.id) AS target_clause_id, string_agg(al.id, ',' ORDER BY {u01_sql('sh', 's1.doc_id', 'al.id')}, al.id) AS clauses FROM s1 JOIN al USING (doc_id) LEFT JOIN (SELECT doc_id, id FROM ni WHERE f = 1) ta USING (doc_id) GROUP BY s1.doc_id")
def policy_augmentation(s: SparkSession, d: str) -> DataFrame:
    """A policy of its own per sample: a subset with new ids and a clause nobody knows; a quarter lacks the clause it needs."""
    return _augmented(s, d).select("doc_id", "is_mismatch", "target_clause_id", F.array_join("ids", ",").alias("clauses"))


@core.query("agg29_augmentation_stats", f"WITH {_AUG}, sz AS (SELECT doc_id, count(*) AS n, bool_or(id = '{policies.SAFE_EXIT}') AS exit FROM al GROUP BY doc_id) SELECT count(*) AS n, round(avg(CAST(is_mismatch AS INT)), 6) AS mismatch_rate, round((SELECT count(DISTINCT id) / count(*) FROM ni), 6) AS unique_id_ratio, min(sz.n) AS clauses_min, max(sz.n) AS clauses_max, bool_and(exit) AS has_safe_exit FROM s1 JOIN sz USING (doc_id)")
def augmentation_stats(s: SparkSession, d: str) -> DataFrame:
    """Whether the perturbation took: ids that are nearly all different, policies of many sizes, the exit always there."""
    a = cut_lineage(_augmented(s, d))
    ids = a.select(F.explode(F.array_remove("ids", policies.SAFE_EXIT)).alias("id")).groupBy("id").agg(F.count("*").alias("c")).agg((F.count("*") / F.sum("c")).alias("u"))
    g = a.agg(F.count("*").alias("n"), R6(F.avg(F.col("is_mismatch").cast("int"))).alias("mismatch_rate"), F.min(F.size("ids")).cast("bigint").alias("clauses_min"), F.max(F.size("ids")).cast("bigint").alias("clauses_max"), F.bool_and(F.array_contains("ids", policies.SAFE_EXIT)).alias("has_safe_exit"))
    return g.crossJoin(F.broadcast(ids)).select("n", "mismatch_rate", R6("u").alias("unique_id_ratio"), "clauses_min", "clauses_max", "has_safe_exit")  # one row each


@core.query("agg30_mix_report", with_(_WIN) + ", g AS (SELECT kind, count(*) AS n FROM ws GROUP BY kind), tm AS (SELECT * FROM (VALUES ('pos_full', 0.25::DOUBLE), ('pos_partial', 0.25), ('neg_same', 0.35), ('neg_cross', 0.15)) t(kind, target)) SELECT kind, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT sum(n) FROM g), 6) AS share, target, abs(coalesce(n, 0) / (SELECT sum(n) FROM g) - target) >= 0.12 AS off_target FROM tm LEFT JOIN g USING (kind)")
def mix_report(s: SparkSession, d: str) -> DataFrame:
    """Kinds of windows against the target mix."""
    t = s.createDataFrame(list(MIX.items()), "kind string, target double")
    g = t.join(windows(s, d).groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").fillna(0, ["n"])
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))  # a row per kind
    return g.select("kind", "n", R6(share).alias("share"), "target", (F.abs(share - F.col("target")) >= 0.12).alias("off_target"))


_ZOO = """en AS (SELECT *, split_part(category, '_', 1) AS src FROM policy_clauses WHERE status IN ('active', 'deprecated')), so AS (SELECT *, dense_rank() OVER (ORDER BY src) AS q, row_number() OVER (PARTITION BY src ORDER BY seq) AS k FROM en),
 ar AS (SELECT 'few_one' AS arm, q, k, 0 AS v, title, text FROM so WHERE q = 1 UNION ALL SELECT 'many_one', q, k, v, title, text || ' (variant ' || v || ')' FROM so, range(4) t(v) WHERE q = 1 UNION ALL SELECT 'few_many', q, k, 0, title, text FROM so WHERE q <= 2 UNION ALL SELECT 'many_many', q, k, 0, title, text FROM so),
 zi AS (SELECT *, CASE (q - 1) % 4 WHEN 0 THEN 'C' || k || '_' || substr(regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), 1, 10) WHEN 1 THEN 'SEC-' || k || '.' || (1 + k % 4) WHEN 2 THEN CAST(k AS VARCHAR) ELSE substr(regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), 1, 10) END || CASE WHEN arm = 'many_one' THEN '_' || v ELSE '' END AS id FROM ar)"""


@core.query("data14_policy_zoo", f"WITH {_ZOO} SELECT arm, count(DISTINCT q) AS n_sources, count(*) AS n_clauses, count(DISTINCT id) AS n_ids, CAST(floor((sum(length('id=' || id || ' | ' || title || ': ' || text)) + count(*) - 1) / 2.0) AS BIGINT) AS tokens FROM zi GROUP BY arm")
def policy_zoo(s: SparkSession, d: str) -> DataFrame:
    """Four arms that part the number of clauses from the number of their sources (here categories); ids in the style of each source, and the
    tokens that each arm's policy takes."""
    e = table(s, d, "policy_clauses").filter(F.col("status").isin("active", "deprecated")).withColumn("src", F.split_part("category", F.lit("_"), F.lit(1)))
    e = e.withColumn("q", F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy("src"))).withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy("seq")))  # a policy is a document
    arm = lambda name, v=None: F.struct(F.lit(name).alias("arm"), (F.lit("") if v is None else F.lit(f"_{v}")).alias("v"), (F.col("text") if v is None else F.concat("text", F.lit(f" (variant {v})"))).alias("text"))
    one, two = F.col("q") == 1, F.col("q") <= 2
    arms = F.filter(F.array(F.when(one, arm("few_one")), *[F.when(one, arm("many_one", v)) for v in range(4)], F.when(two, arm("few_many")), arm("many_many")), lambda x: x.isNotNull())
    x = e.select("q", "k", "title", F.explode(arms).alias("a")).select("q", "k", "title", "a.*")
    slug = F.substring(F.regexp_replace(F.lower("title"), "[^a-z0-9]", ""), 1, 10)
    n = F.col("k").cast("string")
    forms = {"Cn_slug": F.concat(F.lit("C"), n, F.lit("_"), slug), "SEC-n.m": F.concat(F.lit("SEC-"), n, F.lit("."), (1 + F.col("k") % 4).cast("string")), "n": n, "slug": slug}
    style = F.element_at(F.array(*[forms[f] for f in policies.STYLES]), ((F.col("q") - 1) % 4 + 1).cast("int"))
    x = x.withColumn("id", F.concat(style, "v"))
    line = F.length(F.concat(F.lit("id="), "id", F.lit(" | "), "title", F.lit(": "), "text"))
    return x.groupBy("arm").agg(F.count_distinct("q").alias("n_sources"), F.count("*").alias("n_clauses"), F.count_distinct("id").alias("n_ids"), F.floor((F.sum(line) + F.count("*") - 1) / 2.0).cast("bigint").alias("tokens"))


_PROPOSED = "'{\"id\":\"X' || row_number() OVER (ORDER BY category) || '_' || category || '\",\"category\":\"' || category || '\",\"title\":\"' || CASE WHEN n % 2 = 0 THEN category ELSE '' END || '\",\"text\":\"Seen in ' || n || ' cases.\"}'"


@core.query("data16_gap_drafts", with_(STEPS, _GAPS) + f", gp AS (SELECT coalesce(suggested, '<none>') AS category, count(*) AS n, list(stream_id || ':' || tick ORDER BY stream_id, tick)[1:5] AS ex FROM un GROUP BY 1 HAVING count(*) >= 5), pr AS (SELECT *, {_PROPOSED} AS answer FROM gp) SELECT category, n AS n_cases, 'Not covered (' || n || ' cases): ' || array_to_string(ex, ', ') AS prompt, json_extract_string(answer, '$.id') AS clause_id, CASE WHEN n % 2 = 0 THEN '' ELSE 'title' END AS missing, CASE WHEN n % 2 = 0 THEN 'draft' END AS status, CASE WHEN n % 2 = 0 THEN 'generated' END AS provenance FROM pr")
def gap_drafts(s: SparkSession, d: str) -> DataFrame:
    """From a gap with five cases or more to a prompt for a clause, and from the answer to a draft; answers are given here (every
    other one without a title, which makes no clause)."""
    u = uncovered(s, d).select(F.coalesce("category", F.lit("<none>")).alias("category"), F.concat("stream_id", F.lit(":"), F.col("tick").cast("string")).alias("ref"), "stream_id", "tick")
    n = u.groupBy("category").agg(F.count("*").alias("n")).filter("n >= 5")
    # Five cases of each gap, the first in order: the first five of each of 64 parts, then of all.
    for part in (["category", F.pmod(F.xxhash64("ref"), F.lit(64))], ["category"]):
        u = u.withColumn("_r", F.row_number().over(Window.partitionBy(*part).orderBy("stream_id", "tick"))).filter("_r <= 5")
    ex = u.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("stream_id", "tick", "ref"))), lambda x: x["ref"]).alias("ex"))
    g = n.join(ex, "category").withColumn("k", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("category")))  # a row per gap
    answer = F.to_json(F.struct(F.concat(F.lit("X"), F.col("k").cast("string"), F.lit("_"), "category").alias("id"), "category", F.when(F.col("n") % 2 == 0, F.col("category")).otherwise("").alias("title"), F.concat(F.lit("Seen in "), F.col("n").cast("string"), F.lit(" cases.")).alias("text")))
    p = policies.draft(g.select("category", "n", "ex", answer.alias("answer")), "answer")
    prompt = F.concat(F.lit("Not covered ("), F.col("n").cast("string"), F.lit(" cases): "), F.array_join("ex", ", "))
    return p.select("category", F.col("n").alias("n_cases"), prompt.alias("prompt"), "clause_id", "missing", "status", "provenance")


# -- costs and small closed forms over tables

_RATE = _ROUTE + ", ec AS (SELECT stream_id, avg(CASE WHEN route <> 'decide_safe' THEN 1.0 ELSE 0.0 END) AS r, count(*) / greatest(max(t_s) - min(t_s), 1) AS fps FROM rt GROUP BY stream_id)"
_PER = "(2 * 0.7632 / 3600 * 0.35 + 0.3 * 0.02)"


def _rates(s: SparkSession, d: str) -> DataFrame:
    return routed(s, d).groupBy("stream_id").agg(F.avg((F.col("route") != "decide_safe").cast("double")).alias("r"), (F.count("*") / F.greatest(F.max("t_s") - F.min("t_s"), F.lit(1.0))).alias("fps"))


@core.query("agg09_cost_model", _RATE + f" SELECT stream_id, CAST(round(2.0 * 0.7632 * 0.35, 6) AS DOUBLE) AS uniform, round(fps * 0.0218 * 0.35 + r * fps * 3600 * {_PER} + 0.25, 6) AS adaptive, round((2.0 * 0.7632 * 0.35 - fps * 0.0218 * 0.35 - 0.25) / (fps * 3600 * {_PER}), 6) AS crossover FROM ec")
def cost_model(s: SparkSession, d: str) -> DataFrame:
    """Both costs per stream-hour at each stream's own rates, and the escalation rate at which they are equal (rows A8 and A9)."""
    m = CostModel()
    return _rates(s, d).select("stream_id", R6(F.lit(m.uniform)).alias("uniform"), R6(m.adaptive(F.col("r"), F.col("fps"))).alias("adaptive"), R6(m.crossover(F.col("fps"))).alias("crossover"))


@core.query("stream18_floor_respected", with_(FRAMES) + ", g AS (SELECT stream_id, greatest(0, (avg(risk) - 0.05) / 0.95) AS floor, avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END) AS abstention FROM fr WHERE risk IS NOT NULL AND score IS NOT NULL GROUP BY stream_id) SELECT stream_id, round(floor, 6) AS floor, round(abstention, 6) AS abstention, abstention >= floor - 1e-9 AS respects FROM g")
def floor_respected(s: SparkSession, d: str) -> DataFrame:
    """Whether a threshold of .5 abstains as often as the mean risk demands (row T18)."""
    g = frames(s, d, "risk", "score", where="risk is not null and score is not null").groupBy("stream_id").agg(F.greatest(F.lit(0.0), (F.avg("risk") - 0.05) / 0.95).alias("floor"), F.avg((F.col("score") >= 0.5).cast("double")).alias("abstention"))
    return g.select("stream_id", R6("floor").alias("floor"), R6("abstention").alias("abstention"), (F.col("abstention") >= F.col("floor") - 1e-9).alias("respects"))


@core.query("agg20_aci_regime", with_(FRAMES) + ", g AS (SELECT stream_id, count(err) AS k, count(*) AS n FROM fr GROUP BY stream_id), h AS (SELECT stream_id, CASE WHEN k = 0 THEN 'none' WHEN k = n THEN 'full' ELSE 'audited' END AS regime FROM g) SELECT regime, regime <> 'none' AS applicable, count(*) AS n_streams FROM h GROUP BY ALL")
def aci_regime(s: SparkSession, d: str) -> DataFrame:
    """Streams by what feedback comes back, and whether the adaptive level can be used there (row A20)."""
    from tideline.operators.arithmetic import ACI_REGIMES

    g = frames(s, d, "err").groupBy("stream_id").agg(F.count("err").alias("k"), F.count("*").alias("n"))
    g = g.groupBy(F.when(F.col("k") == 0, "none").when(F.col("k") == F.col("n"), "full").otherwise("audited").alias("regime")).agg(F.count("*").alias("n_streams"))
    return g.withColumn("applicable", F.col("regime").isin([k for k, ok in ACI_REGIMES.items() if ok]))


@core.query("data10_break_even", with_(FRAMES) + ", nu AS (SELECT stream_id, any_value(nu_s) AS nu FROM fr GROUP BY stream_id), fl AS (SELECT fr.stream_id, coalesce(t_s >= nu, false) AS good FROM fr JOIN nu USING (stream_id) WHERE json_valid(action_raw) AND json_extract_string(action_raw, '$.action') = 'flag') SELECT stream_id, round(avg(CAST(good AS INT)), 6) AS precision_, round((0.3 - 0.5) / (1.0 + 0.3), 6) AS break_even, avg(CAST(good AS INT)) >= (0.3 - 0.5) / (1.0 + 0.3) AS worth_flagging, round(0.3 / 1.0, 6) AS false_alarms_per_hit FROM fl GROUP BY stream_id")
def break_even(s: SparkSession, d: str) -> DataFrame:
    """Precision of each stream's flags against the one from which flagging beats silence, and what a false alarm costs in hits."""
    from tideline.functions import protocol
    from tideline.operators.arithmetic import break_even_precision

    alpha, beta, gamma = 0.5, 0.3, 1.0
    f = frames(s, d, "t_s", "nu_s", "action_raw")
    nu = f.groupBy("stream_id").agg(F.first("nu_s", ignorenulls=True).alias("nu"))
    x = f.filter(protocol.strict_action(F.col("action_raw")) == "flag").join(nu, "stream_id")
    g = x.groupBy("stream_id").agg(F.avg(F.coalesce(F.col("t_s") >= F.col("nu"), F.lit(False)).cast("int")).alias("p"))
    q = break_even_precision(alpha, beta, gamma)
    return g.select("stream_id", R6("p").alias("precision_"), R6(F.lit(q)).alias("break_even"), (F.col("p") >= q).alias("worth_flagging"), R6(F.lit(beta / gamma)).alias("false_alarms_per_hit"))
