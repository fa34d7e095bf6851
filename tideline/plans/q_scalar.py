"""Scans, sinks, projections and scalar expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import bins, prompts, protocol, scores, vectors
from tideline.plans.registry import core
from tideline.plans.sqlparts import CLIPS, EMB, FRAMES, STEPS, json_text, with_
from tideline.rng import u01, u01_sql
from tideline.session import table
from tideline.sources.tables import clips, frames

R6 = lambda c: F.round(c, 6)


@core.query(
    "scan01_manifest_pools",
    with_(CLIPS) + " SELECT pool, count(*) AS n, count(*) FILTER (len(label.events) > 0) AS n_events FROM cl WHERE pool IN ('eval', 'calibration') GROUP BY pool",
)
def scan_manifest(s: SparkSession, d: str) -> DataFrame:
    c = clips(s, d, "pool", "label.events").filter(F.col("pool").isin("eval", "calibration"))
    return c.groupBy("pool").agg(F.count("*").alias("n"), F.count(F.when(F.size("label_events") > 0, 1)).alias("n_events"))


@core.query(
    "scan02_record_codec",
    with_(CLIPS) + " SELECT id, split, media.sha256 AS sha256, label.safe AS safe, CAST(len(label.categories) AS BIGINT) AS n_categories, splice.host_id AS host_id FROM cl",
)
def scan_codec(s: SparkSession, d: str) -> DataFrame:
    """Through JSON and back: what is written is what is read."""
    c = clips(s, d, "split", "media", "label", "splice")
    types = {f.name: f.dataType for f in c.schema}
    for k in ("media", "label", "splice"):
        c = c.withColumn(k, F.from_json(F.to_json(F.col(k)), types[k]))
    return c.select("id", "split", F.col("media.sha256").alias("sha256"), F.col("label.safe").alias("safe"), F.size("label.categories").cast("bigint").alias("n_categories"), F.col("splice.host_id").alias("host_id"))


# The imported categories by label number, the subcategories with fine evidence.
IMPORTED = ((1, "C1_sexual"), (2, "C2_abuse"), (3, "C3_violence"), (4, "C4_misinformation"), (5, "C5_illegal"), (6, "C6_extremism"))


@core.query(
    "scan03_import_annotations",
    "SELECT video_path, CAST(count(*) AS BIGINT) AS n_deliveries, any_value(len(labels) = 0) AS safe, any_value(list_transform(list_filter(labels, lambda x: x BETWEEN 1 AND 6), lambda x: ['C1_sexual', 'C2_abuse', 'C3_violence', 'C4_misinformation', 'C5_illegal', 'C6_extremism'][x]))::VARCHAR AS categories, 'video_level' AS granularity FROM annotations GROUP BY video_path",
)
def import_annotations(s: SparkSession, d: str) -> DataFrame:
    m = F.create_map(*[F.lit(x) for kv in IMPORTED for x in kv])
    a = table(s, d, "annotations").select("video_path", "labels").withColumn("c", F.filter(F.transform("labels", lambda x: F.element_at(m, x)), lambda x: x.isNotNull()))
    text = F.concat(F.lit("["), F.array_join("c", ", "), F.lit("]"))
    return a.groupBy("video_path").agg(F.count("*").alias("n_deliveries"), F.first(F.size("labels") == 0).alias("safe"), F.first(text).alias("categories"), F.lit("video_level").alias("granularity"))


@core.query(
    "scan04_annotation_profile",
    """WITH a AS (SELECT DISTINCT * FROM annotations), l AS (SELECT 'label' AS kind, CAST(unnest(labels) AS VARCHAR) AS key FROM a), s AS (SELECT 'subcategory' AS kind, unnest(subcategories) AS key FROM a),
 t AS (SELECT kind, key, count(*) AS n FROM l GROUP BY ALL UNION ALL SELECT kind, key, n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, key) r FROM (SELECT kind, key, count(*) AS n FROM s GROUP BY ALL)) WHERE r <= 10
 UNION ALL SELECT 'benign', '', count(*) FROM a WHERE len(labels) = 0 UNION ALL SELECT 'no_content', '', count(*) FROM a WHERE video_content IS NULL) SELECT * FROM t""",
)
def annotation_profile(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "annotations").distinct()
    labels = a.select(F.lit("label").alias("kind"), F.explode(F.transform("labels", lambda x: x.cast("string"))).alias("key")).groupBy("kind", "key").agg(F.count("*").alias("n"))
    subs = a.select(F.lit("subcategory").alias("kind"), F.explode("subcategories").alias("key")).groupBy("kind", "key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(10)
    one = lambda k, c: a.filter(c).agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), F.lit("").alias("key"), "n")
    return labels.unionByName(subs).unionByName(one("benign", F.size("labels") == 0)).unionByName(one("no_content", F.col("video_content").isNull()))


@core.query("scan05_policy_corpus", "SELECT id, category, status, CAST(version AS BIGINT) AS version, seq FROM policy_clauses WHERE status IN ('active', 'deprecated')")
def policy_enforced(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "policy_clauses").filter(F.col("status").isin("active", "deprecated")).select("id", "category", "status", F.col("version").cast("bigint").alias("version"), "seq")


@core.query(
    "scan08_sample_manifest",
    f"""WITH r AS (SELECT i, {u01_sql(8, 'i')} AS u FROM range(120) t(i)) SELECT i, i % 2 = 0 AS safe, CASE WHEN i % 3 = 0 THEN 'calibration' ELSE 'eval' END AS pool, CASE WHEN i % 2 = 0 THEN 2 ELSE 6 END::BIGINT AS n_cuts,
 round(3600 * CASE WHEN i % 2 = 0 THEN u ELSE 0.6 + 0.4 * u END, 6) AS first_cut_s FROM r""",
)
def sample_manifest(s: SparkSession, d: str) -> DataFrame:
    r = s.range(120).withColumnRenamed("id", "i").withColumn("u", u01(8, F.col("i")))
    even = F.col("i") % 2 == 0
    return r.select("i", even.alias("safe"), F.when(F.col("i") % 3 == 0, "calibration").otherwise("eval").alias("pool"), F.when(even, 2).otherwise(6).cast("bigint").alias("n_cuts"), R6(3600 * F.when(even, F.col("u")).otherwise(0.6 + 0.4 * F.col("u"))).alias("first_cut_s"))


@core.query(
    "scan11_pool_assignment",
    "SELECT CASE WHEN doc_id % 10 < 5 THEN 'eval' WHEN doc_id % 10 < 8 THEN 'calibration' WHEN doc_id % 10 = 8 THEN 'exemplar' ELSE 'compile' END AS pool, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1",
)
def pool_assignment(s: SparkSession, d: str) -> DataFrame:
    m = F.pmod(F.col("doc_id"), F.lit(10))
    pool = F.when(m < 5, "eval").when(m < 8, "calibration").when(m == 8, "exemplar").otherwise("compile")
    return table(s, d, "documents").select("doc_id", pool.alias("pool")).groupBy("pool").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@core.query("scan12_summary_cache_key", with_(CLIPS) + " SELECT id, substr(sha256(concat_ws(':', id, media.sha256, media.codec)), 1, 24) AS cache_key FROM cl")
def cache_key(s: SparkSession, d: str) -> DataFrame:
    return clips(s, d, "media.sha256", "media.codec").select("id", F.substring(F.sha2(F.concat_ws(":", "id", "media_sha256", "media_codec"), 256), 1, 24).alias("cache_key"))


@core.query(
    "proj01_axis_bins",
    with_(CLIPS)
    + """ SELECT id, CASE WHEN axes.temporal_sparsity.ratio IS NULL THEN NULL WHEN axes.temporal_sparsity.ratio >= 0.01 THEN 'dense' WHEN axes.temporal_sparsity.ratio >= 0.001 THEN 'sparse' ELSE 'ultra_sparse' END AS sparsity,
 CASE WHEN coalesce(axes.perceptual_subtlety.requires_ocr, false) THEN 'subtle' WHEN axes.perceptual_subtlety.min_evidence_pixel_area_frac IS NULL THEN NULL WHEN axes.perceptual_subtlety.min_evidence_pixel_area_frac >= 0.05 THEN 'salient' WHEN axes.perceptual_subtlety.min_evidence_pixel_area_frac >= 0.01 THEN 'moderate' ELSE 'subtle' END AS subtlety,
 CASE WHEN axes.context_dependence.window_required_s IS NULL THEN NULL WHEN axes.context_dependence.window_required_s <= 0 THEN 'self_contained' WHEN axes.context_dependence.window_required_s <= 10 THEN 'short_context' ELSE 'long_context' END AS context,
 CASE WHEN axes.modality_locus.decisive IS NULL THEN NULL WHEN len(axes.modality_locus.decisive) > 1 THEN 'multi' WHEN axes.modality_locus.decisive[1] IN ('pixel', 'motion') THEN 'visual' WHEN axes.modality_locus.decisive[1] = 'speech' THEN 'speech' WHEN axes.modality_locus.decisive[1] = 'ocr' THEN 'text' ELSE 'composition' END AS locus FROM cl""",
)
def axis_bins(s: SparkSession, d: str) -> DataFrame:
    """All four axes (rows P1 to P4)."""
    c = clips(s, d, "axes")
    return c.select(
        "id",
        bins.temporal_sparsity(F.col("axes.temporal_sparsity.ratio")).alias("sparsity"),
        bins.perceptual_subtlety(F.col("axes.perceptual_subtlety.min_evidence_pixel_area_frac"), F.col("axes.perceptual_subtlety.requires_ocr")).alias("subtlety"),
        bins.context_dependence(F.col("axes.context_dependence.window_required_s")).alias("context"),
        bins.modality_locus(F.col("axes.modality_locus.decisive")).alias("locus"),
    )


@core.query(
    "proj05_event_derived",
    with_(CLIPS) + " SELECT id, round(coalesce(list_sum(list_transform(label.events, lambda e: e.t_end_s - e.t_start_s)), 0), 6) AS needle_total_s, CAST(len(label.events) AS BIGINT) AS n_events, granularity = 'temporal' AND len(label.events) > 0 AS has_nu, list_min(list_transform(label.events, lambda e: e.t_start_s)) AS nu_s FROM cl",
)
def event_derived(s: SparkSession, d: str) -> DataFrame:
    c = clips(s, d, "label.events", "granularity")
    e = F.col("label_events")
    total = F.aggregate(F.transform(e, lambda x: x["t_end_s"] - x["t_start_s"]), F.lit(0.0), lambda a, x: a + x)
    return c.select("id", R6(F.coalesce(total, F.lit(0.0))).alias("needle_total_s"), F.size(e).cast("bigint").alias("n_events"), ((F.col("granularity") == "temporal") & (F.size(e) > 0)).alias("has_nu"), F.array_min(F.transform(e, lambda x: x["t_start_s"])).alias("nu_s"))


@core.query("proj07_l2_normalize", with_(EMB) + " SELECT vec_id, round(list_sum(list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12))), 6) AS unit_sum, round(v[1] / greatest(sqrt(list_dot_product(v, v)), 1e-12), 6) AS unit_first FROM em")
def l2_normalize(s: SparkSession, d: str) -> DataFrame:
    v = vectors.doubles(F.col("embedding"))
    e = table(s, d, "embeddings").select("vec_id", v.alias("v")).withColumn("n", F.greatest(vectors.norm(F.col("v")), F.lit(1e-12)))
    u = e.withColumn("u", F.transform("v", lambda x: x / F.col("n")))
    return u.select("vec_id", R6(F.aggregate("u", F.lit(0.0), lambda a, x: a + x)).alias("unit_sum"), R6(F.get("u", F.lit(0))).alias("unit_first"))


@core.query("proj08_adjacent_cosine", with_(EMB) + " SELECT a.vec_id, round(list_dot_product(a.v, b.v), 6) AS cos_prev FROM em a JOIN em b ON b.vec_id = a.vec_id - 1")
def adjacent_cosine(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings").select("vec_id", vectors.doubles(F.col("embedding")).alias("v"))
    prev = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(prev, "vec_id").select("vec_id", R6(vectors.dot(F.col("v"), F.col("w"))).alias("cos_prev"))


@core.query(
    "proj09_channel_scores",
    with_(FRAMES)
    + """ SELECT stream_id, tick, round(CASE WHEN channels['codec'] IS NULL THEN 0 ELSE greatest(-3, least(3, channels['codec'] - 1)) END, 6) AS codec_score,
 round(CASE WHEN cardinality(channels) > 0 THEN list_sum(map_values(channels)) END, 6) AS fused FROM fr""",
)
def channel_scores(s: SparkSession, d: str) -> DataFrame:
    """Codec score (row P9) and the plain fusion of the channels (row P11)."""
    f = frames(s, d, "channels")
    codec = F.col("channels")["codec"]
    return f.select("stream_id", "tick", R6(scores.codec_score(F.when(codec.isNotNull(), F.array(codec)))).alias("codec_score"), R6(scores.channel_sum(F.col("channels"))).alias("fused"))


@core.query("proj10_text_score", "SELECT doc_id, round(least(coalesce(length(text), 0) / 500.0, 1.0), 6) AS text_score, CAST(length(text) // 2 AS BIGINT) AS tokens_estimate FROM documents")
def text_score(s: SparkSession, d: str) -> DataFrame:
    """Text score (row P10) and the token estimate (row P29)."""
    return table(s, d, "documents").select("doc_id", R6(scores.text_score(F.col("text"))).alias("text_score"), prompts.tokens_estimate(F.col("text")).alias("tokens_estimate"))


_U = "least(1.0, 0.4 * exp(-power(score, 2)) + 0.6 * coalesce(ood, 0.0))"


@core.query(
    "proj13_llr_uncertainty",
    with_(FRAMES) + f" SELECT stream_id, tick, round(score - 0.5, 6) AS llr, round(exp(-power(score, 2)), 6) AS boundary, round({_U}, 6) AS uncertainty, round({_U} * sqrt(exp(-power(score, 2))) + 0.5 * {_U}, 6) AS voi, round(1 / (1 + exp(-greatest(-30.0, least(30.0, score)))), 6) AS p FROM fr WHERE score IS NOT NULL",
)
def llr_uncertainty(s: SparkSession, d: str) -> DataFrame:
    """Likelihood ratio (P13), boundary and combined uncertainty (P14, P15), value of asking (P16), sigmoid (P18)."""
    f = frames(s, d, "score", "ood", where="score is not null")
    b, u = scores.boundary_uncertainty(F.col("score")), scores.uncertainty(F.col("score"), F.col("ood"))
    return f.select("stream_id", "tick", R6(scores.llr(F.col("score"))).alias("llr"), R6(b).alias("boundary"), R6(u).alias("uncertainty"), R6(scores.voi(u, b)).alias("voi"), R6(vectors.sigmoid(F.col("score"))).alias("p"))


_ROUTE = f"""WITH {FRAMES}, x AS (SELECT *, exp(-power(score, 2)) AS b, {_U} AS u, {u01_sql('rho', 'stream_id', 'tick')} < 0.02 AS forced, coalesce(ood, 0) AS o FROM fr WHERE score IS NOT NULL),
 rt AS (SELECT *, CASE WHEN forced THEN 'forced' WHEN u * sqrt(b) + 0.5 * u >= 0.25 THEN 'escalate' WHEN score >= 0.4 THEN 'escalate' WHEN score <= -0.4 THEN CASE WHEN o >= 0.15 THEN 'escalate' ELSE 'decide_safe' END WHEN score >= 0 THEN 'escalate' WHEN o >= 0.15 THEN 'escalate' ELSE 'decide_safe' END AS route FROM x)"""


def routed(s: SparkSession, d: str) -> DataFrame:
    f = frames(s, d, "score", "ood", "t_s", where="score is not null")
    return f.withColumn("forced", u01("rho", F.col("stream_id"), F.col("tick")) < 0.02).withColumn("route", scores.route(F.col("score"), F.col("ood"), F.col("forced"), F.lit(False)))


@core.query("proj17_competence_route", _ROUTE + " SELECT stream_id, tick, route FROM rt")
def competence_route(s: SparkSession, d: str) -> DataFrame:
    return routed(s, d).select("stream_id", "tick", "route")


@core.query(
    "proj19_json_extraction",
    with_(FRAMES) + f", j AS (SELECT stream_id, tick, {json_text('action_raw')} AS js FROM fr WHERE action_raw IS NOT NULL) SELECT stream_id, tick, js AS json_text, coalesce(json_valid(js), false) AS ok FROM j",
)
def json_extraction(s: SparkSession, d: str) -> DataFrame:
    f = frames(s, d, "action_raw", where="action_raw is not null").withColumn("json_text", protocol.json_text(F.col("action_raw")))
    return f.select("stream_id", "tick", "json_text", protocol.parsed(F.col("json_text")).isNotNull().alias("ok"))


@core.query("proj20_parse_step", with_(STEPS) + " SELECT stream_id, tick, action, category, citation AS policy_citation, confidence, suggested AS suggested_category FROM st")
def parse_step(s: SparkSession, d: str) -> DataFrame:
    """Lenient parse (P20) with normalised citations (P21) and the validity rule (P23)."""
    f = protocol.with_step(frames(s, d, "action_raw", where="action_raw is not null"))
    return f.select("stream_id", "tick", *[f"s.{c}" for c in ("action", "category", "policy_citation", "confidence", "suggested_category")])


@core.query("proj22_strict_parse", with_(FRAMES) + " SELECT stream_id, tick, CASE WHEN json_valid(action_raw) AND trim(action_raw)[1] = '{' AND json_extract_string(action_raw, '$.action') IN ('hold', 'flag', 'clear', 'uncovered') THEN json_extract_string(action_raw, '$.action') END AS action FROM fr WHERE action_raw IS NOT NULL")
def strict_parse(s: SparkSession, d: str) -> DataFrame:
    f = frames(s, d, "action_raw", where="action_raw is not null")
    return f.select("stream_id", "tick", protocol.strict_action(F.col("action_raw")).alias("action"))


@core.query(
    "proj24_response_rule",
    "SELECT doc_id, v AS verdict, (v IN ('safe', 'uncertain') OR (v = 'unsafe' AND doc_id % 4 <> 0)) AS accepted FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'safe' WHEN 1 THEN 'unsafe' ELSE 'uncertain' END AS v FROM documents)",
)
def response_rule(s: SparkSession, d: str) -> DataFrame:
    """A verdict must be known, and 'unsafe' needs citations (here: where the id is no multiple of four)."""
    r = table(s, d, "documents").select("doc_id").withColumn("verdict", F.element_at(F.array(F.lit("safe"), F.lit("unsafe"), F.lit("uncertain")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int")))
    return r.select("doc_id", "verdict", (F.col("verdict").isin("safe", "uncertain") | ((F.col("verdict") == "unsafe") & (F.pmod("doc_id", F.lit(4)) != 0))).alias("accepted"))


@core.query(
    "proj25_render_assemble",
    with_(CLIPS) + r" SELECT id, md5(array_to_string(list_filter(['Clip ' || id || ' (' || coalesce(split, '') || ')', metadata_adversarial.title, metadata_adversarial.description, 'Answer as JSON.'], lambda p: p IS NOT NULL AND p <> ''), chr(10) || chr(10))) AS prompt_md5 FROM cl",
)
def render_assemble(s: SparkSession, d: str) -> DataFrame:
    """Template (P25) and assembly of the non-empty parts (P26)."""
    c = clips(s, d, "split", "metadata_adversarial.title", "metadata_adversarial.description")
    head = prompts.render("Clip $id (${split})", {"id": F.col("id"), "split": F.col("split")})
    return c.select("id", F.md5(prompts.assemble(head, F.col("metadata_adversarial_title"), F.col("metadata_adversarial_description"), F.lit("Answer as JSON."))).alias("prompt_md5"))


@core.query(
    "proj27_corpus_fingerprint",
    "SELECT substr(sha256(string_agg(id || chr(31) || text, chr(30) ORDER BY id)), 1, 16) AS fingerprint, count(*) AS n FROM policy_clauses WHERE status IN ('active', 'deprecated')",
)
def corpus_fingerprint(s: SparkSession, d: str) -> DataFrame:
    """Over the sorted clauses, so their order does not matter; a corpus of clauses is a small document."""
    p = table(s, d, "policy_clauses").filter(F.col("status").isin("active", "deprecated"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "text"))), lambda x: F.concat(x["id"], F.lit("\x1f"), x["text"])), "\x1e")
    return p.agg(F.substring(F.sha2(text, 256), 1, 16).alias("fingerprint"), F.count("*").alias("n"))


@core.query(
    "proj28_policy_render",
    f"SELECT string_agg('id=' || id || ' | ' || title || ': ' || text, chr(10) ORDER BY seq) AS in_order, string_agg(id, ',' ORDER BY {u01_sql(28, 'id')}, id) AS shuffled FROM policy_clauses WHERE status IN ('active', 'deprecated')",
)
def policy_render(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "policy_clauses").filter(F.col("status").isin("active", "deprecated")).withColumn("u", u01(28, F.col("id")))
    line = lambda x: F.concat(F.lit("id="), x["id"], F.lit(" | "), x["title"], F.lit(": "), x["text"])
    return p.agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "id", "title", "text"))), line), "\n").alias("in_order"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("u", "id"))), lambda x: x["id"]), ",").alias("shuffled"),
    )


_RULES = (
    ("safe_with_events", "label.safe AND len(label.events) > 0", lambda: F.col("label.safe") & (F.size("label.events") > 0)),
    ("unsafe_without_events", "NOT label.safe AND len(label.events) = 0 AND granularity = 'temporal'", lambda: ~F.col("label.safe") & (F.size("label.events") == 0) & (F.col("granularity") == "temporal")),
    ("video_level_with_events", "granularity = 'video_level' AND len(label.events) > 0", lambda: (F.col("granularity") == "video_level") & (F.size("label.events") > 0)),
    ("native_with_splice", "source.kind = 'native' AND splice IS NOT NULL", lambda: (F.col("source.kind") == "native") & F.col("splice").isNotNull()),
    ("bait_on_unsafe", "metadata_adversarial.condition = 'fp_bait' AND NOT label.safe", lambda: (F.col("metadata_adversarial.condition") == "fp_bait") & ~F.col("label.safe")),
    ("camouflage_on_safe", "metadata_adversarial.condition = 'camouflage' AND label.safe", lambda: (F.col("metadata_adversarial.condition") == "camouflage") & F.col("label.safe")),
)


@core.query("proj30_metadata_rules", with_(CLIPS) + " SELECT id, concat_ws(',', " + ", ".join(f"CASE WHEN {sql} THEN '{n}' END" for n, sql, _ in _RULES) + ") AS violations FROM cl")
def metadata_rules(s: SparkSession, d: str) -> DataFrame:
    c = clips(s, d, "label", "granularity", "source", "splice", "metadata_adversarial")
    return c.select("id", F.concat_ws(",", *[F.when(rule(), n) for n, _, rule in _RULES]).alias("violations"))


@core.query("proj31_needle_coverage", with_(CLIPS) + " SELECT id, round(least(1.0, axes.temporal_sparsity.needle_total_s * media.fps), 6) AS coverage FROM cl WHERE media.fps IS NOT NULL")
def needle_coverage(s: SparkSession, d: str) -> DataFrame:
    c = clips(s, d, "axes.temporal_sparsity.needle_total_s", "media.fps").filter("media_fps is not null")
    return c.select("id", R6(F.least(F.lit(1.0), F.col("axes_temporal_sparsity_needle_total_s") * F.col("media_fps"))).alias("coverage"))


@core.query("proj33_target_json", with_(STEPS) + " SELECT stream_id, tick, '{\"action\":\"flag\",\"category\":\"' || category || '\",\"policy_citation\":\"SW-' || category || '\"}' AS target FROM st WHERE action = 'flag'")
def target_json(s: SparkSession, d: str) -> DataFrame:
    """What a window is trained to answer (P33), cited by its category (P34)."""
    f = protocol.with_step(frames(s, d, "action_raw", where="action_raw is not null")).filter("s.action = 'flag'")
    return f.select("stream_id", "tick", F.to_json(F.struct(F.lit("flag").alias("action"), F.col("s.category").alias("category"), F.concat(F.lit("SW-"), F.col("s.category")).alias("policy_citation"))).alias("target"))


@core.query(
    "proj32_histogram_encoder",
    with_(EMB) + " SELECT vec_id, " + ", ".join(f"round(len(list_filter(v, lambda x: greatest(0, least(3, floor((x + 0.2) / 0.4 * 4))) = {b})) / 64, 6) AS h{b}" for b in range(4)) + " FROM em",
)
def histogram_encoder(s: SparkSession, d: str) -> DataFrame:
    """The encoder that needs no model, over the values of each vector."""
    from tideline.operators.encoders import histogram

    e = table(s, d, "embeddings").select("vec_id", histogram(vectors.doubles(F.col("embedding")), -0.2, 0.2, 4).alias("h"))
    return e.select("vec_id", *[R6(F.get("h", F.lit(b))).alias(f"h{b}") for b in range(4)])


@core.query("proj32_random_projection")
def projection_encoder(s: SparkSession, d: str) -> DataFrame:
    from tideline.operators.encoders import random_projection

    p = random_projection(table(s, d, "embeddings"), "vec_id", "embedding")
    return p.select("vec_id", R6(F.get("code", F.lit(0))).alias("first_"), F.size("code").cast("bigint").alias("dim"))
