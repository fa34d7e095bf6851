"""Validation of a dataset: rules per record and across records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.leakage_audit import audit, position_test
from tideline.plans.registry import core
from tideline.plans.sqlparts import CLIPS, with_
from tideline.session import table
from tideline.sources.tables import clips

R6 = lambda c: F.round(c, 6)
_ENUMS = {"split": ("train", "calib", "test", "zeroday_holdout"), "pool": ("exemplar", "compile", "calibration", "eval"), "granularity": ("temporal", "video_level")}


@core.query(
    "valid01_record_schema",
    with_(CLIPS) + " SELECT id, CASE " + " ".join(f"WHEN {c} IS NULL OR {c} NOT IN {v} THEN '{c}'" for c, v in _ENUMS.items()) + " WHEN len(list_filter(label.events, lambda e: e.t_end_s <= e.t_start_s)) > 0 THEN 'event_length' WHEN len(list_filter(label.events, lambda e: e.severity NOT IN ('low', 'medium', 'high'))) > 0 THEN 'severity' WHEN media.duration_s <= 0 THEN 'duration' END AS first_error FROM cl",
)
def record_schema(s: SparkSession, d: str) -> DataFrame:
    """The first rule a record breaks, null if none."""
    c = clips(s, d, *_ENUMS, "label.events", "media.duration_s")
    e = F.col("label_events")
    out = F.lit(None).cast("string")
    rules = [(F.col(k).isNull() | ~F.col(k).isin(*v), k) for k, v in _ENUMS.items()]
    rules += [(F.size(F.filter(e, lambda x: x["t_end_s"] <= x["t_start_s"])) > 0, "event_length"), (F.size(F.filter(e, lambda x: ~x["severity"].isin("low", "medium", "high"))) > 0, "severity"), (F.col("media_duration_s") <= 0, "duration")]
    for cond, name in reversed(rules):
        out = F.when(cond, name).otherwise(out)
    return c.select("id", out.alias("first_error"))


@core.query("valid02_pool_disjoint", "SELECT id, count(DISTINCT pool) AS n_pools FROM clips WHERE id IS NOT NULL GROUP BY id HAVING count(DISTINCT pool) > 1 OR count(*) > 1")
def pool_disjoint(s: SparkSession, d: str) -> DataFrame:
    """Ids delivered more than once, with the number of pools they were put in."""
    return table(s, d, "clips").filter("id is not null").groupBy("id").agg(F.count_distinct("pool").alias("n_pools"), F.count("*").alias("n")).filter("n_pools > 1 or n > 1").select("id", "n_pools")


@core.query("valid03_splice_balanced", with_(CLIPS) + ", g AS (SELECT avg(len(splice.cuts)) FILTER (label.safe) AS a, avg(len(splice.cuts)) FILTER (NOT label.safe) AS b FROM cl WHERE splice IS NOT NULL) SELECT round(a, 6) AS safe_cuts, round(b, 6) AS unsafe_cuts, (greatest(a, b) - least(a, b)) / greatest(a, b) > 0.15 AS unbalanced FROM g")
def splice_balanced(s: SparkSession, d: str) -> DataFrame:
    c = clips(s, d, "splice.cuts", "label.safe").filter("splice_cuts is not null")
    n = F.size("splice_cuts")
    g = c.agg(F.avg(F.when(F.col("label_safe"), n)).alias("a"), F.avg(F.when(~F.col("label_safe"), n)).alias("b"))
    a, b = F.col("a"), F.col("b")
    return g.select(R6(a).alias("safe_cuts"), R6(b).alias("unsafe_cuts"), ((F.greatest(a, b) - F.least(a, b)) / F.greatest(a, b) > 0.15).alias("unbalanced"))


def _positions(s: SparkSession, d: str) -> DataFrame:
    c = clips(s, d, "splice.cuts", "media.duration_s", "label.safe").filter("splice_cuts is not null and media_duration_s > 0 and label_safe is not null")
    p = c.select("label_safe", "media_duration_s", F.explode("splice_cuts.t_s").alias("t")).filter("t is not null")
    b = F.floor(F.least(F.col("t") / F.col("media_duration_s"), F.lit(0.999)) * 10).cast("bigint")
    return p.groupBy(b.alias("bin")).agg(F.count(F.when(F.col("label_safe"), 1)).alias("n_safe"), F.count(F.when(~F.col("label_safe"), 1)).alias("n_unsafe"))


@core.query("valid04_cut_positions", with_(CLIPS) + ", p AS (SELECT label.safe AS safe, media.duration_s AS dur, unnest(splice.cuts).t_s AS t FROM cl WHERE splice IS NOT NULL AND media.duration_s > 0 AND label.safe IS NOT NULL) SELECT CAST(floor(least(t / dur, 0.999) * 10) AS BIGINT) AS bin, count(*) FILTER (safe) AS n_safe, count(*) FILTER (NOT safe) AS n_unsafe FROM p WHERE t IS NOT NULL GROUP BY 1")
def cut_positions(s: SparkSession, d: str) -> DataFrame:
    return _positions(s, d)


@core.query("valid04_permutation_test")
def permutation_test(s: SparkSession, d: str) -> DataFrame:
    """The distance of the two position histograms and its p, from the ten pairs of counts; no finding on fewer than 20 spliced clips
    or 40 cuts."""
    counts = {r.bin: (r.n_safe, r.n_unsafe) for r in _positions(s, d).orderBy("bin").collect()}
    spliced = clips(s, d, "splice.cuts").filter("splice_cuts is not null").count()
    n = sum(a + b for a, b in counts.values())
    if spliced < 20 or n < 40:
        return s.createDataFrame([(None, None, "too_few")], "tvd double, p double, finding string")
    tvd, p = position_test(counts)
    return s.createDataFrame([(round(tvd, 6), round(p, 6), "error" if p < 0.01 else "warn" if p < 0.1 else "ok")], "tvd double, p double, finding string")


@core.query("valid05_calibration_size", with_(CLIPS) + " SELECT category, count(*) AS n, count(*) < 45 AS too_few FROM (SELECT id, unnest(label.events).category AS category FROM cl WHERE lower(trim(split)) = 'calib') GROUP BY category")
def calibration_size(s: SparkSession, d: str) -> DataFrame:
    c = clips(s, d, "split", "label.events").filter(F.lower(F.trim("split")) == "calib")
    return c.select(F.explode("label_events.category").alias("category")).groupBy("category").agg(F.count("*").alias("n"), (F.count("*") < 45).alias("too_few"))


_AX = ("temporal_sparsity", "perceptual_subtlety", "modality_locus", "context_dependence")


@core.query("valid06_axis_coverage", with_(CLIPS) + ", a AS (" + " UNION ALL ".join(f"SELECT '{a}' AS axis, lower(trim(axes.{a}.bin)) AS bin FROM cl" for a in _AX) + ") SELECT axis, count(DISTINCT bin) AS n_bins, count(*) FILTER (bin IS NULL) AS n_missing, count(DISTINCT bin) < 2 AS thin FROM a GROUP BY axis")
def axis_coverage(s: SparkSession, d: str) -> DataFrame:
    c = clips(s, d, "axes")
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.lower(F.trim(F.col(f"axes.{a}.bin"))).alias("bin")) for a in _AX])).alias("x")
    return c.select(pairs).select("x.*").groupBy("axis").agg(F.count_distinct("bin").alias("n_bins"), F.count(F.when(F.col("bin").isNull(), 1)).alias("n_missing"), (F.count_distinct("bin") < 2).alias("thin"))


@core.query("valid07_findings")
def findings(s: SparkSession, d: str) -> DataFrame:
    """All checks as rows: level, check, count."""
    rows = [
        record_schema(s, d).filter("first_error is not null").groupBy(F.concat(F.lit("schema:"), "first_error").alias("check")).agg(F.count("*").alias("n")).withColumn("level", F.lit("error")),
        pool_disjoint(s, d).filter("n_pools > 1").agg(F.count("*").alias("n")).select(F.lit("pool_disjoint").alias("check"), "n", F.lit("error").alias("level")),
        splice_balanced(s, d).filter("unbalanced").agg(F.count("*").alias("n")).select(F.lit("splice_balanced").alias("check"), "n", F.lit("error").alias("level")),
        permutation_test(s, d).filter(F.col("finding").isin("error", "warn")).groupBy(F.col("finding").alias("level")).agg(F.count("*").alias("n")).withColumn("check", F.lit("cut_position_leakage")),
        calibration_size(s, d).filter("too_few").agg(F.count("*").alias("n")).select(F.lit("calib_sample_size").alias("check"), "n", F.lit("warn").alias("level")),
        axis_coverage(s, d).filter("thin").agg(F.count("*").alias("n")).select(F.lit("axis_coverage").alias("check"), "n", F.lit("warn").alias("level")),
    ]
    out = rows[0].select("level", "check", "n")
    for r in rows[1:]:
        out = out.unionByName(r.select("level", "check", "n"))
    return out.filter("n > 0")


@core.query("valid08_codec_audit")
def codec_audit(s: SparkSession, d: str) -> DataFrame:
    """Whether 'safe' can be told from encoder settings: forests over folds, held-out AUC and its p."""
    c = clips(s, d, "media", "label.safe").filter("label_safe is not null")
    x = c.select("id", "label_safe", F.col("media.fps").alias("fps"), F.col("media.reencode.crf").cast("double").alias("crf"), F.col("media.reencode.gop").cast("double").alias("gop"), F.get("media.resolution", F.lit(1)).cast("double").alias("height"), F.when(F.col("media.codec") == "h264", 0.0).when(F.col("media.codec") == "hevc", 1.0).otherwise(2.0).alias("codec"))
    return audit(x, ["fps", "crf", "gop", "height", "codec"], "label_safe", F.col("id"))
