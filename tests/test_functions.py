"""Expected values worked out by hand from the definitions."""

import math

import pytest
from pyspark.sql import functions as F

from tideline.errors import PoolViolation, TemplateError
from tideline.functions import bins, prompts, protocol, scores, vectors
from tideline.sources.tables import ALL_POOLS, manifest_version, read_manifest


def one(spark, *cols):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).collect()[0])


def test_bins(spark):
    t = lambda x: bins.temporal_sparsity(F.lit(x).cast("double"))
    assert one(spark, t(0.01), t(0.0099), t(0.001), t(0.0), t(None)) == ["dense", "sparse", "sparse", "ultra_sparse", None]
    p = lambda a, o: bins.perceptual_subtlety(F.lit(a).cast("double"), F.lit(o).cast("boolean"))
    assert one(spark, p(0.05, False), p(0.01, None), p(0.001, False), p(0.5, True), p(None, None)) == ["salient", "moderate", "subtle", "subtle", None]
    c = lambda x: bins.context_dependence(F.lit(x).cast("double"))
    assert one(spark, c(0), c(10), c(10.1), c(None)) == ["self_contained", "short_context", "long_context", None]
    m = lambda *x: bins.modality_locus(F.array(*map(F.lit, x)).cast("array<string>"))
    assert one(spark, m("pixel"), m("motion"), m("ocr"), m("pixel", "speech"), m("smell"), m()) == ["visual", "visual", "text", "multi", "composition", "composition"]


def test_routes(spark):
    r = lambda s, o, forced=False, alarmed=False: scores.route(F.lit(s).cast("double"), F.lit(o).cast("double"), F.lit(forced), F.lit(alarmed))
    got = one(spark, r(-3.0, 0.0), r(-3.0, 0.2), r(-3.0, 0.0, True), r(0.0, 0.0), r(3.0, 0.0), r(-3.0, 0.1, alarmed=True), r(None, 0.0), r(-3.0, None))
    assert got == ["decide_safe", "escalate", "forced", "escalate", "escalate", "decide_safe", None, "decide_safe"]
    assert one(spark, scores.route(F.lit(3.0), F.lit(0.0), F.lit(False), F.lit(False), scores.Router(can_decide_unsafe=True))) == ["decide_unsafe"]


def test_scores(spark):
    assert one(spark, scores.llr(F.lit(1.5)), scores.text_score(F.lit("x" * 250)), scores.text_score(F.lit(None).cast("string"))) == [1.0, 0.5, 0.0]
    assert one(spark, scores.codec_score(F.array(F.lit(9.0))), scores.codec_score(F.array(F.lit(-9.0))), scores.codec_score(F.lit(None).cast("array<double>"))) == [3.0, -3.0, 0.0]
    with pytest.raises(ValueError):
        scores.llr(F.lit(1.0), sigma=0)
    u = one(spark, scores.uncertainty(F.lit(0.0), F.lit(0.5)))[0]
    assert math.isclose(u, 0.4 + 0.3)


def test_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    z = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.dot(v, v), vectors.norm(v), vectors.l2(v), vectors.l2(z)) == [25.0, 5.0, [0.6, 0.8], [0.0, 0.0]]
    assert one(spark, vectors.sigmoid(F.lit(0.0))) == [0.5]


CASES = [
    ('{"action": "hold"}', "hold", "hold"),
    ('```json\n{"action": "clear"}\n```', "clear", None),
    ('My reading: {"action": "hold"} ok', "hold", None),
    ('{"action": "flag", "policy_citation": "[C1_sexual]"}', "flag", "flag"),
    ('{"action": "flag"}', "invalid", "flag"),
    ('{"action": "flag", "policy_citation": "n/a"}', "invalid", "flag"),
    ('{"action": "alert"}', "invalid", None),
    ('{"action": "', "invalid", None),
    ("no decision", "invalid", None),
    ('["action"]', "invalid", None),
    ("", "invalid", None),
]


def test_protocol(spark):
    df = spark.createDataFrame([(i, r) for i, (r, *_) in enumerate(CASES)], "i int, raw string")
    got = df.select("i", protocol.step(F.col("raw"))["action"].alias("a"), protocol.strict_action(F.col("raw")).alias("s")).orderBy("i").collect()
    assert [(r.a, r.s) for r in got] == [(a, s) for _, a, s in CASES]


def test_citations(spark):
    n = lambda x: protocol.normalize_citation(F.lit(x))
    assert one(spark, n("[C1_sexual]"), n(" id=C1_sexual"), n("policy_id=C2"), n("「C3」"), n("None"), n("  "), n("`ID: C4`")) == ["C1_sexual", "C1_sexual", "C2", "C3", None, None, "C4"]


def test_prompts(spark):
    assert one(spark, prompts.render("a $x b ${y}!", {"x": F.lit(1), "y": F.lit(None).cast("string")})) == ["a 1 b !"]
    with pytest.raises(TemplateError):
        prompts.render("$nope", {})
    assert one(spark, prompts.assemble(F.lit("a"), F.lit(""), F.lit(None).cast("string"), F.lit("b"), joiner="|")) == ["a|b"]
    k = one(spark, prompts.key(F.lit("a"), F.lit("b")), prompts.key(F.lit("ab"), F.lit("")))
    assert len(k[0]) == 24 and k[0] != k[1]


def test_manifest(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    p.write_text('{"__meta__": {"spec_version": "1.0"}}\n{"id": "a", "pool": "eval", "split": "test"}\n\n{"id": "b", "pool": "compile", "split": "train"}\n')
    with pytest.raises(PoolViolation):
        read_manifest(spark, str(p), pool=None)
    assert [r.id for r in read_manifest(spark, str(p), pool=("eval",)).collect()] == ["a"]
    assert read_manifest(spark, str(p), pool=ALL_POOLS).count() == 2
    assert read_manifest(spark, str(p), pool=ALL_POOLS, split="train").count() == 1
    assert manifest_version(spark, str(p)) == "1.0"
