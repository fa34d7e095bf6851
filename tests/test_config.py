import pytest

from tideline import config
from tideline.errors import TemplateError, UnknownComponent
from tideline.operators import arithmetic
from tideline.sources import policy


def test_round_trip_and_refusals(tmp_path):
    c = config.override(config.EngineConfig(), **{"aci.gamma": 0.02, "sampling.rho": 0.5})
    assert c.aci.gamma == 0.02 and config.EngineConfig().aci.gamma == 0.002
    config.save(c, str(tmp_path / "c.json"))
    assert config.load(str(tmp_path / "c.json")) == c
    with pytest.raises(KeyError):
        config.coerce(config.EngineConfig, {"aci": {"gama": 1}})
    with pytest.raises(KeyError):
        config.override(c, **{"nope.x": 1})
    for bad in ({"sampling.rho": 0.0}, {"aci.alpha": 2.0}, {"reward.false_alarm": 1.0}, {"reward.uncovered_right": 1.5}, {"cusum.sigma": 0.0}):
        with pytest.raises(ValueError):
            config.override(c, **bad)


def test_components():
    r = config.Components()
    r.register("judge", "none")(lambda x=1: x)
    assert r.build("judge", "none", 5) == 5 and r.available("judge") == ["none"]
    with pytest.raises(UnknownComponent):
        r.build("judge", "some")
    r.clear()
    assert r.available("judge") == []


def test_published_arithmetic():
    assert [round(arithmetic.abstention_floor(m, 0.05) * 100, 1) for m in (0.02, 0.05, 0.1, 0.2, 0.4)] == [0.0, 0.0, 5.3, 15.8, 36.8]
    assert round(arithmetic.implied_escalation(1.76, 0.04, 5.02), 4) == 0.3426
    assert arithmetic.streams_to_fill(32, 0.5, 1.0) == 64
    assert arithmetic.crossover(1.0, 0.2, 0.0, 1.0, 4.0, 0.5, 8.0) == 0.1
    assert arithmetic.min_batch(30, {1: 0.2, 8: 0.2, 32: 0.5}) == 8
    with pytest.raises(ValueError):
        arithmetic.implied_escalation(9.0, 0.1, 1.0)


def test_corpus_and_templates(spark, tmp_path):
    p = tmp_path / "p.json"
    p.write_text('{"clauses": [{"id": "C1", "category": "C1", "title": "t", "text": "x", "status": "active", "version": 1}, {"id": "C2", "category": "C2", "title": "t", "text": "y", "status": "draft", "version": 1}]}')
    c = policy.load_corpus(spark, str(p))
    a = {r.id: (r.status, r.version, r.supersedes, r.seq) for r in policy.amend(c, "C1", "z").collect()}
    assert a == {"C1": ("retired", 1, None, 1), "C2": ("draft", 1, None, 2), "C1.v2": ("draft", 2, "C1", 3)}
    policy.save_corpus(c, str(tmp_path / "q.json"))
    assert policy.load_corpus(spark, str(tmp_path / "q.json")).select("id", "text", "seq").collect() == c.select("id", "text", "seq").collect()
    t = tmp_path / "t.json"
    t.write_text('{"ask": "clip $id"}')
    assert policy.load_templates(str(t), {"ask": {"id"}}) == {"ask": "clip $id"}
    with pytest.raises(TemplateError):
        policy.load_templates(str(t), {"ask": {"id", "rule"}})
