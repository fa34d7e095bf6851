"""Replays against a loop over one stream, policies and costs against their rules."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import policies, simulate
from tideline.operators.costs import CostModel
from tideline.operators.steps import Aci
from tideline.plans import catalog
from tideline.rng import u01_many


def u(seed, *key):
    return int(hashlib.md5(":".join([seed, *map(str, key)]).encode()).hexdigest()[:8], 16) / 4294967296


STREAMS = [("a", 90.0, 40.0, 43.0), ("b", 60.0, None, None), ("c", 30.0, 5.0, 0.0), ("d", 400.0, 100.0, 399.9), ("e", 0.5, None, 3.0)]


def times(s, duration, alarm):
    t, i, k, burst, out = 0.0, 0, 0, False, []
    while t < duration:
        out.append((i, t))
        burst = burst or alarm is not None and t >= alarm
        if burst:
            t, k = t + max(1e-3, 0.25 + 0.4 * (2 * u("burst", s, k) - 1)), k + 1
        else:
            t += max(1e-3, 2.0 + 0.4 * (2 * u("gap", s, i) - 1))
        i += 1
    return out


def loop(s, duration, nu, alarm):
    kept, out = [], []
    for i, t in times(s, duration, alarm):
        if u("skip", s, i) < 0.05:
            continue
        before = len(kept)
        kept = [x for x in kept if not t - x > 16] + [t]
        alarmed = alarm is not None and t >= alarm
        up = alarmed or u("up", s, i) < 0.05
        inside = nu is not None and nu <= t <= nu + 10
        label = "clear" if not inside else "hold" if (t - nu) / 10 < 0.4 else "flag"
        out.append((s, i, round(t, 6), alarmed, up, before + 1 - len(kept), min(2, len(kept)) if alarmed else int(up), label))
    return out


def walk(ticks, act):
    is_open, tokens, since, out = False, 0, 0, []
    for x in ticks:
        a = act(x) if x[4] else "hold"
        if a == "flag":
            is_open, tokens, since = True, tokens + 40, since + 1
        elif a == "clear" and is_open:
            is_open, tokens, since = False, 0, 0
        elif is_open:
            since += 1
        out.append((x[0], x[1], a, is_open, tokens, since))
    return out


def test_replay_and_states_against_a_loop(spark):
    df = spark.createDataFrame(STREAMS, "stream_id string, duration double, nu double, alarm double")
    got = simulate.simulate(df)
    rows = {tuple(r) for r in got.select("stream_id", "frame_idx", F.round("t", 6), "alarmed", "escalated", "evicted", "window_frames", "label").collect()}
    loops = [loop(*s) for s in STREAMS]
    assert rows == {x for l in loops for x in l} and len(rows) > 400
    for col, act in ((F.col("label"), lambda x: x[7]), (F.when(F.col("frame_idx") % 3 == 0, "flag").when(F.col("frame_idx") % 5 == 0, "clear").otherwise("uncovered"), lambda x: "flag" if x[1] % 3 == 0 else "clear" if x[1] % 5 == 0 else "uncovered")):
        st = simulate.states(got, col).select("stream_id", "frame_idx", "action", "event_open", "event_tokens", "n_since_open")
        assert {tuple(r) for r in st.collect()} == {x for l in loops for x in walk(l, act)}
    assert simulate.simulate(df.limit(0)).count() == 0


def test_costs_published_values():
    m = CostModel()
    assert round(m.crossover(), 5) == 0.02534 and math.isclose(m.adaptive(m.crossover()), m.uniform)
    assert CostModel(res="224", window=3).frame_s(3) == 0.4822
    with pytest.raises(ValueError):
        CostModel(window=3)


def test_augmented_policies(spark):
    clauses = [("C1_a", "A"), ("C1_b", "A"), ("C2", "B"), ("C3", "C"), ("C4", "D")]
    df = spark.createDataFrame([(i, "A" if i % 2 else None) for i in range(400)], "k bigint, t string")
    rows = policies.augment(df, clauses, "k", "t").collect()
    ids = [i for r in rows for i in r.ids if i != policies.SAFE_EXIT]
    assert len(set(ids)) > 0.99 * len(ids) and not set(ids) & {c for c, _ in clauses}
    for r in rows:
        assert policies.SAFE_EXIT in r.ids and 4 <= len(r.ids) <= 7 and len(set(r.ids)) == len(r.ids)
        assert (r.target_clause_id in r.ids) == (r.k % 2 == 1 and not r.is_mismatch)
    miss = [r.is_mismatch for r in rows if r.k % 2]
    assert 0.15 < sum(miss) / len(miss) < 0.35 and not any(r.is_mismatch for r in rows if not r.k % 2)
    assert [r.ids for r in rows] == [r.ids for r in policies.augment(df, clauses, "k", "t").collect()]


def test_drafts(spark):
    whole = '{"id": "X1", "category": "c", "title": "t", "text": "w"}'
    df = spark.createDataFrame([(1, whole), (2, '{"id": "X1", "category": "c"}'), (3, "no json"), (4, None)], "k int, answer string")
    got = {r.k: (r.status, r.provenance, r.missing) for r in policies.draft(df, "answer").collect()}
    assert got[1] == ("draft", "generated", "") and got[2] == (None, None, "title,text") and got[3][2] == got[4][2] == "id,category,title,text"


def test_warm_start_is_clipped():
    assert Aci(start=0.2).initial[0] == 0.2 and Aci(start=0.9).initial[0] == 0.5 and Aci(start=0.0).initial[0] == 0.001


def test_numbers_many_at_a_time():
    for key in ("sg2-0000003964", "é", "x" * 60, None):
        for numbers in (range(12), range(99_990, 100_020), range(0)):
            got = u01_many(["skip", 3], key, np.array(numbers, dtype=int))
            assert [g.tolist() for g in got] == [[u(s, *([] if key is None else [key]), i) for i in numbers] for s in ("skip", "3")]


def test_streams_are_dealt_to_all_tasks(spark):
    """Also where an exchange by stream came before, whose few bytes would be one task."""
    df = spark.range(2000).select(F.concat(F.lit("s"), F.col("id") % 500).alias("stream_id")).groupBy("stream_id").agg(F.lit(9.0).alias("duration"), F.lit(None).cast("double").alias("nu"), F.lit(None).cast("double").alias("alarm"))
    assert simulate.simulate(df, columns=["t"]).select(F.spark_partition_id()).distinct().count() >= 12


def test_walks_beside_the_replay_in_small_blocks(spark, monkeypatch):
    moves = lambda x: x.frame_idx * 7 % 4
    df = spark.createDataFrame([*STREAMS, (None, 50.0, None, 20.0), ("f", None, None, 1.0)], "stream_id string, duration double, nu double, alarm double")
    plan = simulate.simulate(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and not any(x in plan for x in ("Window", "Sort", "Join", "Aggregate")), plan  # samples stay where they are made
    cols = ["frame_idx", *(f"{p}.{c}" for p in ("a", "b") for c in ("action", "event_open", "event_tokens", "n_since_open"))]
    rows = simulate.simulate(df, columns=cols, policies={"a": moves, "b": simulate.targets}).collect()
    loops = [loop(*s) for s in STREAMS]
    name = lambda x: simulate.ACTIONS[x[1] * 7 % 4]
    for at, act in ((2, name), (6, lambda x: x[7])):
        assert {(r[0], r[1], *r[at : at + 4]) for r in rows if r[0]} == {x for one in loops for x in walk(one, act)}
    assert sum(r[0] is None for r in rows) > 50 and not any(r[0] == "f" for r in rows)
    with pytest.raises(ValueError, match="no end"):
        list(simulate._replay("a", math.inf, 0.0, 0.0, {}, simulate.Replay()))
    whole = [np.concatenate(v) for v in zip(*[(x.frame_idx, x.t, x.evicted, x.gap, x.walks["w"]["n_since_open"]) for x in simulate._replay("d", 4000.0, 100.0, 300.0, {"w": moves}, simulate.Replay())])]
    monkeypatch.setattr(simulate, "BLOCK", 7)
    parts = [np.concatenate(v) for v in zip(*[(x.frame_idx, x.t, x.evicted, x.gap, x.walks["w"]["n_since_open"]) for x in simulate._replay("d", 4000.0, 100.0, 300.0, {"w": moves}, simulate.Replay())])]
    assert all(np.array_equal(a, b, equal_nan=True) for a, b in zip(whole, parts)) and len(whole[0]) > 10_000


NARROW = [
    "agg28_state_shift",
    "data07_rollout_relabel",
    "join09_teacher_forced",
    "data05_stream_simulator",
    "data08_simulate_many",
    "data06_rollout",
]


@pytest.mark.parametrize("name", NARROW)
def test_samples_are_not_moved_on_the_way(spark, data, name):
    """What is shuffled are frames and outcomes by stream, streams, and counts made where the samples are."""
    plan = catalog.queries()[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Window", "Generate", "Sort")), plan
    assert sum("Join" in x for x in plan.splitlines()) == 1 and "MapInArrow" in plan
