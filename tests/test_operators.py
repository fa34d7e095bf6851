import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import bounds, evict, ranking, steps
from tideline.operators.boundary import against, conformal, most_misses
from tideline.operators.leakage_audit import position_test
from tideline.operators.ordered import carry_last, fold, reflected_sum, running, sliding
from tideline.operators.retrieval import top_similar
from tideline.operators.sampling import take_smallest
from tideline.plans.skew import heavy_keys, join_unique, running_total


def series(spark, n=300, streams=3, seed=1):
    rng = random.Random(seed)
    return [(f"s{k}", i, float(i) * 0.5, rng.gauss(0.2, 1.0) if rng.random() > 0.05 else None) for k in range(streams) for i in range(n)]


DDL = "stream_id string, tick bigint, t_s double, score double"


def test_closed_form_equals_fold(spark):
    """The window form in chunks and the step by step form agree while nothing is reset."""
    rows = series(spark)
    df = spark.createDataFrame(rows, DDL).filter("score is not null").withColumn("x", F.col("score") - 0.6)
    got = {(r.stream_id, r.tick): r.stat for r in reflected_sum(df, ["stream_id"], "tick", "x", chunk=16).collect()}
    for k in ("s0", "s1", "s2"):
        s = 0.0
        for _, t, _, v in (r for r in rows if r[0] == k and r[3] is not None):
            s = max(0.0, s + v - 0.6)
            assert math.isclose(got[k, t], s, abs_tol=1e-9)


def test_fold_resets_and_skips_missing(spark):
    rows = series(spark)
    df = spark.createDataFrame(rows, DDL)
    got = fold(df, ["stream_id"], ["tick"], steps.Cusum(threshold=2.0), ["score"], "before double, stat double, alarm boolean").collect()
    assert len(got) == len(rows)
    want, s = {}, None
    for k, t, _, v in rows:
        s = 0.0 if t == 0 else s
        if v is None:
            want[k, t] = (s, False)
            continue
        s = max(0.0, s + v - 0.6)
        a = s >= 2.0
        s = 0.0 if a else s
        want[k, t] = (s, a)
    assert any(a for _, a in want.values())
    for r in got:
        assert math.isclose(r.stat, want[r.stream_id, r.tick][0], abs_tol=1e-9) and r.alarm == want[r.stream_id, r.tick][1]


def test_chunked_windows(spark):
    rows = series(spark, 100, 2)
    df = spark.createDataFrame(rows, DDL)
    got = {(r.stream_id, r.tick): (r.n, r.s) for r in sliding(df, ["stream_id"], "t_s", 7, {"n": lambda w: F.count("*").over(w), "s": lambda w: F.sum("tick").over(w)}).collect()}
    for k, i, t, _ in rows:
        inside = [j for k2, j, t2, _ in rows if k2 == k and t - 7.0 <= t2 <= t]
        assert got[k, i] == (len(inside), sum(inside))
    r = running(df, ["stream_id"], "tick", F.lit(1), "c", chunk=8)
    assert {(x.stream_id, x.tick, x.c) for x in r.collect()} == {(k, i, i + 1) for k, i, _, _ in rows}
    c = carry_last(df, ["stream_id"], "tick", F.when(F.col("tick") % 13 == 5, F.col("tick")), "l", chunk=8)
    for x in c.collect():
        before = [j for j in range(x.tick + 1) if j % 13 == 5]
        assert x.l == (before[-1] if before else None)


def test_aci_moves_up_on_a_miss_and_ignores_silence():
    a = steps.Aci(alpha=0.05, gamma=0.1)
    up, _ = a(a.initial, True)
    down, _ = a(a.initial, False)
    same, _ = a(a.initial, None)
    assert up[0] > 0.05 > down[0] and same[0] == 0.05 and same[1] == 1 and same[2] == 0
    with pytest.raises(ValueError):
        steps.Aci(alpha=1.5)
    s = a.initial
    for _ in range(50):
        s, _ = a(s, True)
    assert s[0] == 0.5 and s[4] > 0


def test_monitor_certifies_and_revokes():
    m = steps.Monitor(alpha=0.3, delta=0.1)
    s, seen = m.initial, []
    for r in [0.0] * 60 + [1.0] * 40:
        s, (_, sure) = m(s, r)
        seen.append(sure)
    assert seen[59] and not seen[-1]


def test_budget_session_context_dedup():
    b = steps.DecodeBudget(cap=2, window_s=10)
    s, ok = b.initial, []
    for t in (0, 1, 2, 10, 11, 12):
        s, (x,) = b(s, float(t))
        ok.append(x)
    assert ok == [True, True, False, True, True, False]
    e = steps.Session()
    s, out = e.initial, []
    for a in ("hold", "flag", "hold", "clear", "clear", "flag", "uncovered"):
        s, x = e(s, a)
        out.append(x)
    assert out == [(False, 0), (True, 0), (True, 0), (False, 1), (False, 1), (True, 1), (True, 1)]
    c = steps.Context(budget=100, window_s=5)
    s = c.initial
    for t, tok, imp in ((0.0, 40, 0.9), (1.0, 40, 0.1), (2.0, 40, 0.5)):
        s, got = c(s, t, tok, imp)
    assert got == (2, 80, 1, True) and [r[0] for r in s[0]] == [0.0, 2.0]
    _, got = c(s, 3.0, 500, 0.5)
    assert got[3] is False
    s, got = c(s, 20.0, 10, None)
    assert got == (1, 10, 3, True)
    d = steps.Dedup(delta=0.1)
    s, kept = d.initial, []
    for v in ([1.0, 0.0], [0.99, 0.141], [0.8, 0.6], [0.79, 0.61]):
        s, (k,) = d(s, v)
        kept.append(k)
    assert kept == [True, False, True, False]


def test_bounds_published_values():
    assert round(bounds.exact_ucb(0, 45, 0.1), 4) == 0.0499
    assert [bounds.min_calibration_n(0.95, miss=m) for m in (0, 1, 2)] == [45, 77, 105]
    assert bounds.min_calibration_n(0.99) == 230
    assert bounds.exact_ucb(5, 5, 0.1) == 1.0 and bounds.exact_ucb(0, 0, 0.1) == 1.0
    assert 0 < bounds.exact_ucb(3000, 1_000_000, 0.1) < 0.0032
    assert math.isclose(bounds.binomial_cdf(2, 5, 0.3), 0.83692, abs_tol=1e-6)


def test_bound_columns(spark):
    r = spark.range(1).select(bounds.hoeffding_ucb(F.lit(0.0), F.lit(45), 0.1).alias("h"), bounds.bernstein_ucb(F.lit(0.0), F.lit(0.0), F.lit(45), 0.1).alias("b"), bounds.bernstein_ucb(F.lit(0.0), F.lit(0.0), F.lit(1), 0.1).alias("b1")).collect()[0]
    assert (round(r.h, 4), round(r.b, 4), r.b1) == (0.1824, 0.1589, 1.0)


def test_betting_against_a_fold(spark):
    """The least final wealth over natural, reversed and hashed orders; a key of one sample is never certified."""
    rng = random.Random(3)
    rows = [("low", i, 0.0 if i % 40 else 0.5) for i in range(300)] + [("high", i, rng.choice([0.0, 1.0])) for i in range(200)] + [("one", 5, 0.0), ("none", 1, None)]
    rows += [("first", i, float(i < 3)) for i in range(120)]
    got = {r.k: (r.n, r.min_wealth, r.certified) for r in bounds.ecrc(spark.createDataFrame(rows, "k string, t bigint, r double"), "k", "t", "r", 0.2, 0.1, orderings=5).collect()}

    def wealth(rs):
        w, seen = 1.0, []
        for r in rs:
            bet = min(0.5, max(0.0, (0.2 - sum(seen) / len(seen)) / 0.16)) if seen else 0.0
            w, seen = w * (1 + bet * (0.2 - r)), [*seen, r]
        return w

    import hashlib

    for key in ("low", "high", "one", "first"):
        xs = [(t, r) for k, t, r in rows if k == key]
        orders = [sorted(xs), sorted(xs, reverse=True)] + [sorted(xs, key=lambda x, o=o: (int(hashlib.md5(f"0:{o}:{key}:{x[0]}".encode()).hexdigest()[:8], 16), x[0])) for o in range(2, 5)]
        least = min(wealth([r for _, r in o]) for o in orders)
        n, w, ok = got[key]
        assert n == len(xs) and math.isclose(w, least, rel_tol=1e-9) and ok == (n > 1 and least >= 10)
    assert "none" not in got and got["low"][2] and not got["one"][2]


def test_bounds_of_fractions_fall_back(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", None), ("b", 0.25), ("b", 0.5)], "k string, r double")
    got = {r.k: r for r in bounds.summary(df, "k", "r", 0.1).collect()}
    assert math.isclose(got["a"].exact, bounds.exact_ucb(1, 2, 0.1)) and got["a"].n == 2
    assert got["b"].exact == got["b"].hoeffding == 0.375 + math.sqrt(math.log(20) / 4)


def test_chunks_hold_a_hot_key(spark):
    """A third of the rows have one key: every result is that of one window, though chunks are short."""
    from pyspark.sql import Window

    from tideline.operators import ordered

    rng = random.Random(9)
    rows = [("hot", i * 3, round(rng.gauss(0, 1), 1)) for i in range(700)] + [(f"k{i % 90}", i, float(i % 7)) for i in range(1400)]
    df = spark.createDataFrame(rows, "k string, t bigint, x double").withColumn("x", F.when(F.col("x") != 0.3, F.col("x")))
    w = Window.partitionBy("k").orderBy("t")
    a = ordered.last_rows(ordered.previous(df, ["k"], "t", F.col("x"), "p", 64), ["k"], "t", 10, {"m": lambda v: F.sum("x").over(v)}, 64)
    b = df.withColumn("p", F.lag("x").over(w)).withColumn("pos", F.row_number().over(w)).withColumn("m", F.sum("x").over(w.rowsBetween(-9, 0)))
    key = lambda r: (r.k, r.t, r.x, r.p, r.pos, None if r.m is None else round(r.m, 6))
    assert sorted(map(str, map(key, a.collect()))) == sorted(map(str, map(key, b.collect())))
    q = {r.k: (r.n, round(r.quantile, 9)) for r in ranking.quantile(df, ["k"], "x", 0.7, 0.5).collect()}
    assert q == {r.k: (r.n, round(r.q, 9)) for r in df.groupBy("k").agg(F.count("x").alias("n"), F.percentile("x", 0.7).alias("q")).collect()}
    for k in (1, 8):
        got = {(r.k, r.t) for r in evict.stride(df, ["k"], "t", k).collect()} | {(r.k, r.t) for r in evict.top(df.fillna(0.3), ["k"], F.col("x"), "t", k).collect()}
        by: dict = {}
        for r in sorted(rows):
            by.setdefault(r[0], []).append(r)
        want = {(r[0], r[1]) for rs in by.values() for r in sorted(rs, key=lambda r: (-r[2], r[1]))[:k]}
        want |= {(rs[int(i)][0], rs[int(i)][1]) for rs in by.values() for i in (np.linspace(0, len(rs) - 1, k).round() if k < len(rs) else range(len(rs)))}
        assert got == want


def test_ranking_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, round(rng.gauss(0, 1), 1), rng.random() < 0.3) for i in range(400)]
    df = spark.createDataFrame(rows, "p bigint, s double, y boolean")
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert math.isclose(ranking.auroc(df, [], "s", F.col("y"), 0.25).collect()[0].auroc, want)
    o = sorted(rows, key=lambda r: (-r[1], r[0]))
    hits, ap = 0, 0.0
    for k, (_, _, y) in enumerate(o, 1):
        hits += y
        ap += hits / k if y else 0
    got = ranking.average_precision(df, [], "s", F.col("y"), ["p"], 0.25).collect()[0].average_precision
    assert math.isclose(got, ap / hits)
    one = df.filter("y")
    assert ranking.auroc(one, [], "s", F.col("y"), 0.25).collect()[0].auroc is None


def test_pareto(spark):
    rng = random.Random(6)
    rows = [(i, rng.uniform(0, 100), rng.randint(0, 50)) for i in range(500)]
    got = {r.k for r in ranking.pareto(spark.createDataFrame(rows, "k bigint, x double, y bigint"), "x", "y", "k", 7.0).collect()}
    want, best = set(), -1
    for k, x, y in sorted(rows, key=lambda r: (r[1], -r[2], r[0])):
        if y > best:
            want.add(k)
            best = y
    assert got == want


def test_coverage_keeps_newest_and_is_greedy(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(40, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([("g", i, [float(x) for x in v[i]]) for i in range(40)] + [("h", 0, [1.0] + [0.0] * 5)], "g string, i bigint, v array<double>")
    got = {r.rank: r.i for r in evict.coverage(df, "g", "i", "v", 5).filter("g = 'g'").collect()}
    kept = [39]
    while len(kept) < 5:
        dist = np.round(1 - v @ v[kept].T, 9).min(1)
        dist[kept] = -1
        kept.append(int(np.argmax(dist)))
    assert [got[k] for k in range(5)] == kept


def test_retrieval_is_exact(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(200, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(200)] + [(500, None)], "k bigint, v array<double>")
    for block in (4096, 3):
        got = {}
        for r in top_similar(df.filter("k % 20 = 0"), df, "k", "v", 3, block=block).collect():
            got.setdefault(r.query_id, []).append((-r.cos, r.k))
        for q in range(0, 200, 20):
            s = np.round(v @ v[q], 6)
            want = sorted((-s[i], i) for i in range(200) if i != q)[:3]
            assert [i for _, i in sorted(got[q])] == [i for _, i in want]


def test_skew_helpers(spark):
    rows = [("hot", i) for i in range(600)] + [(f"k{i}", i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i bigint")
    assert heavy_keys(df, "k", least=100) == ["hot"]
    right = df.select("k").distinct().withColumn("x", F.length("k"))
    j = join_unique(df, right, "k", "inner", heavy=["hot"])
    assert j.count() == 800 and j.filter("k = 'hot' and x = 3").count() == 600
    r = running_total(df, ["k"], F.xxhash64("i"), F.lit(1), "before", buckets=16, tie=["i"])
    assert sorted(x.before for x in r.filter("k = 'hot'").collect()) == list(range(600))


def test_take_smallest(spark):
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("k")).withColumn("u", (F.pmod(F.xxhash64("id"), F.lit(997)) / 997)).withColumn("want", F.lit(100))
    got = take_smallest(df, ["k"], F.col("u"), "want", "id")
    rows = [(r.k, r.u, r.id) for r in df.collect()]
    want = {i for k in range(3) for _, _, i in sorted(r for r in rows if r[0] == k)[:100]}
    assert {r.id for r in got.collect()} == want


def test_conformal(spark):
    assert most_misses(45, 0.95) == 0 and most_misses(44, 0.95) is None and most_misses(77, 0.95) == 1
    rows = [("a", i / 100) for i in range(77)] + [("b", 0.5 + i) for i in range(10)]
    got = {r.k: r for r in conformal(spark.createDataFrame(rows, "k string, s double"), "k", "s", target=0.95).collect()}
    assert (got["a"].tau, got["a"].status, got["a"].n_miss) == (0.01, "CALIBRATED", 1)
    assert (got["b"].tau, got["b"].status) == (0.5, "ESTIMATED")


def test_position_test():
    same = {b: (50, 50) for b in range(10)}
    skewed = {b: (50, 5 if b < 5 else 95) for b in range(10)}
    assert position_test(same)[1] > 0.5 and position_test(skewed)[1] < 0.01
    assert position_test({0: (0, 5)}) == (0.0, 1.0)


def test_references_in_blocks(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 4)) / 4
    df = spark.createDataFrame([(i, [float(x) for x in v[i]], 1.0 if i % 2 else -1.0) for i in range(60)], "k bigint, v array<double>, y double")
    refs = df.filter("k < 20")
    cos = v @ v[:20].T
    y = np.array([1.0 if i % 2 else -1.0 for i in range(20)])
    for block in (4096, 6):
        for r in against(df, refs, "k", "v", "y", block).collect():
            assert math.isclose(r.cache, (np.exp(-5 * (1 - cos[r.k])) * y).mean(), abs_tol=1e-9) and math.isclose(r.ood, min(1, max(0, 1 - cos[r.k].max())), abs_tol=1e-9)
    assert against(df, refs.limit(0), "k", "v", "y").filter("ood = 0 and cache is null").count() == 60


def test_coverage_of_known_vectors_and_agreement_with_each_policy(spark, monkeypatch):
    """Centres of rows that name their vector are those of rows that carry it, in groups walked at once and in groups by rounds; what is
    kept at all budgets together is what each policy keeps by itself."""
    import numpy as np

    from tideline.operators import evict

    v = spark.createDataFrame([(i, [float(x) for x in np.random.default_rng(i).normal(size=6)]) for i in range(11)], "vec_id bigint, v array<double>")
    ids = spark.range(900).select(F.when(F.col("id") < 300, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 70)).alias("key"), F.col("id").alias("tick"), (F.col("id") * 7 % 11).alias("vec_id"), (F.col("id") * 37 % 101 / 50).alias("score"), (F.col("id") % 7 == 0).alias("keyframe"), (F.col("id") / 3).alias("t_s"))
    ids = ids.unionByName(ids.limit(3).withColumn("key", F.lit("short")))
    known, rows = evict.Known.of(v, "vec_id", "v"), ids.join(v, "vec_id").localCheckpoint()
    want = {tuple(r) for r in evict.coverage(rows, "key", "tick", "v", 5).collect()}
    for group in (1 << 22, 100):
        monkeypatch.setattr(evict, "GROUP", group)
        assert {tuple(r) for r in evict.coverage_of_known(ids, ["key"], "tick", "vec_id", known, 5).collect()} == want
    cols = evict.Columns(vector="vec_id", known=known)
    got = {tuple(r) for r in evict.kept(ids, ["key"], "tick", [2, 5], list(evict.POLICIES), cols).select("policy", "keep", "key", "tick").collect()}
    for name, policy in evict.POLICIES.items():
        for k in (2, 5):
            one = policy(rows, ["key"], "tick", k).select("key", "tick").collect()
            assert {(name, k, *r) for r in one} == {x for x in got if x[:2] == (name, k)}, (name, k)
    assert evict.Known.of(v.union(v), "vec_id", "v") is None
    plan = evict.kept(ids, ["key"], "tick", [2, 5], ["coverage"], cols)._jdf.queryExecution().optimizedPlan().toString()
    assert "array<double>" not in plan and "Join" not in plan
