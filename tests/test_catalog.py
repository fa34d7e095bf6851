"""Every query of the core against its SQL, on the smallest tables; those without SQL against brute force."""

import math

import duckdb
import numpy as np
import pytest

from tideline.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings clips frames stream_outcomes annotations policy_clauses eval_items sample_targets split_targets mix_targets".split()


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def test_names():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and len(catalog.queries()) > 80


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, data, duck, name):
    df = catalog.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
    if name in catalog.oracle_sql():
        r = duck.sql(catalog.oracle_sql()[name])
        assert sorted(r.columns) == cols
        at = [r.columns.index(c) for c in cols]
        assert got == sorted(tuple(cell(x[i]) for i in at) for x in r.fetchall())
    else:
        BRUTE[name](spark, data, duck, [r.asDict() for r in df.collect()])


def _positions(duck):
    return np.array(duck.sql(catalog.oracle_sql()["valid04_cut_positions"] + " ORDER BY bin").fetchall(), int)


def _position_test(spark, data, duck, rows):
    """Labels shuffled one by one over the cuts."""
    p = _positions(duck)
    bins, labels = np.repeat(p[:, 0], p[:, 1] + p[:, 2]), np.concatenate([np.repeat([1, 0], [a, b]) for _, a, b in p])
    tvd = lambda y: 0.5 * np.abs(np.bincount(bins[y == 1], minlength=10) / (y == 1).sum() - np.bincount(bins[y == 0], minlength=10) / (y == 0).sum()).sum()
    rng = np.random.default_rng(1)
    null = np.mean([tvd(rng.permutation(labels)) >= tvd(labels) for _ in range(500)])
    (r,) = rows
    assert abs(r["tvd"] - tvd(labels)) < 1e-6 and abs(r["p"] - null) < 0.1


def _findings(spark, data, duck, rows):
    """All checks put together from the SQL of each."""
    sql = catalog.oracle_sql()
    n = lambda q, where: duck.sql(f"SELECT count(*) FROM ({sql[q]}) WHERE {where}").fetchall()[0][0]
    want = {("error", "schema:" + e): c for e, c in duck.sql(f"SELECT first_error, count(*) FROM ({sql['valid01_record_schema']}) WHERE first_error IS NOT NULL GROUP BY 1").fetchall()}
    for level, check, q, where in (("error", "pool_disjoint", "valid02_pool_disjoint", "n_pools > 1"), ("error", "splice_balanced", "valid03_splice_balanced", "unbalanced"), ("warn", "calib_sample_size", "valid05_calibration_size", "too_few"), ("warn", "axis_coverage", "valid06_axis_coverage", "thin")):
        if c := n(q, where):
            want[level, check] = c
    finding = catalog.queries()["valid04_permutation_test"](spark, data).collect()[0].finding
    if finding in ("error", "warn"):
        want[finding, "cut_position_leakage"] = 1
    assert {(r["level"], r["check"]): r["n"] for r in rows} == want


def _audit(spark, data, duck, rows):
    (r,) = rows
    n, safe = duck.sql("SELECT count(*), count(*) FILTER (safe) FROM (SELECT id, arg_max(label.safe, ingested_at) AS safe FROM clips WHERE id IS NOT NULL GROUP BY id) WHERE safe IS NOT NULL").fetchall()[0]
    assert r["n"] == n and abs(r["majority"] - max(safe, n - safe) / n) < 1e-6
    assert 0.3 < r["auc"] < 1 and len(r["top_features"]) == 3 and r["leaked"] == (r["p"] < 0.05 and r["auc"] > 0.5)


def _embeddings(data):
    return duckdb.sql(f"SELECT vec_id, label, embedding::DOUBLE[] AS v FROM '{data}/embeddings.parquet'").fetchall()


def _logistic(spark, data, duck, rows):
    """Gradient descent over the same rows separates them about as well."""
    e = _embeddings(data)
    x, y = np.array([r[2] for r in e]), np.array([r[1] < 5 for r in e], float)
    w, b, k = np.zeros(x.shape[1]), 0.0, np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(2000):
        g = k * (1 / (1 + np.exp(-(x @ w + b))) - y)
        w, b = w - 2.0 * (x.T @ g / len(y) + 0.01 * w), b - 2.0 * g.mean()
    s = x @ w
    auc = np.mean([(s[y == 1][:, None] > s[y == 0][None]).mean()])
    assert abs(rows[0]["auroc"] - auc) < 0.03


def _projection(spark, data, duck, rows):
    e = _embeddings(data)
    p = np.array([x[2] for x in e]) @ (np.random.default_rng(0).normal(size=(len(e[0][2]), 16)) / 4)
    want = {x[0]: v for x, v in zip(e, p[:, 0] / np.linalg.norm(p, axis=1))}
    assert {r["vec_id"] for r in rows} == set(want) and all(abs(r["first_"] - want[r["vec_id"]]) < 1e-5 and r["dim"] == 16 for r in rows)


def _induction(spark, data, duck, rows):
    """Rounds in order, F1 within bounds, the best one marked; words join one by one."""
    rows = sorted(rows, key=lambda r: r["round"])
    assert [r["round"] for r in rows] == list(range(len(rows))) and all(0 <= r["dev_f1"] <= 1 for r in rows)
    assert all(b["words"].startswith(a["words"] + ",") for a, b in zip(rows, rows[1:]))
    assert [r["best"] for r in rows] == [r["dev_f1"] == max(x["dev_f1"] for x in rows) for r in rows]


def _probe(spark, data, duck, rows):
    """Runs of 20 vectors of a label (the fit itself is tested in test_probe)."""
    n = sum(c // 20 for (c,) in duck.sql("SELECT count(*) FROM embeddings GROUP BY label").fetchall())
    assert rows[0]["n_sequences"] == n and (rows[0]["accuracy"] is None or 0 <= rows[0]["accuracy"] <= 1)


def _fusion(spark, data, duck, rows):
    """Streams of one side only, and a ranking that is better than chance."""
    (r,) = rows
    n = duck.sql("SELECT count(*) FROM (SELECT DISTINCT stream_id, tick FROM frames WHERE score IS NOT NULL)").fetchall()[0][0]
    assert r["n_train"] + r["n_held"] == n and (r["average_precision"] is None or r["average_precision"] > r["share"])


BRUTE = {
    "bound07_fusion_head": _fusion,
    "valid04_permutation_test": _position_test,
    "valid07_findings": _findings,
    "valid08_codec_audit": _audit,
    "bound03_logistic_head": _logistic,
    "proj32_random_projection": _projection,
    "data15_induction_rounds": _induction,
    "stream31_probe_fit": _probe,
}
