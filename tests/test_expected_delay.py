"""Means that lie right between two values of four digits are rounded up whatever binary sums make of them."""

from decimal import ROUND_HALF_UP, Decimal

from tideline.plans import catalog


def test_means_halfway_between_two_values(spark, tmp_path):
    half_up = lambda x: float(x.quantize(Decimal("0.0001"), ROUND_HALF_UP))
    pairs = [(a / 10000, (a + d) / 10000) for a in range(1, 3000, 7) for d in (1, 3)]
    exact = [half_up((Decimal(repr(a)) + Decimal(repr(b))) / 2) for a, b in pairs]
    assert any(half_up(Decimal(repr((a + b) / 2))) != e for (a, b), e in zip(pairs, exact))  # two terms have one order
    rows = [(f"s{i}", t, float(t), x, 2.0) for i, (a, b) in enumerate(pairs) for t, x in enumerate((a, b, 1.0, 1e300))]
    spark.createDataFrame(rows, "stream_id string, tick bigint, t_s double, score double, nu_s double").write.parquet(f"{tmp_path}/frames.parquet")
    got = {r.stream_id: (r.mu0, r.mu1) for r in catalog.queries()["stream04_expected_delay"](spark, str(tmp_path)).collect()}
    assert got == {f"s{i}": (e, 5e299) for i, e in enumerate(exact)}
