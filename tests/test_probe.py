import numpy as np

from tideline.operators import probe


def test_all_labels_are_fitted_and_scored(spark):
    """Two labels of more than 20,000 rows each; either alone would fill a sample of that size."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(0, 0.1, 4) + (1 if i % 2 else -1)).tolist(), 9 if i % 2 else 0) for i in range(42_000)]
    r = probe.fit_probe(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"), epochs=5).collect()
    assert [(x.n_sequences, x.accuracy) for x in r] == [(2100, 1.0)]


def test_gradient_trains_query_and_temperature():
    rng = np.random.default_rng(1)
    z, y, weight = rng.normal(size=(6, 12, 3)), np.array([0, 1, 1, 0, 1, 0.0]), np.array([1.5, 0.5, 0.5, 1.5, 0.5, 1.5])
    params = np.concatenate([rng.normal(size=7), [0.3]])

    def loss(p):
        v = probe._pool(z, p[:3], p[3:6], p[7], 5)[0] + p[6]
        return (weight * (np.log1p(np.exp(v)) - y * v)).sum()

    want = [(loss(params + h) - loss(params - h)) / 2e-6 for h in np.eye(8) * 1e-6]
    got = probe.gradient(z, y, weight, params, 5)
    assert np.allclose(got, want, atol=1e-4) and np.abs(got[:3]).max() > 0 and got[7] != 0
