"""Fitting the rolling probe."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.ordered import running
from tideline.session import cut_lineage

#: Sequences worked on at a time within a task.
SLICE = 512


def _pool(z: np.ndarray, q: np.ndarray, w: np.ndarray, log_temp: float, window: int) -> tuple[np.ndarray, ...]:
    """For sequences (n, length, d): largest pooled value, and of the window that attains it the attention, logits, values, vectors."""
    wide = min(window, z.shape[1])
    cut = lambda x: np.lib.stride_tricks.sliding_window_view(x, wide, axis=1)
    s, v = cut(np.exp(log_temp) * (z @ q) / np.sqrt(z.shape[2])), cut(z @ w)
    a = np.exp(s - s.max(-1, keepdims=True))
    a /= a.sum(-1, keepdims=True)
    vals = (a * v).sum(-1)
    t, n = vals.argmax(1), np.arange(len(z))
    return vals[n, t], a[n, t], s[n, t], v[n, t], z[n[:, None], t[:, None] + np.arange(wide)]


def gradient(z: np.ndarray, y: np.ndarray, weight: np.ndarray, params: np.ndarray, window: int) -> np.ndarray:
    """Sum over sequences of the weighted loss's gradient by q, w, b and log temperature, through the best window only."""
    d = z.shape[2]
    q, w, b, temp = params[:d], params[d : 2 * d], params[2 * d], params[2 * d + 1]
    val, a, s, v, rows = _pool(z, q, w, temp, window)
    g = (1 / (1 + np.exp(-np.clip(val + b, -30, 30))) - y) * weight
    coef = g[:, None] * a * (v - val[:, None])
    gq = np.exp(temp) * np.einsum("nk,nkd->d", coef, rows) / np.sqrt(d)
    return np.concatenate([gq, np.einsum("n,nk,nkd->d", g, a, rows), [g.sum(), (coef * s).sum()]])


def _summed(seqs: DataFrame, length: int, what: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """``what`` summed over all sequences; one short row a task comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                b = batch.slice(at, SLICE)
                z = b.column("z").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, length, -1)
                x = what(z, b.column("y").to_numpy(zero_copy_only=False).astype(float))
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], names=["x"])

    return np.sum(sorted(r.x for r in seqs.mapInArrow(run, "x array<double>").collect()), axis=0)


def fit_probe(embeddings: DataFrame, window: int = 5, epochs: int = 40, rate: float = 0.2, length: int = 20) -> DataFrame:
    """One row: number of sequences, accuracy over them and the length of the weights. Sequences are runs of ``length`` vectors of one
    label. Every epoch reads all sequences; query, weights, bias and temperature are trained (row T31)."""
    spark = embeddings.sparkSession
    rows = embeddings.select("label", "vec_id", "embedding").filter("label is not null and vec_id is not null and embedding is not null")
    rows = running(rows, ["label"], "vec_id", F.lit(1), "n").withColumn("run", F.floor((F.col("n") - 1) / length))
    seqs = rows.groupBy("label", "run").agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("g")).filter(F.size("g") == length)
    seqs = cut_lineage(seqs.select((F.col("label") > 4).cast("int").alias("y"), F.flatten("g.embedding").alias("z")))
    r = seqs.agg(F.count("*").alias("n"), F.sum("y").alias("pos"), F.max(F.size("z")).alias("d")).collect()[0]
    ddl = "n_sequences bigint, accuracy double, weight_norm double"
    if not r.n:
        return spark.createDataFrame([(0, None, 0.0)], ddl)
    n, d = r.n, r.d // length
    of = np.array([n / (2 * max(1, n - r.pos)), n / (2 * max(1, r.pos))])
    # As in the reference: a small query, so that both it and the temperature have a gradient, and a temperature for unit vectors.
    params = np.concatenate([np.random.default_rng(0).normal(0, 0.02, d), np.zeros(d + 1), [3.0]])
    decay = np.concatenate([np.full(2 * d, 1e-3), [0.0, 0.0]])
    for _ in range(epochs):
        now = params
        g = _summed(seqs, length, lambda z, y: gradient(z, y, of[y.astype(int)], now, window))
        params = now - rate * (g / n + decay * now)
        params[-1] = np.clip(params[-1], -10.0, 10.0)
    q, w, b, temp = params[:d], params[d : 2 * d], params[2 * d], params[2 * d + 1]
    hits = _summed(seqs, length, lambda z, y: np.array([((_pool(z, q, w, temp, window)[0] + b > 0) == (y > 0)).sum()], float))[0]
    return spark.createDataFrame([(n, round(float(hits) / n, 6), round(float(np.linalg.norm(w)), 6))], ddl)
