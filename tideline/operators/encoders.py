"""Encoders that need no model: histograms and random projections of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histogram(v: Column, lo: float, hi: float, bins: int = 8) -> Column:
    """Shares of the values per bin, the outer bins open; null for an empty vector."""
    at = lambda x: F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((x - lo) / (hi - lo) * bins)))
    share = lambda b: F.size(F.filter(v, lambda x: at(x) == b)) / F.size(v)
    return F.when(F.size(v) > 0, F.array(*[share(b) for b in range(bins)]))


def random_projection(df: DataFrame, key: str, vector: str, dim: int = 16, seed: int = 0) -> DataFrame:
    """``key``, code: unit vectors of ``dim`` Gaussian projections; the matrix is made from the seed in every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mat = None
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(1)
            m = v.values.to_numpy(zero_copy_only=False).astype(np.float64)[v.offsets[0].as_py() : v.offsets[-1].as_py()].reshape(b.num_rows, -1)
            if mat is None:
                mat = np.random.default_rng(seed).normal(size=(m.shape[1], dim)) / np.sqrt(dim)
            p = m @ mat
            p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
            off = np.arange(0, (b.num_rows + 1) * dim, dim, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(off, pa.array(p.reshape(-1)))], names=[key, "code"])

    return df.select(F.col(key).cast("bigint"), vector).filter(F.col(vector).isNotNull()).mapInArrow(run, f"{key} bigint, code array<double>")
