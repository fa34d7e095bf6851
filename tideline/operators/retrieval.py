"""Nearest vectors for a stated query set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries go out in blocks of at most so many vectors.
BLOCK = 4096


def top_similar(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, block: int = BLOCK) -> DataFrame:
    """query_id, ``key``, cos: the k rows with the largest dot product for every query, itself left out; ties by key.

    Queries are broadcast in blocks of bounded size; each task keeps the k best of its rows per query, so what is shuffled is
    tasks times queries times k and never a pair per row. Null vectors are left out.
    """
    q = queries.select(key, vector).filter(F.col(vector).isNotNull())
    n = q.count()
    spark, blocks = rows.sparkSession, max(1, -(-n // block))
    out = None
    for i in range(blocks):
        part = q.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == i).collect()
        if not part:
            continue
        ids = np.array([r[0] for r in part])
        mat = np.array([r[1] for r in part], dtype=np.float64)
        shared = spark.sparkContext.broadcast((ids, mat))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qi, qm = shared.value
            keep: list[list[tuple]] = [[] for _ in qi]
            for b in batches:
                if not b.num_rows:
                    continue
                v = b.column(1)
                m = v.values.to_numpy(zero_copy_only=False).astype(np.float64)[v.offsets[0].as_py() : v.offsets[-1].as_py()].reshape(b.num_rows, -1)
                own = b.column(0).to_numpy()
                sim = np.round(qm @ m.T, 6)
                for j in range(len(qi)):
                    s = sim[j].copy()
                    s[own == qi[j]] = -np.inf
                    # All that are as near as the k-th, then in order: the rest of the batch is never sorted.
                    near = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k]) if len(s) > k else np.arange(len(s))
                    top = near[np.lexsort((own[near], -s[near]))[:k]]
                    keep[j] = sorted([*keep[j], *((-float(s[t]), int(own[t])) for t in top if np.isfinite(s[t]))])[:k]
            flat = [(int(qi[j]), i, -c) for j, best_ in enumerate(keep) for c, i in best_]
            if flat:
                a, b_, c = zip(*flat)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b_, pa.int64()), pa.array(c, pa.float64())], names=["query_id", key, "cos"])

        one = rows.select(F.col(key).cast("bigint"), vector).filter(F.col(vector).isNotNull()).mapInArrow(best, f"query_id bigint, {key} bigint, cos double")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], f"query_id bigint, {key} bigint, cos double")
    w = Window.partitionBy("query_id").orderBy(F.desc("cos"), key)
    return out.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")
