"""Small clips for the tests; every column is there, most are null."""

from __future__ import annotations

from datetime import datetime

from tideline.schemas import CLIP

SHA = "0123456789abcdef" * 4


def clip(id, split="train", cuts=None, host=None, sha=None, title=None, description=None, provenance="a", safe=None, categories=None, bins=None, at=datetime(2025, 1, 1), pool="eval"):
    b = bins or {}
    splice = None if cuts is None and host is None else (host, len(cuts or []), [(float(i), "benign", c) for i, c in enumerate(cuts or [])], 40, -23.0, True)
    return (
        id,
        ("synthetic", provenance, None, None, None),
        (None, None, None, None, sha, None),
        (safe, categories, []),
        ((None, None, None, b.get("temporal_sparsity")), (None, None, None, None, b.get("perceptual_subtlety")), (None, None, b.get("modality_locus")), (None, None, b.get("context_dependence"))),
        (title, description, None, None, None),
        splice,
        split,
        pool,
        "temporal",
        None,
        at,
    )


def clips(spark, rows):
    """With extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, CLIP)
    return df.withColumn("sid", F.lit(1)).withColumn("role", F.lit("x")).withColumn("n", F.lit(2)).withColumn("_row", F.lit(3)).withColumn("grp", F.lit(4)).withColumn("value", F.lit("v"))


def null_clip():
    return (None,) * 12
