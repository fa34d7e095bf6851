"""Vectors as arrays, in expressions the JVM evaluates; numpy blocks only where whole matrices meet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2(v: Column) -> Column:
    """Unit length; vectors shorter than 1e-12 keep their direction and stay short."""
    return F.transform(v, lambda x: x / F.greatest(norm(v), F.lit(1e-12)))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-clip(z, -30.0, 30.0)))
