"""Scores and uncertainties of single frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.functions.vectors import clip


@dataclass(frozen=True)
class Router:
    """Settings of the competence route."""

    tau: float = 0.0
    margin: float = 1.0
    ood_weight: float = 0.6
    voi: float = 0.25
    band: float = 0.4
    ood_limit: float = 0.15
    alarm_boost: float = 0.3
    can_decide_unsafe: bool = False


def channel_sum(channels: Column) -> Column:
    """Sum over the channels in the order of their names; null if there are none."""
    keys = F.array_sort(F.map_keys(channels))
    return F.when(F.size(keys) > 0, F.aggregate(keys, F.lit(0.0), lambda s, k: s + F.coalesce(channels[k], F.lit(0.0))))


def text_score(text: Column) -> Column:
    return F.least(F.coalesce(F.length(text), F.lit(0)) / 500.0, F.lit(1.0))


def codec_score(sizes: Column) -> Column:
    """Mean of the first codec feature less one, within [-3, 3]; 0 if there is none."""
    n = F.size(sizes)
    mean = F.aggregate(sizes, F.lit(0.0), lambda s, x: s + x) / n
    return F.when(sizes.isNull() | (n == 0), 0.0).otherwise(clip(mean - 1, -3.0, 3.0))


def llr(score: Column, mu0: float = 0.0, mu1: float = 1.0, sigma: float = 1.0) -> Column:
    """Log likelihood ratio of two Gaussians with one deviation."""
    if sigma <= 0 or mu1 <= mu0:
        raise ValueError("sigma must be positive and mu1 above mu0")
    return ((mu1 - mu0) * score - 0.5 * (mu1**2 - mu0**2)) / sigma**2


def boundary_uncertainty(score: Column, r: Router = Router()) -> Column:
    z = F.abs(score - r.tau) / max(r.margin, 1e-9)
    return F.exp(-(z * z))


def uncertainty(score: Column, ood: Column, disagreement: Column | None = None, r: Router = Router()) -> Column:
    other = F.coalesce(ood, F.lit(0.0)) if disagreement is None else F.greatest(F.coalesce(ood, F.lit(0.0)), F.coalesce(disagreement, F.lit(0.0)))
    return F.least(F.lit(1.0), (1 - r.ood_weight) * boundary_uncertainty(score, r) + r.ood_weight * other)


def voi(u: Column, b: Column) -> Column:
    """Value of asking a stronger model."""
    return u * F.sqrt(b) + 0.5 * u


def route(score: Column, ood: Column, forced: Column, alarmed: Column, r: Router = Router(), disagreement: Column | None = None) -> Column:
    """forced, escalate, decide_unsafe or decide_safe; null if the score is."""
    b = boundary_uncertainty(score, r)
    u = uncertainty(score, ood, disagreement, r)
    u = F.when(alarmed, F.least(F.lit(1.0), u + r.alarm_boost)).otherwise(u)
    o = F.coalesce(ood, F.lit(0.0))
    unsafe = F.lit("decide_unsafe" if r.can_decide_unsafe else "escalate")
    return (
        F.when(score.isNull(), F.lit(None))
        .when(forced, "forced")
        .when(voi(u, b) >= r.voi, "escalate")
        .when(score >= r.tau + r.band, unsafe)
        .when(score <= r.tau - r.band, F.when(o >= r.ood_limit, "escalate").otherwise("decide_safe"))
        .when(score >= r.tau, unsafe)
        .when(o >= r.ood_limit, "escalate")
        .otherwise("decide_safe")
    )
