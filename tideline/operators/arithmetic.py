"""Closed forms that need no table: costs, rates, guards, regimes."""

from __future__ import annotations

import math

# Whether the adaptive level can be used, by what feedback comes back.
ACI_REGIMES = {"full": True, "audited": True, "emitted_only": False, "none": False}


def crossover(uniform: float, sentinel: float, audit_rate: float, audit: float, midtier: float, share_up: float, frontier: float) -> float:
    """Escalation rate at which the cascade costs as much as looking everywhere; below zero it never pays."""
    per = midtier + share_up * frontier
    if per <= 0:
        raise ValueError("an escalation must cost something")
    return (uniform - sentinel - audit_rate * audit) / per


def abstention_floor(mean_risk: float, alpha: float, worst: float = 1.0) -> float:
    if not alpha < worst <= 1:
        raise ValueError("alpha < worst <= 1")
    return max(0.0, (mean_risk - alpha) / (worst - alpha))


def respects_floor(abstention: float, floor: float) -> bool:
    return abstention >= floor - 1e-9


def implied_escalation(overall: float, fast: float, slow: float) -> float:
    r = (overall - fast) / slow
    if not 0 <= r <= 1:
        raise ValueError("the times do not fit a serial cascade")
    return r


def streams_to_fill(batch: int, fps: float, deadline_s: float) -> int:
    return math.ceil(batch / (fps * deadline_s))


def min_batch(rate: float, seconds_per_batch) -> int:
    """The smallest batch of the table {size: seconds} that keeps up with ``rate`` rows a second."""
    for size in sorted(seconds_per_batch):
        if size / seconds_per_batch[size] >= rate:
            return size
    raise ValueError("no measured batch keeps up")


def break_even_precision(alpha: float, beta: float, gamma: float) -> float:
    return (beta - alpha) / (gamma + beta)
