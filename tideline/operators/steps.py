"""Step functions of the sequential operators. Batch folds and streaming processors call the same ones, so they cannot differ.

Each takes the state (a tuple) and a row's values and returns the new state and the row's output.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass


@dataclass(frozen=True)
class Cusum:
    threshold: float = 5.0
    drift: float = 0.1
    mu0: float = 0.0
    mu1: float = 1.0
    sigma: float = 1.0

    def __post_init__(self) -> None:
        if self.sigma <= 0 or self.mu1 <= self.mu0 or self.threshold <= 0:
            raise ValueError("sigma and threshold must be positive, mu1 above mu0")

    initial = (0.0, 0)

    def __call__(self, state: tuple, score: float | None) -> tuple[tuple, tuple]:
        """State: statistic, alarms so far. Output: statistic before a reset, after it, alarm."""
        s, n = state
        if score is None or score != score:
            return state, (None, s, False)
        llr = ((self.mu1 - self.mu0) * score - 0.5 * (self.mu1**2 - self.mu0**2)) / self.sigma**2
        s = max(0.0, s + llr - self.drift)
        alarm = s >= self.threshold
        return (0.0 if alarm else s, n + alarm), (s, 0.0 if alarm else s, alarm)


@dataclass(frozen=True)
class Aci:
    """Adaptive conformal level: a miss moves it up by gamma * (1 - alpha), a hit down by gamma * alpha; no feedback, no move."""

    alpha: float = 0.05
    gamma: float = 0.002
    lo: float = 0.001
    hi: float = 0.5
    #: Level at the start (row T14): the target itself, or what an offline calibration gave.
    start: float | None = None

    def __post_init__(self) -> None:
        if not (0 < self.alpha < 1 and self.gamma > 0 and 0 < self.lo < self.hi < 1):
            raise ValueError("alpha must be within (0, 1), gamma positive, 0 < lo < hi < 1")

    @property
    def initial(self) -> tuple:
        return (self.alpha if self.start is None else min(self.hi, max(self.lo, self.start)), 0, 0, 0, 0)

    def __call__(self, state: tuple, err: bool | None) -> tuple[tuple, tuple]:
        """State: level, ticks, feedbacks, errors, clipped. Output: level."""
        a, t, n, e, c = state
        if err is None or err != err:
            return (a, t + 1, n, e, c), (a,)
        want = a + self.gamma * (float(err) - self.alpha)
        a = min(self.hi, max(self.lo, want))
        return (a, t + 1, n + 1, e + int(bool(err)), c + (a != want)), (a,)


@dataclass(frozen=True)
class DtAci:
    """Adaptive levels of several rates; each weighs exp(-eta * its mean of |level - error| over the last ``window`` feedbacks)."""

    alpha: float = 0.05
    gammas: tuple[float, ...] = (0.005, 0.02, 0.08, 0.32)
    eta: float = 2.0
    window: int = 200
    start: float | None = None

    @property
    def initial(self) -> tuple:
        return (tuple(Aci(self.alpha, g, start=self.start).initial for g in self.gammas), tuple(deque(maxlen=self.window) for _ in self.gammas))

    def __call__(self, state: tuple, err: bool | None) -> tuple[tuple, tuple]:
        """State: those of the experts, their last losses. Output: mixed level."""
        experts, recent = state
        stepped = [Aci(self.alpha, g)(x, err) for g, x in zip(self.gammas, experts)]
        levels = [out[0] for _, out in stepped]
        if err is not None and err == err:
            for r, a in zip(recent, levels):
                r.append(abs(a - float(err)))
        losses = [sum(r) / len(r) if r else 0.0 for r in recent]
        w = [math.exp(-self.eta * (x - min(losses))) for x in losses]
        return (tuple(x for x, _ in stepped), recent), (sum(x * a for x, a in zip(w, levels)) / sum(w),)


@dataclass(frozen=True)
class DecodeBudget:
    """At most cap decodes per window; a window starts with the first row at or past the end of the last one."""

    cap: int = 90
    window_s: float = 60.0
    initial = (None, 0)

    def __call__(self, state: tuple, t: float) -> tuple[tuple, tuple]:
        start, used = state
        if start is None or t - start >= self.window_s:
            start, used = t, 0
        ok = used < self.cap
        return (start, used + ok), (ok,)


@dataclass(frozen=True)
class Session:
    """flag opens an event, clear closes the open one; other actions leave it."""

    initial = (False, 0)

    def __call__(self, state: tuple, action: str | None) -> tuple[tuple, tuple]:
        is_open, k = state
        if action == "flag":
            is_open = True
        elif action == "clear" and is_open:
            is_open, k = False, k + 1
        return (is_open, k), (is_open, k)


@dataclass(frozen=True)
class Monitor:
    """Anytime-valid risk monitor of one threshold: a bet against 'risk above alpha', certified when wealth reaches 1/delta,
    revoked when it has lost half of its peak."""

    alpha: float = 0.05
    delta: float = 0.1
    recent: int = 200
    revoke: float = 0.5
    initial = (0, 0, (), 1.0, 1.0, False)

    def __call__(self, state: tuple, risk: float | None) -> tuple[tuple, tuple]:
        """State: n, n_risk, recent risks, wealth, peak, certified. Output: wealth, certified."""
        n, k, last, wealth, peak, sure = state
        if risk is None or risk != risk:
            return state, (wealth, sure)
        n += 1
        k += int(risk > 0.5)
        last = (*last, risk)[-self.recent :]
        a = self.alpha
        bet = 0.0 if n <= 1 else min(0.5, max(0.0, (a - sum(last) / len(last)) / max(a * (1 - a), 1e-6)))
        wealth = max(0.0, wealth * (1 + bet * (a - risk)))
        if wealth >= 1 / self.delta:
            sure, peak = True, max(peak, wealth)
        if sure and wealth < peak * self.revoke:
            sure, wealth, peak = False, 1.0, 1.0
        return (n, k, last, wealth, peak, sure), (wealth, sure)


@dataclass(frozen=True)
class Context:
    """Bounded context of one stream: rows older than window_s leave first, then, over the token budget, those of least
    importance (never the newest; the oldest where any importance is unknown)."""

    budget: int = 4096
    window_s: float = 16.0
    initial = ((), 0)

    def __call__(self, state: tuple, t: float, tokens: int, importance: float | None) -> tuple[tuple, tuple]:
        """State: rows (t, tokens, importance), evicted. Output: rows held, tokens held, evicted so far, fits."""
        rows, gone = state
        if tokens > self.budget:
            return state, (len(rows), sum(r[1] for r in rows), gone, False)
        rows = (*rows, (t, tokens, importance))
        kept = tuple(r for r in rows if not t - r[0] > self.window_s)
        gone += len(rows) - len(kept)
        held = sum(r[1] for r in kept)
        while held > self.budget:
            known = all(r[2] is not None and r[2] == r[2] for r in kept)
            k = min(range(len(kept) - 1), key=lambda i: (kept[i][2], i)) if known else 0
            held -= kept[k][1]
            kept, gone = kept[:k] + kept[k + 1 :], gone + 1
        return (kept, gone), (len(kept), held, gone, True)


@dataclass(frozen=True)
class Dedup:
    """Skip a vector whose cosine with the last kept one is above 1 - delta."""

    delta: float = 0.02
    initial = (None,)

    def __call__(self, state: tuple, v: list[float]) -> tuple[tuple, tuple]:
        last = state[0]
        if last is not None and sum(x * y for x, y in zip(v, last)) > 1 - self.delta:
            return state, (False,)
        return (tuple(v),), (True,)
