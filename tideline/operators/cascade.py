"""The whole cascade of one stream as one fold: detector, route, session, audit."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import protocol
from tideline.functions.scores import Router
from tideline.operators.ordered import fold
from tideline.operators.steps import Aci, Cusum, Session
from tideline.rng import u01


@dataclass(frozen=True)
class Cascade:
    cusum: Cusum = field(default_factory=Cusum)
    router: Router = field(default_factory=Router)
    aci: Aci = field(default_factory=Aci)
    session: Session = field(default_factory=Session)

    @property
    def initial(self) -> tuple:
        return (self.cusum.initial, self.session.initial, self.aci.initial)

    def route(self, score: float, ood: float, forced: bool, alarmed: bool) -> str:
        r = self.router
        b = math.exp(-(((score - r.tau) / max(r.margin, 1e-9)) ** 2))
        u = min(1.0, (1 - r.ood_weight) * b + r.ood_weight * ood)
        if alarmed:
            u = min(1.0, u + r.alarm_boost)
        if forced:
            return "forced"
        if u * math.sqrt(b) + 0.5 * u >= r.voi:
            return "escalate"
        if score >= r.tau:
            return "decide_unsafe" if r.can_decide_unsafe else "escalate"
        return "escalate" if ood >= r.ood_limit else "decide_safe"

    def __call__(self, state: tuple, t: float, score: float | None, ood: float | None, action: str | None, nu: float | None, forced: bool, audited: bool) -> tuple[tuple, tuple]:
        """An audited tick of a stream whose change is known is a miss if it is past the change and was not flagged."""
        c, s, a = state
        c, (before, _, alarm) = self.cusum(c, score)
        route = "hold" if score is None else self.route(score, ood or 0.0, forced, alarm)
        seen = action if route in ("forced", "escalate", "decide_unsafe") else None
        s, (is_open, k) = self.session(s, seen)
        err = t >= nu and seen != "flag" if audited and nu is not None else None
        a, (alpha,) = self.aci(a, err)
        return (c, s, a), (before, alarm, route, seen, is_open, k, alpha)


def run_cascade(frames: DataFrame, cascade: Cascade = Cascade(), rho: float = 0.02, epsilon: float = 0.5) -> DataFrame:
    """A row per tick: stat_before_reset, alarm, route, action seen, session state, level. Draws are hashes of stream and tick."""
    if not 0 < rho <= 1:
        raise ValueError("rho must be within (0, 1]")
    key = (F.col("stream_id"), F.col("tick"))
    nu = frames.groupBy("stream_id").agg(F.first("nu_s", ignorenulls=True).alias("nu"))
    f = frames.join(nu, "stream_id").withColumn("forced", u01("rho", *key) < rho).withColumn("audited", u01("audit", *key) < epsilon)
    f = protocol.with_step(f).withColumn("action_in", F.when(F.col("action_raw").isNotNull(), F.col("s.action")))
    return fold(f, ["stream_id"], ["tick", "t_s"], cascade, ["t_s", "score", "ood", "action_in", "nu", "forced", "audited"], "stat_before_reset double, alarm boolean, route string, action string, is_open boolean, event_idx bigint, alpha double")
