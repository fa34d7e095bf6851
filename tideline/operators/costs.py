"""What looking everywhere, and looking where a cheap detector asks for it, cost per stream-hour."""

from __future__ import annotations

from dataclasses import dataclass

# Seconds per frame measured for each resolution (detector) and window (mid-tier), and the largest window that fits.
DETECTOR_S = {"224": 0.0203, "real": 0.0218}
MIDTIER_S = {("224", 1): 0.4027, ("224", 4): 0.4822, ("224", 8): 0.2672, ("224", 16): 0.1798, ("real", 1): 0.4777, ("real", 2): 0.7632}
LARGEST = {"224": 16, "real": 2}


@dataclass(frozen=True)
class CostModel:
    """Costs are linear in the rates, so they work on numbers and columns alike; windows of 0 are the largest that fit."""

    res: str = "real"
    fps: float = 0.5
    uniform_fps: float = 2.0
    uniform_window: int = 0
    window: int = 0
    device_hour: float = 0.35
    frontier_call: float = 0.02
    frontier_share: float = 0.3
    audit_clip: float = 0.5
    audits_per_hour: float = 0.5

    def __post_init__(self) -> None:
        for w in (self.uniform_window, self.window):
            if w > LARGEST[self.res]:
                raise ValueError(f"a window of {w} frames does not fit at this resolution (at most {LARGEST[self.res]})")

    def frame_s(self, window: int) -> float:
        """Seconds a frame in a window; of windows not measured those of the nearest one that was."""
        near = min((abs(w - (window or LARGEST[self.res])), w) for r, w in MIDTIER_S if r == self.res)[1]
        return MIDTIER_S[self.res, near]

    @property
    def uniform(self) -> float:
        return self.uniform_fps * self.frame_s(self.uniform_window) * self.device_hour

    @property
    def per_escalation(self) -> float:
        w = self.window or LARGEST[self.res]
        return w * self.frame_s(self.window) / 3600 * self.device_hour + self.frontier_share * self.frontier_call

    def detector(self, fps=None):
        return (self.fps if fps is None else fps) * DETECTOR_S[self.res] * self.device_hour

    @property
    def audit(self) -> float:
        return self.audits_per_hour * self.audit_clip

    def adaptive(self, rate, fps=None):
        """Cost at an escalation rate."""
        return self.detector(fps) + rate * (self.fps if fps is None else fps) * 3600 * self.per_escalation + self.audit

    def crossover(self, fps=None):
        """Escalation rate at which both cost the same."""
        return (self.uniform - self.detector(fps) - self.audit) / ((self.fps if fps is None else fps) * 3600 * self.per_escalation)
