"""Settings as nested dataclasses: unknown keys are refused, overrides are checked again."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from typing import Any, get_type_hints

from tideline.errors import UnknownComponent
from tideline.functions.scores import Router
from tideline.operators.steps import Aci, Cusum


@dataclass(frozen=True)
class Sampling:
    rho: float = 0.02
    audit: float = 0.01
    window_s: float = 300.0

    def __post_init__(self) -> None:
        if not 0 < self.rho <= 1:
            raise ValueError("rho must be within (0, 1]")
        if not 0 <= self.audit <= 1 or self.window_s <= 0:
            raise ValueError("audit must be within [0, 1], window_s positive")


@dataclass(frozen=True)
class Reward:
    """Weights of the trajectory reward; refuses those under which silence or 'uncovered' everywhere pays best."""

    hit: float = 1.0
    delay: float = 0.5
    false_alarm: float = 0.3
    uncovered_right: float = 0.6
    uncovered_lazy: float = 0.4
    max_windows: float = 20.0

    def __post_init__(self) -> None:
        if self.false_alarm >= self.hit:
            raise ValueError("a false alarm must cost less than a hit earns, else silence is best")
        if self.uncovered_right >= self.hit:
            raise ValueError("'uncovered' must earn less than a hit")


@dataclass(frozen=True)
class EngineConfig:
    cusum: Cusum = field(default_factory=Cusum)
    router: Router = field(default_factory=Router)
    aci: Aci = field(default_factory=Aci)
    sampling: Sampling = field(default_factory=Sampling)
    reward: Reward = field(default_factory=Reward)


def coerce(cls: type, values: dict[str, Any], where: str = "") -> Any:
    hints = get_type_hints(cls)
    names = {f.name for f in dataclasses.fields(cls) if f.init}
    if extra := sorted(set(values) - names):
        raise KeyError(f"unknown setting {where}{extra[0]}")
    made = {}
    for k, v in values.items():
        sub = hints.get(k)
        made[k] = coerce(sub, v, f"{where}{k}.") if dataclasses.is_dataclass(sub) and isinstance(v, dict) else v
    return cls(**made)


def to_dict(config: Any) -> dict[str, Any]:
    return {f.name: to_dict(v) if dataclasses.is_dataclass(v := getattr(config, f.name)) else v for f in dataclasses.fields(config) if f.init}


def load(path: str) -> EngineConfig:
    with open(path) as f:
        return coerce(EngineConfig, json.load(f))


def save(config: EngineConfig, path: str) -> None:
    with open(path, "w") as f:
        json.dump(to_dict(config), f, indent=1, sort_keys=True)


def override(config: EngineConfig, **dotted: Any) -> EngineConfig:
    """``override(c, **{"aci.gamma": 0.02})``; every section is built, and so checked, anew."""
    d = to_dict(config)
    for key, value in dotted.items():
        *path, last = key.split(".")
        at = d
        for p in path:
            if p not in at:
                raise KeyError(f"unknown setting {key}")
            at = at[p]
        if last not in at:
            raise KeyError(f"unknown setting {key}")
        at[last] = value
    return coerce(EngineConfig, d)


class Components:
    """Scorers, judges and encoders by name: the places where models plug in as UDFs."""

    def __init__(self) -> None:
        self._made: dict[tuple[str, str], Any] = {}

    def register(self, kind: str, name: str):
        def add(f):
            self._made[kind, name] = f
            return f

        return add

    def build(self, kind: str, name: str, *args: Any, **kw: Any) -> Any:
        if (kind, name) not in self._made:
            raise UnknownComponent(f"{kind} {name!r}; there are: {', '.join(self.available(kind)) or 'none'}")
        return self._made[kind, name](*args, **kw)

    def available(self, kind: str) -> list[str]:
        return sorted(n for k, n in self._made if k == kind)

    def clear(self) -> None:
        self._made.clear()


components = Components()
