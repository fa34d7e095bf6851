"""All registered queries of the library outside the training-data package."""

from __future__ import annotations

import importlib

from tideline.plans.registry import core

MODULES = ("q_scalar", "q_stream", "q_select", "q_join", "q_metrics", "q_valid", "q_boundary", "q_dataset", "q_simulate")

for _m in MODULES:
    importlib.import_module(f"tideline.plans.{_m}")


def queries() -> dict:
    return dict(core.queries)


def oracle_sql() -> dict[str, str]:
    return dict(core.sql)
