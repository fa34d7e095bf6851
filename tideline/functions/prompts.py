"""Prompt templates and policy texts."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.errors import TemplateError

_PLACEHOLDER = re.compile(r"\$(?:(\w+)|\{(\w+)\})")


def render(template: str, values: Mapping[str, Column]) -> Column:
    """``$x`` and ``${x}`` replaced per row; an unknown name is an error, a null value an empty text."""
    parts, at = [], 0
    for m in _PLACEHOLDER.finditer(template):
        name = m[1] or m[2]
        if name not in values:
            raise TemplateError(f"no value for ${name}")
        parts += [F.lit(template[at : m.start()]), F.coalesce(values[name].cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def assemble(*parts: Column, joiner: str = "\n\n") -> Column:
    """The parts that are neither null nor empty, joined."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), joiner)


def key(*parts: Column, length: int = 24) -> Column:
    """Cache key of texts: the head of their SHA-256, with a separator no text contains."""
    return F.substring(F.sha2(F.concat_ws("\x00", *parts), 256), 1, length)


def tokens_estimate(text: Column, per_token: float = 2.0) -> Column:
    return F.floor(F.length(text) / per_token).cast("bigint")
