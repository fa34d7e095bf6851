"""What the operators of this package share: spellings, deliveries, registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.plans.registry import Registry

registry = Registry()

EVAL_SPLITS = ("calib", "test", "zeroday_holdout")


def plain(c: Column) -> Column:
    """Lower case, outer blanks dropped, inner blanks and hyphens as underscores; empty becomes null."""
    x = F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")
    return F.when(x != "", x)


def numbered(c: Column, prefixes: str) -> tuple[Column, Column]:
    """Prefix and number of an identifier such as ``b-000001514``, however it is spelt; nulls if it is none."""
    pattern = rf"^({prefixes})[-_ ]?0*([0-9]{{1,15}})$"
    x = F.lower(F.trim(c))
    ok = x.rlike(pattern)
    return F.when(ok, F.regexp_extract(x, pattern, 1)), F.when(ok, F.regexp_extract(x, pattern, 2).cast("long"))


def padded(n: Column, width: int) -> Column:
    s = n.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def host_name(c: Column) -> Column:
    p, n = numbered(c, "host")
    return F.when(p.isNotNull(), F.concat(F.lit("host-"), padded(n, 7)))


def insert_name(c: Column) -> Column:
    p, n = numbered(c, "b|n")
    return F.when(p.isNotNull(), F.concat(p, F.lit("-"), padded(n, 9)))


def latest(clips: DataFrame, **columns: Column) -> DataFrame:
    """One row per clip id, the last delivered one; rows without an id are dropped. ``columns`` are what the caller needs."""
    when = F.coalesce(F.col("ingested_at"), F.lit("1970-01-01").cast("timestamp"))
    rows = clips.filter(F.col("id").isNotNull()).select(F.col("id"), when.alias("_at"), F.struct(*[c.alias(k) for k, c in columns.items()]).alias("_row"))
    return rows.groupBy("id").agg(F.max_by("_row", "_at").alias("_row")).select("id", "_row.*")
