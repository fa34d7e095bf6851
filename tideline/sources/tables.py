"""Readers that apply what every table needs: repeated deliveries count once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.errors import PoolViolation
from tideline.schemas import CLIP
from tideline.session import table

ALL_POOLS = ("exemplar", "compile", "calibration", "eval")


def frames(spark: SparkSession, d: str, *columns: str, where: str | None = None) -> DataFrame:
    """One row per (stream_id, tick); ``columns`` of the rest, so the scan reads no more. ``where`` is applied before the repeated
    rows meet, and so reaches the scan; it must hold for all deliveries of a row alike."""
    f = table(spark, d, "frames")
    f = f.filter(where) if where else f
    return f.select("stream_id", "tick", *columns).dropDuplicates(["stream_id", "tick"])


def clips(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The last delivered row per id; a row without a time of delivery counts as older than all others."""
    c = table(spark, d, "clips").filter("id is not null")
    row = F.struct(*[F.col(x).alias(x.replace(".", "_")) for x in columns])
    return c.groupBy("id").agg(F.max_by(row, F.coalesce(F.col("ingested_at"), F.lit("1970-01-01").cast("timestamp"))).alias("r")).select("id", "r.*")


def read_manifest(spark: SparkSession, path: str, *, pool: tuple[str, ...] | None, split: str | None = None) -> DataFrame:
    """A JSON-lines manifest with an optional first line of metadata. The pools must be named; ALL_POOLS names all."""
    if pool is None:
        raise PoolViolation("say which pools to read")
    rows = spark.read.schema(CLIP + ", __meta__ struct<spec_version:string>").json(path)
    rows = rows.filter("__meta__ is null and id is not null").drop("__meta__").filter(F.col("pool").isin(*pool))
    return rows.filter(F.col("split") == split) if split else rows


def manifest_version(spark: SparkSession, path: str) -> str | None:
    r = spark.read.schema("__meta__ struct<spec_version:string>").json(path).filter("__meta__ is not null").limit(1).collect()
    return r[0]["__meta__"]["spec_version"] if r else None


def write_manifest(clips: DataFrame, path: str) -> None:
    """Parquet partitioned by pool and split, so that later reads prune by them."""
    clips.write.partitionBy("pool", "split").mode("overwrite").parquet(path)
