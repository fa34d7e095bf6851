"""Problem 4: splits that keep together clips which share a host recording or an insert.

Entities (hosts, inserts) are the nodes; each clip ties its entities to the smallest of them, and connected components are
found by alternating large-star small-star (:mod:`tideline.llm.components`). Component identifiers are hashed into the ranges
of the target shares. One component with a large part of all clips throws hashed shares off by its size; who would rather have
exact shares than hashes alone gives :func:`assign` the parameter ``giant``: components with more than 1/giant of all clips
(fewer than giant of them) are then placed first, largest first, each where most is still missing. It is off by default.

``pool`` and ``split`` play no part: the new split is made whatever they say today.
Absent or unreadable ids tie nothing. Clips tied to nothing are their own groups. Rows without id are dropped; repeated
deliveries count once. Without targets (empty table) every split is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import latest, numbered, padded
from tideline.llm.components import components
from tideline.plans.skew import join_unique
from tideline.session import cut_lineage

_BASE = 10**15  # an identifier has 15 digits at most


def _host(c: Column) -> Column:
    return numbered(c, "host")[1]


def _insert(c: Column) -> Column:
    p, n = numbered(c, "b|n")
    return F.when(p == "b", n + _BASE).when(p == "n", n + 2 * _BASE)


def name_of(e: Column) -> Column:
    """The usual spelling of an entity's number: hosts come first, then b-, then n- inserts."""
    n = F.pmod(e, F.lit(_BASE))
    return F.when(e < _BASE, F.concat(F.lit("host-"), padded(n, 7))).when(e < 2 * _BASE, F.concat(F.lit("b-"), padded(n, 9))).otherwise(F.concat(F.lit("n-"), padded(n, 9)))


def groups(clips: DataFrame) -> DataFrame:
    """id, grp (bigint, null if the clip has no entity), size: clips in the same group are tied, directly or through others."""
    ents = F.concat(F.array(_host(F.col("splice.host_id"))), F.transform(F.coalesce(F.col("splice.cuts.insert_id"), F.array().cast("array<string>")), _insert))
    df = latest(clips, ents=F.array_distinct(F.filter(ents, lambda x: x.isNotNull()))).withColumn("first", F.when(F.size("ents") > 0, F.array_min("ents")))
    df = cut_lineage(df)
    edges = df.filter(F.size("ents") > 1).select(F.explode("ents").alias("u"), F.col("first").alias("v")).filter("u != v")
    comp = components(edges)
    per = df.filter("first is not null").groupBy("first").agg(F.count("*").alias("c"))
    per = per.join(comp.withColumnRenamed("node", "first"), "first", "left").withColumn("grp", F.coalesce("root", "first"))
    sizes = per.groupBy("grp").agg(F.sum("c").alias("size"))
    per = cut_lineage(join_unique(per.select("first", "grp"), sizes, "grp", "inner").select("first", "grp", "size"))
    tied = join_unique(df.filter("first is not null").select("id", "first"), per, "first", "inner").select("id", "grp", "size")
    return tied.unionByName(df.filter("first is null").select("id", F.lit(None).cast("bigint").alias("grp"), F.lit(1).cast("bigint").alias("size")))


def assign(clips: DataFrame, targets: DataFrame, seed: int = 11, giant: int | None = None) -> DataFrame:
    """id, grp, size, split."""
    g = cut_lineage(groups(clips))
    shares = [(r.split, float(r.target_share or 0)) for r in targets.select("split", "target_share").distinct().orderBy("split").collect() if r.split is not None]
    if not shares or sum(s for _, s in shares) <= 0:
        return g.withColumn("split", F.lit(None).cast("string"))
    room, placed = dict(shares), _placed(g, shares, giant) if giant else {}
    if placed:
        room = placed.pop(None)
    whole = sum(room.values()) or 1.0
    # Groups without an entity are single clips and hash by their id.
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col("grp").cast("string"), "id")), 11) / F.lit(float(2**53))
    names, edges, edge = list(room), [], 0.0
    for k in names:
        edge += room[k] / whole
        edges.append(edge)
    split = F.lit(names[-1])
    for k, x in list(zip(names, edges))[-2::-1]:
        split = F.when(F.col("_u") < x, F.lit(k)).otherwise(split)
    for k, v in placed.items():
        split = F.when(F.col("grp") == k, F.lit(v)).otherwise(split)
    return g.withColumn("_u", u).withColumn("split", split).drop("_u")


def _placed(g: DataFrame, shares: list[tuple[str, float]], giant: int) -> dict:
    """Split of each group with more than 1/giant of all clips; under None the clips that are then still missing per split."""
    total, whole = g.count(), sum(s for _, s in shares)
    left = {k: total * s / whole for k, s in shares}
    placed: dict = {}
    large = g.filter((F.col("size") * giant > total) & (F.col("size") > 1)).select("grp", "size").distinct().collect()
    for r in sorted(large, key=lambda r: (-r["size"], r["grp"])):
        placed[r["grp"]] = best = max(left, key=lambda k: (left[k], k))
        left[best] -= r["size"]
    return placed | {None: {k: max(0.0, v) for k, v in left.items()}}


def split_report(clips: DataFrame, targets: DataFrame, giant: int | None = None) -> DataFrame:
    """Per split: target share, clips, groups, actual share."""
    a = assign(clips, targets, giant=giant)
    n = a.groupBy("split").agg(F.count("*").alias("n_clips"), F.count_distinct(F.coalesce(F.col("grp").cast("string"), "id")).alias("n_groups"))
    n = n.withColumn("total", F.sum("n_clips").over(Window.partitionBy(F.lit(1))))  # a row per split
    t = targets.select("split", "target_share").dropDuplicates(["split"])
    return t.join(n, "split", "left").select("split", "target_share", F.coalesce("n_clips", F.lit(0)).alias("n_clips"), F.coalesce("n_groups", F.lit(0)).alias("n_groups"), F.round(F.coalesce(F.col("n_clips") / F.col("total"), F.lit(0.0)), 6).alias("actual_share"))
