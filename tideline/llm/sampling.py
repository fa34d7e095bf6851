"""Problem 3: samples whose categories match given shares.

Each row is accepted independently with the probability its category needs (need over available, plus some slack), by a
hash of request, category and id; the count is then corrected exactly: the rows with the smallest hashes are drawn. The cut is
found from counts in 4096 ranges of the hash, so only the rows of the one range in which it falls are ranked, never a whole category.

need = max(min_count, target_share * sample_size), which may be broken. ceil(need) rows are drawn (slight oversampling); of
these the first ``wanted`` = max(min_count, round(target_share * sample_size)) are kept. A category falls short where fewer
rows were drawn than need: that is seen on the rows, not on counts of what there is. A request whose split is missing gets no
rows and full deficits. Rows without a bin or category belong to none. Ties in the hash go by id. Null shares, minima and sizes
count as 0. Rows of a request that name a category twice in different spellings each get their own sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import latest, plain
from tideline.rng import u01
from tideline.session import cut_lineage

AXES = ("temporal_sparsity", "perceptual_subtlety", "modality_locus", "context_dependence")
RANGES = 4096


def members(clips: DataFrame) -> DataFrame:
    """id, split, dimension, cat: each dimension in which the clip has a category."""
    first = plain(F.get(F.col("label.categories"), F.lit(0)))
    cat = F.when(F.col("label.safe"), F.lit("safe")).otherwise(first)
    df = latest(clips, split=plain(F.col("split")), category=cat, **{a: plain(F.col(f"axes.{a}.bin")) for a in AXES})
    pairs = F.create_map(*[x for d in ("category", *AXES) for x in (F.lit(d), F.col(d))])
    return df.filter("split is not null").select("id", "split", F.explode(pairs).alias("dimension", "cat")).filter("cat is not null")


def requests(targets: DataFrame) -> DataFrame:
    t = targets.select("request_id", "split", "dimension", "category", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("target_share", "min_count", "sample_size")])
    return t.dropDuplicates().withColumn("_split", plain(F.col("split"))).withColumn("_dim", plain(F.col("dimension"))).withColumn("_cat", plain(F.col("category")))


def quotas(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per row of ``targets``: available, need (not rounded), most (rows to draw), wanted (rows to keep)."""
    have = rows.groupBy(F.col("split").alias("_split"), F.col("dimension").alias("_dim"), F.col("cat").alias("_cat")).agg(F.count("*").alias("available"))
    q = requests(targets).join(have, ["_split", "_dim", "_cat"], "left").withColumn("available", F.coalesce("available", F.lit(0)))
    q = q.withColumn("need", F.greatest(F.col("min_count").cast("double"), F.col("target_share") * F.col("sample_size")))
    q = q.withColumn("most", F.ceil(F.col("need") - 1e-9).cast("bigint"))
    return q.withColumn("wanted", F.greatest(F.col("min_count").cast("bigint"), F.round(F.col("target_share") * F.col("sample_size")).cast("bigint")))


def _drawn(rows: DataFrame, q: DataFrame, seed: int, slack: float) -> DataFrame:
    """request_id, category, id, r (rank by hash), kept: at most ``most`` rows per row of the targets."""
    p = F.least(F.lit(1.0), (F.col("most") + 6 * F.sqrt(F.col("most") + 1.0) + 4) / F.greatest("available", F.lit(1)) * (1 + slack))
    q = q.filter("available > 0 and most > 0").select("request_id", "category", "_split", "_dim", "_cat", "most", "wanted", p.alias("p"))
    d = rows.withColumnsRenamed({"split": "_split", "dimension": "_dim", "cat": "_cat"}).join(q, ["_split", "_dim", "_cat"])
    keys = ["request_id", "category"]
    # Where chance accepts fewer than needed, the rows past p are there too, so the count is exact all the same.
    d = d.withColumn("u", u01(seed, F.col("request_id"), F.col("category"), F.col("id"))).withColumn("accepted", F.col("u") < F.col("p"))
    d = cut_lineage(d.select(*keys, "id", "most", "wanted", "u", "accepted", F.floor(F.col("u") * RANGES).alias("b")))
    sums = d.groupBy(*keys, "b").agg(F.count("*").alias("c"), F.count_if("accepted").alias("a"))
    w = Window.partitionBy(*keys)
    sums = sums.withColumn("before", F.coalesce(F.sum("c").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n_acc", F.sum("a").over(w))
    d = d.join(sums.select(*keys, "b", "c", "before", "n_acc"), [*keys, "b"])
    d = d.filter((F.col("accepted") | (F.col("n_acc") < F.col("most"))) & (F.col("before") < F.col("most")))
    # Only the ranges in which `most` or `wanted` falls are ranked; rows of the others are in or out as they are.
    cut = ((F.col("before") + F.col("c") > F.col("most")) | ((F.col("before") < F.col("wanted")) & (F.col("before") + F.col("c") > F.col("wanted"))))
    rank = F.row_number().over(Window.partitionBy(*keys, "b").orderBy("u", "id"))
    edge = d.filter(cut).withColumn("r", F.col("before") + rank)
    sure = d.filter(~cut).withColumn("r", F.col("before") + 1)
    return sure.unionByName(edge).filter("r <= most").select(*keys, "id", (F.col("r") <= F.col("wanted")).alias("kept"))


def drawn(clips: DataFrame, targets: DataFrame, seed: int = 7, slack: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """The quotas and the rows drawn for them."""
    rows = cut_lineage(members(clips))
    q = cut_lineage(quotas(rows, targets))
    return q, _drawn(rows, q, seed, slack)


def draw(clips: DataFrame, targets: DataFrame, seed: int = 7, slack: float = 0.1) -> DataFrame:
    """request_id, category, id: the sample, exact in its counts."""
    return drawn(clips, targets, seed, slack)[1].filter("kept").select("request_id", "category", "id")


def sample_report(clips: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """Per row of ``targets``: available, wanted, taken, actual share, short, and by how much need was missed."""
    q, rows = drawn(clips, targets, seed)
    taken = rows.groupBy("request_id", "category").agg(F.count("*").alias("drawn"), F.count_if("kept").alias("taken"))
    r = q.join(taken, ["request_id", "category"], "left").fillna(0, ["drawn", "taken"])
    total = F.sum("taken").over(Window.partitionBy("request_id"))
    missing = F.greatest(F.lit(0.0), F.col("need") - F.col("drawn"))
    r = r.withColumn("actual_share", F.when(total > 0, F.round(F.col("taken") / total, 6)))
    return r.select("request_id", "category", "target_share", "available", F.least("available", "wanted").alias("wanted"), "taken", "actual_share", (missing > 1e-9).alias("short"), F.round(missing, 6).alias("missing"))
