"""Policies as data: perturbed copies for training samples, families of sources for ablations, drafts for gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.rng import u01

# The clause that lets everything else pass, and titles of clauses no corpus has.
SAFE_EXIT = "Z0_ok"
NOVEL = ("licence plates", "trademarks", "coordinates", "barcodes", "flashing lights")
#: How the ids of a source are written, by its place.
STYLES = ("Cn_slug", "SEC-n.m", "n", "slug")


def random_id(*key: Column) -> Column:
    """A letter, a digit, and six letters, all from a hash."""
    h = F.md5(F.concat_ws(":", F.lit("id"), *[k.cast("string") for k in key]))
    n = F.conv(F.substring(h, 1, 6), 16, 10).cast("bigint")
    return F.concat(F.char(65 + n % 26), (1 + n % 9).cast("string"), F.lit("_"), F.translate(F.substring(h, 7, 6), "0123456789", "ghijklmnop"))


def augment(samples: DataFrame, clauses: list[tuple[str, str]], key: str, target: str, mismatch: float = 0.25, least: int = 2, novel: int = 1) -> DataFrame:
    """key, is_mismatch, target_clause_id, ids: a policy per sample, its clauses (id, category) given as one literal, so samples are never
    multiplied by a join.

    ``target`` is the category the sample needs (null if it is safe). A share of the samples that need one lose its clauses; of the others a random number
    stays, at least ``least`` in all; ``novel`` clauses join them, every id is renamed, and the safe exit is always there; all in random
    order. target_clause_id is the new id of the first clause of the target that is left.
    """
    k = F.col(key)
    arr = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(c).alias("c")) for i, c in clauses])
    d = samples.select(key, F.col(target).alias("_t")).withColumn("is_mismatch", F.coalesce(F.col("_t").isNotNull() & (u01("mm", k) < mismatch), F.lit(False)))
    mine = lambda c: F.coalesce(c["c"] == F.col("_t"), F.lit(False))
    d = d.withColumn("_must", F.when(F.col("is_mismatch"), F.filter(arr, lambda c: F.lit(False))).otherwise(F.filter(arr, mine)))
    d = d.withColumn("_rest", F.array_sort(F.transform(F.filter(arr, lambda c: ~mine(c)), lambda c: F.struct(u01("sub", k, c["id"]).alias("u"), c["id"].alias("id")))))
    low = F.greatest(F.least(F.lit(least) - F.size("_must"), F.size("_rest")), F.lit(0))
    d = d.withColumn("_k", low + F.floor(u01("size", k) * (F.size("_rest") - low + 1)).cast("int"))
    new = F.array_sort(F.transform(F.array(*map(F.lit, NOVEL)), lambda n: F.struct(u01("novel", k, n).alias("u"), n.alias("id"))))
    old = F.concat(F.transform("_must", lambda c: c["id"]), F.transform(F.slice("_rest", F.lit(1), F.col("_k")), lambda c: c["id"]), F.transform(F.slice(new, 1, novel), lambda c: c["id"]))
    d = d.withColumn("_ids", F.transform(old, lambda i: F.struct(i.alias("old"), random_id(k, i).alias("new"))))
    order = F.array_sort(F.transform(F.concat(F.transform("_ids", lambda i: i["new"]), F.array(F.lit(SAFE_EXIT))), lambda i: F.struct(u01("sh", k, i).alias("u"), i.alias("id"))))
    first = F.get(F.transform("_must", lambda c: c["id"]), F.lit(0))
    d = d.withColumn("target_clause_id", F.get(F.transform(F.filter("_ids", lambda i: i["old"] == first), lambda i: i["new"]), F.lit(0)))
    return d.select(key, "is_mismatch", "target_clause_id", F.transform(order, lambda o: o["id"]).alias("ids"))


def draft(proposals: DataFrame, answer: str) -> DataFrame:
    """Clauses from what a model proposed (a JSON object): always drafts, of generated provenance; answers that lack id, category, title or
    text are no clause and are kept with ``missing`` saying which."""
    names = ("id", "category", "title", "text")
    p = F.from_json(answer, ", ".join(f"{n} string" for n in names))
    missing = F.array_join(F.filter(F.array(*[F.when(F.coalesce(p[n], F.lit("")) == "", F.lit(n)) for n in names]), lambda x: x.isNotNull()), ",")
    return proposals.select("*", *[p[n].alias(f"clause_{n}") for n in names], missing.alias("missing"), F.when(missing == "", "draft").alias("status"), F.when(missing == "", "generated").alias("provenance"))
