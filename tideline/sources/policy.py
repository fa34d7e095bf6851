"""Policy corpora: append-only tables of clauses, and prompt templates in files."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.errors import TemplateError
from tideline.schemas import CLAUSE


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document {"clauses": [...]} as a table; ``seq`` is the order in the file."""
    with open(path) as f:
        rows = json.load(f)["clauses"]
    names = [x.split()[0] for x in CLAUSE.split(", ")]
    extra = {k for r in rows for k in r} - set(names)
    if extra:
        raise KeyError(f"unknown field {sorted(extra)[0]}")
    return spark.createDataFrame([tuple(i + 1 if n == "seq" else r.get(n) for n in names) for i, r in enumerate(rows)], CLAUSE)


def save_corpus(clauses: DataFrame, path: str) -> None:
    rows = [r.asDict() for r in clauses.drop("seq").join(clauses.select("id", "seq"), "id").orderBy("seq").drop("seq").collect()]  # a policy is a document
    with open(path, "w") as f:
        json.dump({"clauses": rows}, f, indent=1)


def amend(clauses: DataFrame, clause_id: str, text: str) -> DataFrame:
    """The old clause retired, a new version that supersedes it appended; texts are never edited in place."""
    old = clauses.filter(F.col("id") == clause_id)
    last = clauses.agg(F.max("seq").alias("s")).collect()[0].s or 0
    new = old.select(
        F.concat(F.regexp_replace("id", r"\.v\d+$", ""), F.lit(".v"), (F.col("version") + 1).cast("string")).alias("id"), "category", "title", F.lit(text).alias("text"), F.lit("draft").alias("status"), (F.col("version") + 1).alias("version"),
        "added_on", F.col("id").alias("supersedes"), "provenance", "examples", F.lit(last + 1).cast("bigint").alias("seq"),
    )
    return clauses.withColumn("status", F.when(F.col("id") == clause_id, "retired").otherwise(F.col("status"))).unionByName(new)


def load_templates(path: str, required: Mapping[str, set[str]]) -> dict[str, str]:
    """Named templates of a JSON file; each must hold the placeholders it needs."""
    with open(path) as f:
        t = json.load(f)
    if extra := sorted(set(t) - set(required)):
        raise TemplateError(f"unknown template {extra[0]}")
    for name, need in required.items():
        have = set(re.findall(r"\$\{?(\w+)", t.get(name, "")))
        if lack := sorted(need - have):
            raise TemplateError(f"template {name} lacks ${lack[0]}")
    return t
