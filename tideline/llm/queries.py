"""The registered queries of this package. ``queries()`` and ``oracle_sql()`` are what the entry module adds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import grouped_split, leakage, mixing, overlap, pii, sampling, truncation
from tideline.llm.common import registry
from tideline.llm.sql import SQL
from tideline.session import cut_lineage, table


def _q(name: str):
    return registry.query(name, SQL.get(name))


@_q("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    o = overlap.pairs(cut_lineage(overlap.edits(table(spark, d, "clips"))))
    return o.select(F.least("eval_id", "train_id").alias("id_a"), F.greatest("eval_id", "train_id").alias("id_b"))


@_q("p1_classes")
def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return overlap.class_report(table(spark, d, "clips"))


@_q("p1_report")
def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "clips"))


@_q("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "clips")).select("id", "field").distinct()


@_q("p2_report")
def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_report(table(spark, d, "clips"))


@_q("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_report(table(spark, d, "clips"), table(spark, d, "sample_targets")).filter("short").select("request_id", "category").distinct()


@_q("p3_report")
def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_report(table(spark, d, "clips"), table(spark, d, "sample_targets"))


@_q("p3_sample")
def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.draw(table(spark, d, "clips"), table(spark, d, "sample_targets"))


@_q("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    g = grouped_split.groups(table(spark, d, "clips"))
    return g.filter("size > 1").select("id", grouped_split.name_of(F.col("grp")).alias("group_key"))


@_q("p4_split")
def p4_split(spark: SparkSession, d: str) -> DataFrame:
    a = grouped_split.assign(table(spark, d, "clips"), table(spark, d, "split_targets"))
    return a.select("id", grouped_split.name_of(F.col("grp")).alias("group_key"), "size", "split")


@_q("p4_report")
def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return grouped_split.split_report(table(spark, d, "clips"), table(spark, d, "split_targets"))


@_q("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


@_q("p5_report")
def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(table(spark, d, "documents"), table(spark, d, "eval_items"))


@_q("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(table(spark, d, "documents"), table(spark, d, "mix_targets")).filter("short").select("mix_id", "source").distinct()


@_q("p6_report")
def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@_q("p6_mix")
def p6_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@_q("p7_found")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.mentions(table(spark, d, "documents")).select("doc_id", "kind", "start_pos").distinct()


@_q("p7_redacted")
def p7_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(spark, d, "documents"))


@_q("p7_report")
def p7_report(spark: SparkSession, d: str) -> DataFrame:
    m = pii.mentions(table(spark, d, "documents"))
    return m.groupBy("kind").agg(F.count("*").alias("n_mentions"), F.count_distinct("doc_id").alias("n_documents"))


def queries() -> dict:
    return dict(registry.queries)


def oracle_sql() -> dict[str, str]:
    return dict(registry.sql)
