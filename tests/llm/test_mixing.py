import os

import pytest
from pyspark.sql import functions as F

from tideline.llm import mixing

pytestmark = pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no vocabulary file here")
DDL = "mix_id string, source string, target_share double, max_repeats int, total_tokens bigint, have int, reps int"


def documents(spark, n=400):
    rows = [(i, f"document {i} " + "some words of the text " * (3 + i % 20), ("Chat Log", "chat_log", "memo")[i % 3] if i < n - 20 else "rare", 5) for i in range(n)]
    rows += [(9001, None, "memo", 1), (9002, "  ", "memo", 1), (9003, "", "chat-log", 1), (9004, "lost", None, 1), (None, "no id", "memo", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, tokens int")


def test_token_counts_against_the_library(spark):
    enc = mixing.encoder(mixing.TOKENIZER)
    for r in mixing.token_counts(documents(spark, 40)).join(documents(spark, 40).drop("tokens", "source"), "doc_id").collect():
        assert r.tokens == len(enc.encode_ordinary(r.text))
        assert enc.decode(enc.encode_ordinary(r.text)) == r.text


def test_shares_repeats_and_report(spark):
    t = spark.createDataFrame([("m", "chat_log", 0.5, 1, 20000, 1, 1), ("m", "Memo", 0.3, 2, 20000, 1, 1), ("m", "rare", 0.2, 3, 20000, 1, 1), ("m", "none", 0.0, 1, 20000, 1, 1)], DDL)
    d = documents(spark)
    m = mixing.mix(d, t, block=200)
    reps = m.groupBy("doc_id", "source").count().collect()
    cap = {"chat_log": 1, "memo": 2, "rare": 3}
    assert all(r["count"] <= cap[r.source] for r in reps)
    rep = {r.source: r for r in mixing.mix_report(d, t, block=200).collect()}
    assert rep["rare"].short and not rep["chat_log"].short
    assert abs(rep["chat_log"].mixed - 10000) < 700 and abs(rep["Memo"].mixed - 6000) < 700
    slots = m.select("slot", "source").distinct().orderBy("slot").collect()
    head = [s.source for s in slots[:20]]
    assert 7 <= head.count("chat_log") <= 13  # shares hold in every stretch


def test_schedule_ranks_are_dense(spark):
    t = spark.createDataFrame([("m", "a", 0.7, 1, 3000000, 1, 1), ("m", "b", 0.3, 1, 3000000, 1, 1)], DDL)
    s = mixing.schedule(t, block=20)
    assert s.count() == 150000
    for r in s.groupBy("source").agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.count_distinct("k").alias("d")).collect():
        assert (r.lo, r.hi, r.d) == (0, r.n - 1, r.n)


def test_empty(spark):
    t = spark.createDataFrame([("m", "chat_log", 0.5, 1, 100, 1, 1), (None, None, None, None, None, 1, 1), ("x", "memo", None, None, None, 1, 1)], DDL)
    assert mixing.mix(documents(spark).limit(0), t).count() == 0
    assert mixing.mix(documents(spark), t.limit(0)).count() == 0
    assert {(r.mix_id, r.short) for r in mixing.mix_report(documents(spark).limit(0), t).collect()} == {("m", True), ("x", False)}
