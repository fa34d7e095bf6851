import pytest

from tests.llm.test_mixing import DDL, pytestmark  # noqa: F401
from tideline.llm import mixing


@pytest.mark.parametrize("docs", [5, 21, 47])
def test_small_sources_get_their_share_by_repeats(spark, docs):
    """Documents of 100 tokens: 500, 2,100 and 4,700 tokens at hand, in slots of 2,000."""
    rows = [(i, "small", 100) for i in range(docs)] + [(1000 + i, "large", 100) for i in range(1000)]
    counts = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    n = docs * 100
    t = spark.createDataFrame([("m", "small", 0.25, 5, 16 * n, 1, 1), ("m", "large", 0.75, 5, 16 * n, 1, 1)], DDL)
    got = mixing._mixed(counts, t)
    mixed = {r["source"]: r["sum(tokens)"] for r in got.groupBy("source").sum("tokens").collect()}
    due = {r["source"]: r["sum(size)"] for r in mixing.schedule(t).groupBy("source").sum("size").collect()}
    assert due == {"small": 4 * n, "large": 12 * n}  # the last slot of a source takes what is left of its share
    assert mixed == {"small": 4 * n, "large": 12 * n}
    assert all(r["count"] <= 5 for r in got.groupBy("doc_id").count().collect())
    assert got.distinct().count() == got.count()


def test_short_is_seen_on_what_was_mixed(spark):
    """Deficits at the very edge: all documents max_repeats times are exactly enough, or lack one token."""
    counts = spark.createDataFrame([(i, "small", 100) for i in range(33)] + [(1000 + i, "large", 97) for i in range(500)], "doc_id bigint, source string, tokens bigint")
    for total, short in ((16500, False), (16501, True)):
        t = spark.createDataFrame([("m", "small", 1.0, 5, total, 1, 1), ("k", "large", 0.5, 1, 40000, 1, 1), ("k", "small", 0.5, 0, 40000, 1, 1)], DDL)
        got = mixing._mixed(counts, t).groupBy("mix_id", "source").sum("tokens").collect()
        mixed = {(r.mix_id, r.source): r["sum(tokens)"] for r in got}
        assert mixed["m", "small"] == 16500 and (mixed["m", "small"] < total) == short
        assert 20000 <= mixed["k", "large"] < 20097 and ("k", "small") not in mixed
