"""Chat-format JSON lines of training windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def target(kind: Column, category: Column) -> Column:
    """What a window is answered with: a whole positive is flagged with its category and the clause it breaks, a partial one held, all
    else cleared."""
    flag = F.concat(F.lit('{"action":"flag","category":"'), category, F.lit('","policy_citation":"SW-'), category, F.lit('"}'))
    return F.when(kind == "pos_full", flag).when(kind == "pos_partial", '{"action":"hold"}').otherwise('{"action":"clear"}')


def chat_rows(windows: DataFrame) -> DataFrame:
    """value: one JSON object per window (id, kind, a, b, category)."""
    ask = F.concat(F.lit("Clip "), "id", F.lit(", seconds "), F.format_number("a", 1), F.lit(" to "), F.format_number("b", 1), F.lit("."))
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return windows.select(F.to_json(F.struct(F.array(turn("user", ask), turn("assistant", target(F.col("kind"), F.col("category")))).alias("messages"), F.col("kind"))).alias("value"))


def write_sft(windows: DataFrame, path: str) -> dict[str, int]:
    """Writes the rows and returns how many there are of each kind."""
    chat_rows(windows).write.mode("overwrite").text(path)
    return {r.kind: r["count"] for r in windows.groupBy("kind").count().collect()}
