"""Structured Streaming around the step functions: keyed state in the state store, the same code as the batch folds."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _nested(x):
    return tuple(_nested(i) for i in x) if isinstance(x, list) else x


class Stepper(StatefulProcessor):
    """Sorts a key's rows of the micro-batch by order and steps through them.

    A row that is not newer than the last one of an earlier batch cannot be folded in any more: it is put out with late = true
    and leaves the state as it is, instead of failing the query.
    """

    def __init__(self, step: Callable, key: str, order: str, values: list[str], outs: list[str]) -> None:
        self.step, self.key, self.order, self.values, self.outs = step, key, order, values, outs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state string, last double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        state, last = self.step.initial, float("-inf")
        if self.state.exists():
            raw, last = self.state.get()
            state = _nested(json.loads(raw))
        out = []
        cols = [[None if isinstance(v, float) and v != v else v for v in pdf[c].tolist()] for c in self.values]
        for o, *vals in zip(pdf[self.order].tolist(), *cols):
            if o <= last:
                out.append((key[0], o, *[None] * len(self.outs), True))
                continue
            state, got = self.step(state, *vals)
            last = float(o)
            out.append((key[0], o, *got, False))
        self.state.update((json.dumps(state), last))
        yield pd.DataFrame(out, columns=[self.key, self.order, *self.outs, "late"])

    def close(self) -> None:
        pass


def stateful(stream: DataFrame, step: Callable, key: str, order: str, values: list[str], out: str, mode: str = "append") -> DataFrame:
    """A row per input row: key, order, the step's outputs (DDL in ``out``), late. ``stream`` may be a stream or a table."""
    use_rocksdb(stream.sparkSession)
    outs = [x.split()[0] for x in out.split(", ")]
    types = {f.name: f.dataType.simpleString() for f in stream.schema}
    ddl = f"{key} {types[key]}, {order} {types[order]}, {out}, late boolean"
    return stream.groupBy(key).transformWithStateInPandas(statefulProcessor=Stepper(step, key, order, values, outs), outputStructType=ddl, outputMode=mode, timeMode="None")


def windowed_scores(stream: DataFrame, delay: str = "30 seconds", width: str = "60 seconds") -> DataFrame:
    """Counts and means per stream and aligned window of event time; rows later than ``delay`` behind the watermark are dropped."""
    from pyspark.sql import functions as F

    w = stream.withWatermark("ts", delay).groupBy(F.window("ts", width), "stream_id")
    return w.agg(F.count("*").alias("n"), F.avg("score").alias("mean_score")).select("stream_id", F.col("window.start").alias("start"), "n", "mean_score")


def run_available(result: DataFrame, path: str, checkpoint: str) -> None:
    """Run a streaming result over what is there now, in as many micro-batches as the source makes, into Parquet."""
    q = result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
