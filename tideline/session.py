"""Session helpers: reading tables, the shared folder, and cutting lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession


def get_spark(app: str = "tideline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; keeps whatever the cluster already set."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, whatever the working directory."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset and the master is local."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="tideline-shared-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


#: Tables written by this process and not yet removed.
_written: dict[str, SparkSession] = {}


def _remove(path: str) -> None:
    spark = _written.pop(path, None)
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the cluster clears its own folder
        pass


def _remove_all() -> None:
    for path in list(_written):
        _remove(path)


atexit.register(_remove_all)


def _write(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tideline/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    return spark.read.schema(df.schema).parquet(path), path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so a lost executor costs one task and not the whole history.

    Parquet instead of ``checkpoint()``: columns stay prunable and the files are compressed. Removed when Python or the
    surrounding :func:`scope` ends.
    """
    return _write(df)[0]


class Rounds:
    """The one current table of an iteration: each :meth:`put` writes the next and removes the last. Numbers about a table are taken
    from what was written. (Observing them while writing would leave a manager in the session that closures of fitted models
    cannot carry to their tasks.)"""

    def __init__(self) -> None:
        self.path: str | None = None

    def put(self, df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
        out, path = _write(df)
        if self.path:
            _remove(self.path)
        self.path = path
        return out, out.agg(*[c.alias(k) for k, c in metrics.items()]).collect()[0].asDict() if metrics else {}


@contextmanager
def scope() -> Iterator[None]:
    """Tables that queries write inside are removed at its end; results must have been read or written by then."""
    before = set(_written)
    try:
        yield
    finally:
        for path in set(_written) - before:
            _remove(path)
