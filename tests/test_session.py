import os
import subprocess
import sys

import pytest

from tideline import session
from tideline.plans.skew import join_grid


def test_scope_and_rounds_remove_what_they_wrote(spark):
    path = lambda df: df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    with session.scope():
        a = path(session.cut_lineage(spark.range(3)))
        assert os.path.isdir(a)
    assert not os.path.isdir(a)
    from pyspark.sql import functions as F

    table = session.Rounds()
    df, seen = table.put(spark.range(5), n=F.count("*"), top=F.max("id"))
    one = path(df)
    assert seen == {"n": 5, "top": 4}
    df, _ = table.put(df.filter("id > 1"))
    assert not os.path.isdir(one) and df.count() == 3


def test_a_temporary_folder_is_refused_off_local_masters(monkeypatch):
    class Spark:
        class conf:
            get = staticmethod(lambda k, d: d)

        class sparkContext:
            master = "spark://cluster:7077"

    with pytest.raises(RuntimeError):
        session.shared_dir(Spark)


def test_join_grid_is_a_join(spark):
    left = spark.createDataFrame([("hot", i) for i in range(50)] + [("b", 1), (None, 2)], "k string, x int")
    right = spark.createDataFrame([("hot", i) for i in range(40)] + [("b", 7), ("c", 8), (None, 3)], "k string, y int")
    want = {(k, x, y) for k, x in [("hot", i) for i in range(50)] for y in range(40)} | {("b", 1, 7)}
    for side in (3, 45, 2000):
        got = join_grid(left, right, ["k"], side).select("k", "x", "y").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_entry_stands_without_the_subpackage_and_hides_no_errors(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for broken, text in ((False, "True False"), (True, "ZeroDivisionError")):
        d = tmp_path / str(broken)
        d.mkdir()
        subprocess.run(["cp", "-r", f"{root}/tideline", f"{root}/__spark_entry__.py", str(d)], check=True)
        subprocess.run(["rm", "-rf", f"{d}/tideline/llm"], check=True)
        if broken:
            (d / "tideline/llm").mkdir()
            (d / "tideline/llm/__init__.py").write_text("")
            (d / "tideline/llm/queries.py").write_text("1 / 0")
        r = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q) > 100, any(n.startswith('p1') for n in q))"], cwd=d, capture_output=True, text=True)
        assert text in r.stdout + r.stderr
