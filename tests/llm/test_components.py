import random

from pyspark.sql import functions as F

from tests.llm.fixtures import clip, clips, null_clip
from tideline.llm import grouped_split
from tideline.llm.components import components


def union_find(edges):
    p = {}

    def find(x):
        p.setdefault(x, x)
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        if a != b:
            p[max(a, b)] = min(a, b)
    return {x: find(x) for x in p}


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    edges += [(1000 + i, 1001 + i) for i in range(70)]  # a long path
    edges += [(5000, 5000 + i) for i in range(1, 200)]  # a hub
    edges = [(u, v) for u, v in edges if u != v]
    got = {r.node: r.root for r in components(spark.createDataFrame([*edges, (7, 7), (None, 3), (9, None)], "u bigint, v bigint")).collect()}
    want = union_find(edges)
    assert got == want


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_groups(spark):
    rows = [
        clip("a", host="host-0000005", cuts=["b-000000001"]),
        clip("b", host="HOST_5"),
        clip("c", host=" host-9", cuts=["B000000001"]),
        clip("d", cuts=["n-7", "b-44"]),
        clip("e", cuts=["N_7"]),
        clip("f", cuts=["n/a", None, ""]),
        clip("g", host="unknown"),
        clip("g", host="unknown"),
        clip("h", host="host-77"),
        clip("i", cuts=["host-5"]),
        null_clip(),
    ]
    g = {r.id: (r.k, r.size) for r in grouped_split.groups(clips(spark, rows)).select("id", grouped_split.name_of(F.col("grp")).alias("k"), "size").collect()}
    assert g == {"a": ("host-0000005", 3), "b": ("host-0000005", 3), "c": ("host-0000005", 3), "d": ("b-000000044", 2), "e": ("b-000000044", 2), "f": (None, 1), "g": (None, 1), "h": ("host-0000077", 1), "i": (None, 1)}


def test_split_keeps_groups_and_shares(spark):
    rows = [clip(f"g{i}-{j}", host=f"host-{i}") for i in range(300) for j in range(2)] + [clip(f"big{j}", host="host-9999") for j in range(200)]
    t = spark.createDataFrame([("train", 0.7), ("validation", 0.15), ("test", 0.15)], "split string, target_share double")
    a = grouped_split.assign(clips(spark, rows), t).collect()
    by, placed = {}, grouped_split.assign(clips(spark, rows), t, giant=200).collect()
    for r in [*a, *[x for x in placed if x.grp == 9999]]:
        by.setdefault(r.grp, set()).add(r.split)
    assert all(len(v) == 1 for v in by.values())
    # By hashes alone the group of a quarter of all clips goes where its hash says; placed first, the shares are met.
    small = [r for r in a if r["size"] < 200]
    assert abs(sum(r.split == "train" for r in small) / len(small) - 0.7) < 0.06
    n = {k: sum(r.split == k for r in placed) / len(placed) for k in ("train", "validation", "test")}
    assert abs(n["train"] - 0.7) < 0.06 and abs(n["test"] - 0.15) < 0.05
    assert grouped_split.assign(clips(spark, []), t).count() == 0
    assert {r.split for r in grouped_split.assign(clips(spark, rows[:4]), t.limit(0)).collect()} == {None}
    assert grouped_split.split_report(clips(spark, rows), t).count() == 3
