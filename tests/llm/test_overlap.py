import random

from tests.llm.fixtures import SHA, clip, clips, null_clip
from tideline.llm import overlap


def lcs(a, b):
    d = [0] * (len(b) + 1)
    for x in a:
        p = 0
        for j, y in enumerate(b):
            t = d[j + 1]
            d[j + 1] = p + 1 if x is not None and x == y else max(d[j + 1], d[j])
            p = t
    return d[-1]


def pairs(df):
    return {(r.eval_id, r.train_id) for r in overlap.overlaps(df).collect()}


def test_against_brute_force(spark):
    rng = random.Random(1)
    ids = [f"b-{i:09d}" for i in range(40)]
    seqs = []
    for k in range(30):
        s = rng.choices(ids, k=rng.randint(3, 9))
        seqs.append(s)
        for _ in range(3):
            t = list(s)
            for _ in range(rng.randint(0, 3)):
                op = rng.random()
                if op < 0.4:
                    t[rng.randrange(len(t))] = rng.choice(ids)
                elif op < 0.7 and len(t) > 1:
                    t.pop(rng.randrange(len(t)))
                elif op < 0.9:
                    t.insert(rng.randrange(len(t) + 1), rng.choice(ids))
                else:
                    rng.shuffle(t)
            seqs.append(t)
    seqs += [["b-000000001"] * 6, ["b-000000001"] * 5 + ["b-000000002"], ["b-000000001", None, "b-000000003", "b-000000004"]]
    rows = [clip(f"c{i:04d}", split=("train", "test", "calib")[i % 3], cuts=s) for i, s in enumerate(seqs)]
    want = set()
    for i, a in enumerate(seqs):
        for j, b in enumerate(seqs):
            if i % 3 and not j % 3 and lcs(a, b) >= 0.75 * max(len(a), len(b)):
                want.add((f"c{i:04d}", f"c{j:04d}"))
    assert len(want) > 20
    assert pairs(clips(spark, rows)) == want


def test_same_file_spellings_and_useless_digests(spark):
    rows = [
        clip("a", "Train ", sha=SHA.upper()),
        clip("b", " TEST", sha=SHA),
        clip("c", "train", sha="0" * 64),
        clip("d", "calib", sha="0" * 64),
        clip("e", "calib", sha=""),
        clip("f", "train", sha=""),
        clip("g", "zeroday-holdout", cuts=["B_12", " n-000000007", "b-9", "B000000010"]),
        clip("h", "train", cuts=["b-000000012", "n-7", "b-000000009", "b-10"]),
        clip("h", "train", cuts=["b-000000012", "n-7", "b-000000009", "b-10"]),
        null_clip(),
        clip("z", None, cuts=["b-000000012", "n-7", "b-000000009", "b-10"], sha=SHA),
    ]
    assert pairs(clips(spark, rows)) == {("b", "a"), ("g", "h")}


def test_order_counts_and_few_shared_inserts_are_no_case(spark):
    rows = [clip("a", cuts=["b-1", "b-2", "b-3", "b-4"]), clip("b", "test", cuts=["b-4", "b-3", "b-2", "b-1"]), clip("c", "test", cuts=["b-1", "b-2", "b-8", "b-9"], host="host-1")]
    assert pairs(clips(spark, rows)) == set()


def test_hot_insert_and_copies(spark):
    """One insert in every clip, one string in a third of them."""
    rows = [clip(f"t{i}", "train", cuts=["b-1", f"b-{i + 10}", f"b-{i + 1000}", f"b-{i + 2000}"]) for i in range(80)]
    rows += [clip(f"e{i}", "test", cuts=["b-1", f"b-{i + 10}", f"b-{i + 1000}", f"b-{i + 9000}"]) for i in range(80)]
    rows += [clip(f"u{i}", "train", cuts=["b-1", "b-2", "b-3"]) for i in range(10)] + [clip(f"v{i}", "test", cuts=["b-1", "b-2", "b-3"]) for i in range(10)]
    got = pairs(clips(spark, rows))
    assert got == {(f"e{i}", f"t{i}") for i in range(80)} | {(f"v{i}", f"u{j}") for i in range(10) for j in range(10)}


def test_empty_and_report(spark):
    assert pairs(clips(spark, [])) == set()
    assert overlap.overlap_report(clips(spark, [])).count() == 0
    r = overlap.overlap_report(clips(spark, [clip("a", sha=SHA), clip("b", "test", sha=SHA, provenance=None)])).collect()
    assert [(x.split, x.provenance, x.n_clips, x.n_overlapping, x.n_pairs) for x in r] == [("test", "unknown", 1, 1, 1)]


def test_agreement_of_many_pairs():
    import numpy as np

    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (3, 5), (9, 7), (40, 44)):
        a, b = rng.integers(0, 5, (50, n)), rng.integers(0, 5, (50, m))
        full = overlap.agreement(a, b, n, m)
        assert full.tolist() == [lcs(x.tolist(), y.tolist()) for x, y in zip(a, b)]
        need = max(1, min(n, m) - 2)
        near = overlap.agreement(a, b, n - need, m - need)
        assert [x >= need for x in near] == [x >= need for x in full] and (near <= full).all()


def test_heavy_segments_files_and_links_are_cut_into_cells(spark, monkeypatch):
    """A third of the clips have one file; others are made of heavy inserts only. Cells are small, so each of them is cut."""
    from tideline.plans import skew

    monkeypatch.setattr(skew.join_grid, "__defaults__", (7,))
    rows = [clip(f"t{i:03d}", "train", sha=SHA) for i in range(30)] + [clip(f"e{i:03d}", "test", sha=SHA) for i in range(20)]
    few = ["b-1", "b-2", "b-3", "b-4"]
    rng = random.Random(5)
    strings = [[rng.choice(few) for _ in range(8)] for _ in range(60)]
    rows += [clip(f"s{i:03d}", ("train", "calib")[i % 2], cuts=x) for i, x in enumerate(strings)]
    df = clips(spark, rows)
    want = {(f"e{i:03d}", f"t{j:03d}") for i in range(20) for j in range(30)}
    want |= {(f"s{i:03d}", f"s{j:03d}") for i in range(1, 60, 2) for j in range(0, 60, 2) if lcs(strings[i], strings[j]) >= 6}
    assert pairs(df) == want and len(want) > 620
    report = {(r.split, r.n_clips, r.n_overlapping, r.n_pairs, r.n_same_file) for r in overlap.overlap_report(df).collect()}
    edit = {p for p in want if p[0][0] == "s"}
    assert report == {("test", 20, 20, 600, 600), ("calib", 30, len({p[0] for p in edit}), len(edit), 0)}
    cl = [r for r in overlap.class_report(df).collect() if r.kind == "file"]
    assert len(cl) == 50 and all(r.n_links == 1 for r in cl)
