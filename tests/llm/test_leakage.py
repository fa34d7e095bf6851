import random

from tideline.llm import leakage

WORDS = [f"w{i:03d}" for i in range(400)]
INTRO = "Decide whether the clip below breaks a rule and say which one it is."


def build(seed=5):
    rng = random.Random(seed)
    items = [(i, INTRO + " " + " ".join(rng.choice(WORDS).title() for _ in range(60))) for i in range(40)]
    docs, want = [], set()
    for d in range(160):
        filler = [rng.choice(WORDS) for _ in range(40)]
        kind, i = d % 8, rng.randrange(40)
        body = items[i][1].split()[len(INTRO.split()) :]
        a = rng.randrange(0, 20)
        if kind == 0:
            part = body
        elif kind == 1:
            part = body[a : a + 24]
        elif kind == 2:
            part = [f"<b>{w}</b>" if rng.random() < 0.3 else w for w in body[a : a + 30]]
        elif kind == 3:
            part = list(body[a : a + 40])
            for k in (4, 15, 27):
                part[k] = "altered"
        elif kind == 4:
            part = " ".join(body[a : a + 26]).upper().replace("W", "W­").split(" ")
        elif kind == 5:
            part = body[a : a + 12]  # a short quote
        elif kind == 6:
            part = INTRO.split()
        else:
            part = list(body[a : a + 24])
            for k in range(0, 24, 4):
                part[k] = "altered"
        if kind < 5:
            want.add((d, i))
        docs.append((d, " ".join([*filler[:20], *part, *filler[20:]])))
    return docs, items, want


def got(spark, docs, items, **k):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as ids", "2 as item_id", "3 as k")
    i = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as n", "'s' as suite")
    return {(r.doc_id, r.item_id) for r in leakage.leaks(d, i, **k).collect()}


def test_planted_passages(spark):
    docs, items, want = build()
    assert got(spark, docs, items) == want


def test_blocks_of_items_change_nothing(spark):
    """Down to the lengths of passages; items of an opening of their own, of which few are in one block, among them."""
    docs, items, want = build()
    rng = random.Random(9)
    mine = "these nine words are how eight of us begin"
    items += [(200 + i, mine + " " + " ".join(rng.choice(WORDS) for _ in range(30))) for i in range(8)]
    docs += [(500 + i, items[40 + i][1]) for i in range(8)]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    results = [{tuple(r) for r in leakage.leaks(d, i, block_bytes=n).collect()} for n in (10**9, 9000, 4000)]
    assert results[0] == results[1] == results[2]
    assert {r[:2] for r in results[0]} == want | {(500 + k, 200 + k) for k in range(8)}
    assert all(r[2] == 30 for r in results[0] if r[0] >= 500)


def test_equal_items_are_reported_each_and_no_opening(spark):
    rng = random.Random(11)
    text = " ".join(rng.choice(WORDS) for _ in range(50))
    assert got(spark, [(1, "so " + text)], [(i, text) for i in range(7)]) == {(1, i) for i in range(7)}


def test_longest_run_against_all_runs():
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (1, 23, 24, 40, 90):
        for p in (0.02, 0.1, 0.2):
            c = rng.random(n) > p
            runs = [e - s for s in range(n) for e in range(s + 24, n + 1) if 10 * (~c[s:e]).sum() <= e - s]
            assert leakage.longest(c) == max(runs, default=0)


def test_a_passage_repeated_many_times(spark):
    docs, items, _ = build()
    assert got(spark, [(1, (items[3][1] + " ") * 400)], items) == {(1, 3)}


def test_against_brute_force(spark):
    """Every window of an item against every place of a document."""
    docs, items, _ = build(8)
    bodies = {r.item_id: list(r.body) for r in leakage.bodies(spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    want = set()
    import pyarrow as pa

    for d, text in docs:
        w = leakage.words(pa.array([text])).to_pylist()[0]
        for i, b in bodies.items():
            if any(sum(x != y for x, y in zip(b[s : s + 24], w[o : o + 24])) <= 2 and len(w[o : o + 24]) == 24 for s in range(len(b) - 23) for o in range(len(w) - 23) if b[s + 3] == w[o + 3] or b[s + 11] == w[o + 11] or b[s + 19] == w[o + 19]):
                want.add((d, i))
    assert want <= got(spark, docs, items)


def test_nulls_empty_and_long(spark):
    docs, items, _ = build()
    odd = [(1000, None), (1001, ""), (1002, " \n "), (None, docs[0][1]), (1003, docs[0][1]), (1004, "zz " * 60_000 + docs[0][1])]
    r = got(spark, [docs[0], *odd], [*items, (99, None), (None, "x"), (98, ""), items[0]])
    assert {d for d, _ in r} == {0, 1003, 1004}
    assert got(spark, [], items) == set() and got(spark, docs, []) == set()
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "'s' as suite")
    assert leakage.leak_report(d, i).agg({"n_documents": "sum"}).collect()[0][0] == 100
