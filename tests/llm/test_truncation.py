import random

from tests.llm.fixtures import clip, clips, null_clip
from tideline.llm import truncation

ACTORS = ["a cyclist", "the referee", "two cleaners", "a masked teenager"]
ACTS = ["dragged a speaker across the floor", "climbed the scaffold", "waved a printed banner", "broke a window pane"]
ENDS = ["when the second reviewer joined", "because the splice was late", "before the policy swap"]


def corpus(n=240, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        place = "".join(rng.choice(["Al", "Bo", "Ce", "Du", "Fe", "Gro"]) for _ in range(3)).title() + rng.choice(["holm", "wick", "ton"])
        title = f"Night shift at {place} {rng.choice(['Harbour', 'Market', 'Tunnel'])} with {rng.choice(['a torn poster', 'the red crate'])}"
        desc = " ".join(f"The analyst noted that {rng.choice(ACTORS)} {rng.choice(ACTS)} {rng.choice(ENDS)}." for _ in range(2))
        rows.append([f"c{i:04d}", title, desc])
    return rows


def found(df):
    return {(r.id, r.field) for r in truncation.truncated(df).select("id", "field").distinct().collect()}


def make(spark, rows):
    return clips(spark, [clip(i, title=t, description=d) for i, t, d in rows] + [null_clip()])


def test_cut_and_complete_values(spark):
    rows = corpus()
    cut = set()
    for k in range(0, 60, 4):
        rows[k][1] = rows[k][1][:-4] if k % 8 else rows[k][1].rsplit(" ", 2)[0]
        cut.add((rows[k][0], "title"))
        words = rows[k][2].split(" ")
        rows[k][2] = " ".join(words[:-3]) + ("…" if k % 8 else "")
        cut.add((rows[k][0], "description"))
    for k in range(61, 100, 3):  # complete without a full stop, with a closing that recurs
        rows[k][2] += " to be continued..." if k % 2 else " [2/5]"
    rows.append(["x1", "", "  "])
    rows.append(["x2", None, None])
    rows.append(["x3", "Night shift at Alboce�", None])
    rows.append(rows[0])
    got = found(make(spark, rows))
    assert ("x3", "title") in got
    got.discard(("x3", "title"))
    assert len(got - cut) == 0
    assert len(cut - got) <= 2


def test_copies_that_end_at_a_sentence(spark):
    whole = "Speech about Alboce at 02:31:07 names the crate, frame 1234. Then 17 people left at 03:00:00. All of it was recorded."
    rows = corpus(60) + [["long", "clip", whole], ["short", "clip", whole[: whole.index(" All")]]]
    got = found(make(spark, rows))
    assert ("short", "description") in got and ("long", "description") not in got


def test_empty_table_and_long_text(spark):
    assert found(clips(spark, [])) == set()
    assert found(make(spark, [["a", "x" * 70_000, "word " * 20_000 + "."]])) <= {("a", "title")}
    r = truncation.truncation_report(make(spark, corpus(30))).collect()
    assert {x.field for x in r} == {"title", "description"} and all(0 <= x.share_truncated <= 1 for x in r)


def words(rng, n):
    return " ".join("".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(n))


def test_copies_of_plain_words(spark):
    """No digits, any length: what counts is that chance would not bring the shared part about."""
    rng = random.Random(6)
    rows = corpus(80)
    for k in range(12):
        t = words(rng, 14).capitalize() + ". " + words(rng, 9).capitalize() + "."
        rows += [[f"long{k}", "clip", t], [f"short{k}", "clip", t[: t.index(".") + 1]]]
    got = {i for i, f in found(make(spark, rows)) if f == "description"}
    assert {f"short{k}" for k in range(12)} <= got and not any(i.startswith("long") for i in got)


def test_whole_endings_that_look_broken(spark):
    odd = ["Talk about R&D", "Evening Q&A", "Calls with AT&T", "Files in C:\\cafe", "Proof that a <b", "Why 3 < 4 &c"]
    rows = corpus(120) + [[f"odd{k}", t, None] for k, t in enumerate(odd)]
    assert not {i for i, _ in found(make(spark, rows)) if i.startswith("odd")}
    rows = corpus(120) + [["a", "Night shift at Alboce Har\\u00", None], ["b", "Night shift at Alboce Harbour with the red cr <b", None], ["c", "Night shift at Alboce Harbour with the red &am", None]]
    assert {("a", "title"), ("b", "title"), ("c", "title")} <= found(make(spark, rows))


def test_neighbours_against_all_pairs(spark):
    """Every value is compared with all others; partitions end anywhere, a third of the values open alike."""
    rng = random.Random(7)
    texts = {"".join(rng.choice("ab. ") for _ in range(rng.randint(1, 7))) for _ in range(400)} | {"hot " + "".join(rng.choice("xy…") for _ in range(rng.randint(0, 5))) for _ in range(200)} | {"x!", "x", "x! y", "長い", "長い話", "é", "éa", "😀", "😀b"}
    texts = [t for t in texts if t.strip()]
    core = lambda t: truncation._SOFT.sub("", t)
    want = {(f, core(v)) for f in ("title", "description") for v in texts for w in texts if core(w) == w and core(v) and truncation._goes_on(core(v), w)}
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            v = spark.createDataFrame([(f, t, "i") for f in ("title", "description") for t in texts], "field string, value string, id string")
            got = {tuple(r) for r in truncation.truncated_copies(v).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert got == want


def test_contexts_against_plain_prefixes():
    """Equal hashes exactly where what stands before is equal, whatever phrases are worked on together."""
    rng = random.Random(8)
    fm = truncation.Forms("title", frozenset("abcd"), frozenset("ab"))
    rows = [[rng.choice(["a", "B", "c", "Zeta", "zeta", "12", "!"]) for _ in range(rng.randint(0, 9))] for _ in range(300)]
    j, at, keys = fm.contexts(rows)
    f = [[truncation.form(t, fm.known) for t in r] for r in rows]
    o = [[x if x in fm.common or not x[0].isalpha() else "W" if t[0].isupper() else "w" for x, t in zip(a, r)] for a, r in zip(f, rows)]
    places = [(r, p) for r in range(len(rows)) for p in range(len(rows[r]) + 1)]
    assert [p for _, p in places] == j.tolist() and [fm.names[x] for x in at] == [f[r][p] if p < len(f[r]) else "$" for r, p in places]
    for k, plain in enumerate((lambda r, p: tuple(f[r][:p]), lambda r, p: tuple(o[r][:p]), lambda r, p: tuple(f[r][max(0, p - 4) : p]), lambda r, p: tuple(f[r][max(0, p - 2) : p]))):
        both = {(int(keys[k, i]), plain(r, p)) for i, (r, p) in enumerate(places)}
        assert len(both) == len({x for x, _ in both}) == len({y for _, y in both})
    one = fm.contexts(rows[7:8])[2]
    first = places.index((7, 0))
    assert (one == keys[:, first : first + one.shape[1]]).all()
