import random

import numpy as np

from tideline.llm import pii
from tideline.llm.boosting import Trees

FAMILIES = [a + b for a in ("Hask", "Vand", "Moro", "Tarn", "Sel") for b in ("owska", "lund", "ner", "etti", "ström", "dahl")]
#: Some of the names are in the public list of the sample, most are not and become known where a title or label introduces them.
GIVENS = ["Johanna", "Quillan", "Ottoline", "Thandiwe", "Ximo", "Laura", "Eirlys", "Peter", "Wenzel", "Ludmila"]
HOSTS = ["gmail.com", "posteo.net", "mail.kundenhof.de", "correos-sur.es", "uni-halle.edu", "tarnley.co.uk"]


def corpus(n=600, seed=2):
    """Texts and their mentions (kind, start)."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        text, marks = "", []

        def add(s, kind=None):
            nonlocal text
            if kind:
                marks.append((kind, len(text)))
            text += s

        for _ in range(rng.randint(2, 5)):
            name = f"{rng.choice(GIVENS)} {rng.choice(FAMILIES)}"
            mail = f"{rng.choice('abcdef')}{rng.randint(10, 99)}@{rng.choice(HOSTS)}"
            d = lambda n, first="123456789": rng.choice(first) + "".join(rng.choice("0123456789") for _ in range(n - 1))
            phone = rng.choice([f"{d(3, '2345678')}-{d(3, '234678')}-{d(4)}", f"020 8{d(3)} {d(4)}", f"+44 7{d(3)} {d(6)}", f"({d(3, '2345678')}) {d(3, '234678')}-{d(4)}", f"+49 89 {d(6)}", f"0221/{d(6)}", f"+34 6{d(2)} {d(3)} {d(3)}"])
            num = rng.choice([f"{d(3, '12345678')}-{d(2)}-{d(4)}", f"{rng.choice('ABCEGHJ')}{rng.choice('ABCEGHJ')}{d(6)}C", f"X-{d(7)}-Q", f"{d(8)}{rng.choice('TRWAGM')}", f"C{d(8)}"])
            street = f"{rng.randint(1, 300)} {rng.choice(['Galmo', 'Yarde', 'Fenwi'])}{rng.choice(['by', 'ton'])} {rng.choice(['Road', 'Lane', 'Avenue'])}"
            k = rng.randrange(8)
            if k == 0:
                add("Please call "), add(name, "name"), add(" on "), add(phone, "phone"), add(" before noon. ")
            elif k == 1:
                add("Reporter: "), add(name, "name"), add("; mail <"), add(mail, "email"), add("> "), add("was closed. ")
            elif k == 2:
                add("The form shows SSN "), add(num, "id_number"), add(" next to a crate. ")
            elif k == 3:
                add("Witness "), add(name, "name"), add(" lives at "), add(street, "address"), add(" and left. ")
            elif k == 4:
                add(f"Order {rng.randint(100000000, 999999999)} covers 12 reels. Ticket {rng.randint(200, 800)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)} stays open. ")
            elif k == 5:
                add(f"On 2025-0{rng.randint(1, 9)}-1{rng.randint(0, 9)} at 03:{rng.randint(10, 59)}:10 the crowd at Elkstoton Quay was calm. ")
            elif k == 6:
                add(f"@nightowl{rng.randint(10, 99)} pinned the rule; path s3/ab12/part@{rng.randint(100, 999)} is stale. ")
            else:
                add("Passport no. "), add(num, "id_number"), add(" was seen. ")
        out.append((text, marks))
    return out


def learnt(texts):
    """What :func:`pii.fit` does, for a list."""
    n = pii.cue_counts(texts)
    least = lambda k: 3 if k[0] == "g" else 0 if k == "t" else len(texts) // 100 + 1
    return pii.Detector().learn({k: c for k, c in n.items() if c >= least(k)})


def test_held_out_accuracy(spark):
    """Names, hosts and numbers none of which the labelled sample has, in sentences that it has not."""
    data = corpus()
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(data)], "doc_id bigint, text string").selectExpr("*", "'k' as kind", "1 as start_pos")
    got = {(r.doc_id, r.kind, r.start_pos) for r in pii.mentions(d, learnt([t for t, _ in data[:300]])).collect() if r.doc_id >= 300}
    want = {(i, k, a) for i, (_, m) in enumerate(data) if i >= 300 for k, a in m}
    for kind in pii.KINDS:
        g, w = {x for x in got if x[1] == kind}, {x for x in want if x[1] == kind}
        assert len(g & w) >= 0.97 * len(w) and len(g & w) >= 0.97 * len(g), kind


def test_redaction_leaves_the_rest(spark):
    data = corpus(200, 9)
    det = learnt([t for t, _ in data])
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(data)], "doc_id bigint, text string")
    texts = {r.doc_id: r.text for r in pii.redact(d, det).collect()}
    spans = {}
    for r in pii.mentions(d, det).collect():
        spans.setdefault(r.doc_id, []).append((r.start_pos, r.end_pos, r.kind, r.mention))
    for i, (t, _) in enumerate(data):
        back, at = texts[i], 0
        for a, b, kind, s in sorted(spans.get(i, [])):
            assert t[a:b] == s
            back = back.replace(f"[{kind.upper()}]", s, 1)
        assert back == t


def test_nulls_empty_and_long(spark):
    data = corpus(100, 3)
    det = learnt([t for t, _ in data])
    long = "z " * 50_000 + "Please call Laura Hasklund on 212-555-0123 before noon."
    d = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (None, data[0][0]), (4, long), (5, long)], "doc_id bigint, text string")
    m = {(r.doc_id, r.kind, r.start_pos) for r in pii.mentions(d, det).collect()}
    assert m == {(i, k, a) for i in (4, 5) for k, a in (("name", 100_012), ("phone", 100_030))}
    assert {r.doc_id: r.n_redacted for r in pii.redact(d, det).collect()} == {1: 0, 2: 0, 3: 0, 4: 2, 5: 2}
    assert pii.mentions(d.limit(0)).count() == 0 and pii.redact(d.limit(0)).count() == 0


def test_offsets_are_characters():
    det = learnt([t for t, _ in corpus(150, 4)])
    t = "🎬🎬 片段 Please call Zoë Morodahl on 212-555-0123 before noon."
    assert [(k, t[a:b]) for k, a, b, _ in det.find([t])[0]] == [("name", "Zoë Morodahl"), ("phone", "212-555-0123")]


def test_trees_learn_and_calibrate():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    t = Trees().fit(x[:2000], y[:2000]).calibrate(x[2000:3000], y[2000:3000])
    p = t.probability(x[3000:])
    assert ((p > t.threshold) == (y[3000:] > 0)).mean() > 0.95
    assert abs(p.mean() - y[3000:].mean()) < 0.05
