"""Problem 2: titles and descriptions that lost their ends.

Self-join by prefix, on two levels.

* Copies: the value is a strict prefix of a longer value of the same field. Values are sorted; those that begin with a value
  stand right behind it, so each is compared with its neighbour and no opening, however common, is a group. Values of any length
  and wording are looked up. A shared part may be chance where values are written after patterns, so it counts if the
  model of the phrases (below) says that chance would not bring it about: log2 of its probability under the last four words,
  plus what its numbers and rare words weigh, must exceed log2 of the number of pairs of values.
* Phrases: values are written after patterns, so the end of a cut value is a strict prefix of longer phrases elsewhere. The
  last phrase of a value (the whole title, the last sentence of a description) is turned into words, with numbers and rare
  words as blanks. What stands before each word is hashed as prefixes of fixed lengths: the whole phrase so far, its outline (all but
  the commonest words as blanks), the last 4 words and the last 2. The ends of values are looked up among these prefixes of all
  phrases: a value is cut if the text of others goes on where it ends, or if its last word is a strict prefix of the word that
  stands there elsewhere.

Marks of a loss (broken characters, escapes, entities and tags, ellipses) are taken off before anything is looked up. A broken
character and a broken escape count as a loss by themselves; an ellipsis does unless phrases of the same wording often close with
it, as in "to be continued..."; what may be a whole ending ("R&D", "a <b") is no evidence by itself.

Frequent words are those with more than one in ``WORDS`` of all words of their field (and more than three): fewer than WORDS,
whatever the size of the table. In a larger table a word must be used more often to be frequent, so shares and not sizes decide;
only under 3 * WORDS words of text is the bar three uses. Nulls, blank and complete values are no case, nor are rows without
an id. Repeated deliveries count once. Counts cover the whole table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tideline.llm.common import latest, plain
from tideline.plans.skew import HEAVY, join_unique
from tideline.session import Rounds, cut_lineage

FIELDS = ("title", "description")
WORDS = 10_000
COMMON = 60
#: Bits that a digit and a rare word weigh (a rare word has less than one in WORDS of all words, that is 13 bits).
DIGIT_BITS, RARE_BITS = 2.0, 10.0
#: Least number of other phrases from which a decision is made, and the share of them that may end where a cut one does: whole
#: phrases, outlines, the last four words, the last two. The narrower the wording, the more of those that end here may be cut too.
SUPPORT, ENDS = 4, (0.8, 0.6, 0.35, 0.35)
#: Most bits of the bitmap of prefixes that are asked about (16 MB).
BITS = 1 << 27

_SOFT = re.compile(r"\s*(?:…|\.\.\.|\[\s*(?:…|\.\.\.)\s*\]?)\s*$")
_SURE = re.compile(r"\s*(?:\ufffd+|\\u[0-9a-fA-F]{0,3})\s*$")
_MAYBE = re.compile(r"\s*(?:\\u[0-9a-fA-F]{4}|\\|&#?[a-z0-9]{1,5}|</?[a-z]{0,6})\s*$")
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿]|\d+(?:[.,:]\d+)*|[^\W\d_]+|[^\w\s]|_")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。!?])")
_STOPS = frozenset(".。!?!?")
_MIX, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text)


def unmarked(text: str) -> tuple[str, int]:
    """The text without marks of a loss at its end; 2 if the mark is a loss for sure, 1 if an ellipsis, 0 if none or one that may be
    the value's own."""
    # Every mark ends in one of these or begins among the last few characters; a single full stop is the common case.
    end = text.rstrip()[-8:]
    if not (end.endswith(("…", "...", "]", "\ufffd")) or "\\" in end or "&" in end or "<" in end):
        return text, 0
    for rx, mark in ((_SURE, 2), (_SOFT, 1), (_MAYBE, 0)):
        if m := rx.search(text):
            return text[: m.start()], mark
    return text, 0


def phrases(text: str) -> list[str]:
    return [p for p in _SENTENCE.split(text) if p and not p.isspace()]


def form(tok: str, known: frozenset[str]) -> str:
    if tok[0].isdigit():
        return "#"
    low = tok.lower()
    if not tok[0].isalpha() or low in known:
        return low
    return "W" if tok[0].isupper() else "w"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


class Forms(dict):
    """word -> number of its form and of its part in an outline, for one field; number 0 is the end of a phrase, 1 what stands
    before its start."""

    def __init__(self, field: str, known: frozenset[str], common: frozenset[str]) -> None:
        self.known, self.common = known, common
        self.salt = [np.uint64(xxh64_intdigest(f"{k}{field}")) for k in "^~42"]
        self.names, self.number = ["$", ""], {"$": 0, "": 1}
        self.hashes = np.array([xxh64_intdigest("$"), xxh64_intdigest("")], np.uint64)

    def _number(self, f: str) -> int:
        if f not in self.number:
            self.number[f] = len(self.names)
            self.names.append(f)
        return self.number[f]

    def __missing__(self, tok: str) -> tuple[int, int]:
        f = form(tok, self.known)
        o = f if f in self.common or not f[0].isalpha() else "W" if tok[0].isupper() else "w"
        got = self._number(f), self._number(o)
        if len(self) < 200_000:
            self[tok] = got
        return got

    def contexts(self, rows: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place j = 0..length of each phrase: j, the form that stands there (0 at the end), and the hashes of what stands
        before it: the whole phrase so far, its outline, the last four words, the last two. One row of places for all phrases."""
        pairs = [self[t] for r in rows for t in r]
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        total = int(size.sum()) + len(rows)
        if len(self.hashes) < len(self.names):
            more = [xxh64_intdigest(x) for x in self.names[len(self.hashes) :]]
            self.hashes = np.concatenate([self.hashes, np.array(more, np.uint64)])
        end = np.cumsum(size + 1) - 1
        word = np.ones(total, bool)
        word[end] = False
        j = np.arange(total) - np.repeat(end - size, size + 1)
        form_at, out_at = np.zeros(total, np.int64), np.zeros(total, np.int64)
        both = np.array(pairs, np.int64).reshape(-1, 2)
        form_at[word], out_at[word] = both[:, 0], both[:, 1]
        h, o = self.hashes[form_at], self.hashes[out_at]
        keys = np.zeros((4, total), np.uint64)
        # Chained hashes: place by place over all phrases that are so long.
        whole, out = np.full(total, self.salt[0]), np.full(total, self.salt[1])
        order = np.argsort(j, kind="stable")
        steps = np.searchsorted(j[order], np.arange(1, int(size.max(initial=0)) + 2))
        for a, b in zip(steps[:-1], steps[1:]):
            at = order[a:b]
            whole[at] = _mixed(whole[at - 1] * _ODD + h[at - 1])
            out[at] = _mixed(out[at - 1] * _ODD + o[at - 1])
        keys[0], keys[1] = whole, out
        for row, n in ((2, 4), (3, 2)):
            k = np.full(total, self.salt[row])
            for back in range(n, 0, -1):
                before = np.full(total, self.hashes[1])
                far = j >= back
                before[far] = h[np.flatnonzero(far) - back]
                k = _mixed(k * _ODD + before)
            keys[row] = k
        return j, form_at, keys


def _parts(field: str, value: str) -> tuple[list[list[str]], int]:
    """The words of each phrase of a value without marks of a loss, and what the mark says."""
    text, mark = unmarked(value)
    return [tokens(p) for p in ([text] if field == "title" else phrases(text))], mark


def _by_field(b: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    f = np.array(b.column("field").to_pylist(), object)
    for field in FIELDS:
        at = np.flatnonzero(f == field)
        if len(at):
            yield field, b.take(pa.array(at))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["field", "t", "n"])

    for b in batches:
        for field, part in _by_field(b):
            for v in part.column("value").to_pylist():
                n.update((field, t) for p in _parts(field, v)[0] for t in p if t[0].isalpha())
        if len(n) > 200_000:
            yield out()
            n.clear()
    yield out()


def _frequent(values: DataFrame) -> tuple[dict[str, frozenset[str]], dict[str, frozenset[str]]]:
    """Per field the frequent words (fewer than WORDS) and the commonest (fewer than COMMON)."""
    words = values.mapInArrow(_word_counts, "field string, t string, n bigint").groupBy("field", F.lower("t").alias("t")).agg(F.sum("n").alias("n"))
    words = cut_lineage(words)
    total = words.groupBy("field").agg(F.sum("n").alias("all"))
    rows = words.join(F.broadcast(total), "field").filter(F.col("n") > F.greatest(F.lit(3), F.floor(F.col("all") / WORDS))).collect()
    known = {f: frozenset(r.t for r in rows if r.field == f) for f in FIELDS}
    return known, {f: frozenset(r.t for r in rows if r.field == f and r.n > r["all"] // COMMON) for f in FIELDS}


_ASKED = "id string, field string, part string, rank int, key bigint, own string, raw string, bits double, mark int"


def _questions(known: dict[str, frozenset[str]], common: dict[str, frozenset[str]]):
    """For each value: what follows its whole last phrase (part 'end'), what stands at its last word ('word'); for copies also
    how likely each of their words is ('chain'), and what its numbers and rare words weigh. Values without words have no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = {f: Forms(f, known[f], common[f]) for f in FIELDS}
        for b in batches:
            for field, part in _by_field(b):
                fm = forms[field]
                ids, values, copies = (part.column(c).to_pylist() for c in ("id", "value", "copy"))
                out = []
                add = out.append
                rows, about = [], []
                for i, v, c in zip(ids, values, copies):
                    ps, mark = _parts(field, v)
                    ps = ps if c else ps[-1:]
                    rows += ps
                    about += [(i, v, c, mark, k == len(ps) - 1) for k in range(len(ps))]
                j, at, keys = fm.contexts(rows)
                keys = keys.view(np.int64)
                e = -1
                for r, (i, v, c, mark, last) in zip(rows, about):
                    start, e = e + 1, e + 1 + len(r)
                    if c:
                        for p in range(len(r)):
                            w = DIGIT_BITS * sum(map(str.isdigit, r[p])) if r[p][0].isdigit() else RARE_BITS if fm.names[at[start + p]] in ("W", "w") else 0.0
                            add((i, field, "chain", 2, int(keys[2, start + p]) if p else None, fm.names[at[start + p]], "", w, mark))
                    if not last or not r:
                        continue
                    raw, own = r[-1].lower(), fm.names[at[e - 1]]
                    # A sentence that closes with its full stop ends where others may go on: only phrases without one are asked about.
                    stop = field != "title" and r[-1] in _STOPS
                    if stop and not (mark or c):
                        continue
                    for rank in range(4) if not stop else ():
                        add((i, field, "end", rank, int(keys[rank, e]), own, raw, 0.0, mark))
                        if r[-1][0].isalpha() and len(r) > 1 and (mark or not v[-1].isspace()):
                            add((i, field, "word", rank, int(keys[rank, e - 1]), own, raw, 0.0, mark))
                    if stop:
                        add((i, field, "none", 0, None, own, raw, 0.0, mark))
                if out:
                    c = list(zip(*out))
                    types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types)], names=[x.split()[0] for x in _ASKED.split(", ")])

    return run


def _bitmap(keys: DataFrame, n: int) -> np.ndarray:
    """Bit (key mod size) is set for each of n keys: 64 bits per key, BITS at most. A bit too many costs a row, nothing else."""
    size = min(BITS, 1 << max(12, int(64 * n).bit_length()))
    rows = keys.groupBy(F.floor(F.pmod("key", F.lit(size)) / 64).alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(key, 64) as int))")).alias("v")).collect()  # at most BITS / 64
    out = np.zeros(size // 64, np.int64)
    out[[r.k for r in rows]] = [r.v for r in rows]
    return out.view(np.uint64)


def _continuations(known: dict[str, frozenset[str]], common: dict[str, frozenset[str]], asked):
    """key, nxt, n: how often which form follows what is asked about, in all phrases of all values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = asked.value
        mask = np.uint64(len(bits) * 64 - 1)
        forms = {f: Forms(f, known[f], common[f]) for f in FIELDS}
        held: dict[str, list] = {f: [] for f in FIELDS}

        def merged(field: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            k, x, n = (np.concatenate(c) for c in zip(*held[field]))
            _, first, inv = np.unique(_mixed(k ^ forms[field].hashes[x]), return_index=True, return_inverse=True)
            return k[first], x[first], np.bincount(inv, n).astype(np.int64)

        def out(field: str) -> pa.RecordBatch:
            k, x, n = merged(field)
            held[field] = []
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(np.array(forms[field].names, object)[x], pa.string()), pa.array(n)], names=["key", "nxt", "n"])

        for b in batches:
            for field, part in _by_field(b):
                rows = [p for v in part.column("value").to_pylist() for p in _parts(field, v)[0]]
                j, at, keys = forms[field].contexts(rows)
                inner = np.flatnonzero(j > 0)
                k, x = keys[:, inner].ravel(), np.tile(at[inner], 4)
                low = k & mask
                hit = np.flatnonzero((bits[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1))
                if len(hit):
                    held[field].append((k[hit], x[hit], np.ones(len(hit))))
                    if sum(len(h[0]) for h in held[field]) > 2_000_000:
                        held[field] = [merged(field)]
                        if len(held[field][0][0]) > 1_000_000:
                            yield out(field)
        for field in FIELDS:
            if held[field]:
                yield out(field)

    return run


def _values(clips: DataFrame) -> DataFrame:
    """id, field, value, provenance; blank values dropped."""
    df = latest(clips, title=F.col("metadata_adversarial.title"), description=F.col("metadata_adversarial.description"), provenance=plain(F.col("source.provenance")))
    df = df.select("id", "provenance", F.explode(F.create_map(*[x for f in FIELDS for x in (F.lit(f), F.col(f))])).alias("field", "value"))
    return df.filter(F.length(F.trim("value")) > 0)


def _goes_on(short: str, long: str) -> bool:
    """Whether ``long`` is ``short`` and more words or letters."""
    return len(long) > len(short) and long.startswith(short) and any(map(str.isalnum, long[len(short) :]))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the sorted (field, s, whole) of a partition: rows 'cut' for each s that a later whole one goes on from, 'open' for those that
    begin the last whole one or stand behind it, which the next partition decides, and 'first' for its first whole one (and those
    behind it, up to the first that is not just the same with other punctuation at the end)."""
    names = ["kind", "field", "s", "part"]
    number = TaskContext.get().partitionId()
    waiting: list[tuple[str, str]] = []
    head, done = "", False

    def rows(kind: str, what: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(what), pa.string()), pa.array([w[0] for w in what], pa.string()), pa.array([w[1] for w in what], pa.string()), pa.array([number] * len(what), pa.int32())], names=names)

    for b in batches:
        cut, first = [], []
        for field, s, whole in zip(*(b.column(c).to_pylist() for c in ("field", "s", "whole"))):
            if whole:
                if not done:
                    first.append((field, s))
                    done = bool(head) and (_goes_on(head, s) or not s.startswith(head))
                    head = head or s
                # Only prefixes of what comes now can still be answered; each that waits is one of the last, or an opening of it.
                still = [w for w in waiting if w[0] == field and s.startswith(w[1])]
                cut += [w for w in still if _goes_on(w[1], s)]
                waiting = [w for w in still if not _goes_on(w[1], s)]
            waiting.append((field, s))
        if cut:
            yield rows("cut", cut)
        if first:
            yield rows("first", first)
    if waiting:
        yield rows("open", waiting)


def truncated_copies(values: DataFrame) -> DataFrame:
    """field, s of different texts (values, without an ellipsis at their end) that a longer value goes on from.

    Sorted neighbours: all values that begin with s stand together right behind s, so the next whole value tells. What the end of
    a partition leaves open is compared with the first value of the next one.
    """
    soft = r"\s*(?:…|\.\.\.|\[\s*(?:…|\.\.\.)\s*\]?)\s*$"
    core = F.regexp_replace("value", soft, "")
    one = values.select("field", core.alias("s"), (core == F.col("value")).alias("whole")).filter("length(s) > 0").groupBy("field", "s").agg(F.max("whole").alias("whole"))
    seen = cut_lineage(one.repartitionByRange("field", "s").sortWithinPartitions("field", "s").mapInArrow(_neighbours, "kind string, field string, s string, part int"))
    # A row per partition: the first values of the next one that has any.
    first = seen.filter("kind = 'first'").groupBy("part").agg(F.collect_list(F.struct("field", "s")).alias("f"))
    first = first.withColumn("f", F.lead("f").over(Window.partitionBy(F.lit(1)).orderBy("part"))).select("part", F.explode("f").alias("nx"))
    left = seen.filter("kind = 'open'").join(F.broadcast(first), "part").filter(F.col("nx.field") == F.col("field"))
    more = F.expr("substring(nx.s, length(s) + 1)")
    left = left.filter(F.col("nx.s").startswith(F.col("s")) & more.rlike(r"[\p{L}\p{N}]")).select("field", "s")
    return seen.filter("kind = 'cut'").select("field", "s").unionByName(left).distinct()


def truncated(clips: DataFrame) -> DataFrame:
    """id, field, provenance, value, evidence: one row per cut value."""
    values = cut_lineage(_values(clips))
    known, common = _frequent(values)
    soft = r"\s*(?:…|\.\.\.|\[\s*(?:…|\.\.\.)\s*\]?)\s*$"
    copies = truncated_copies(values).select("field", F.col("s").alias("_core"), F.lit(True).alias("copy"))
    marked = values.withColumn("_core", F.regexp_replace("value", soft, "")).join(copies, ["field", "_core"], "left").select("id", "field", "value", F.coalesce("copy", F.lit(False)).alias("copy"))
    asked = cut_lineage(marked.mapInArrow(_questions(known, common), _ASKED))
    keys, of = Rounds().put(asked.filter("key is not null").groupBy("key").agg(F.count("*").alias("n")), keys=F.count("*"), rows=F.coalesce(F.sum("n"), F.lit(0)))
    heavy = [r.key for r in keys.filter(F.col("n") > max(10_000, of["rows"] // HEAVY)).collect()] if of["rows"] > 10_000 else []
    bitmap = values.sparkSession.sparkContext.broadcast(_bitmap(keys, of["keys"]))
    follow = values.select("field", "value").mapInArrow(_continuations(known, common, bitmap), "key bigint, nxt string, n bigint")
    # What follows a run of words, in one row per run; slots and words together are bounded by the list of known words. Tasks have
    # added up before, so rows go to their key at once.
    seen = follow.repartition("key").groupBy("key", "nxt").agg(F.sum("n").alias("n"))
    seen = seen.groupBy("key").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("nxt") == "$", F.col("n")).otherwise(0)).alias("ends"), F.map_from_entries(F.collect_list(F.struct("nxt", "n"))).alias("nexts"))
    # Both halves of the join below read it where a key is heavy.
    ans = join_unique(asked, cut_lineage(seen) if heavy else seen, "key", "left", heavy=heavy).withColumn("all", F.coalesce("all", F.lit(0)))
    longer = F.aggregate(F.map_entries("nexts"), F.lit(0).cast("bigint"), lambda a, e: a + F.when(e["key"].startswith(F.col("raw")) & (e["key"] != F.col("raw")) & (F.length(e["key"]) > 1), e["value"]).otherwise(0))
    same = F.coalesce(F.element_at("nexts", F.col("own")), F.lit(0))
    ans = ans.withColumn("longer", F.when(F.col("part") == "word", F.coalesce(longer, F.lit(0)))).withColumn("same", same)
    # Of the contexts with enough phrases the widest wording is asked last: per value the answer of the lowest rank.
    share = F.element_at(F.array(*map(F.lit, ENDS)), F.col("rank") + 1)
    is_end = F.when((F.col("part") == "end") & (F.col("all") > SUPPORT), F.struct("rank", (F.col("ends") <= share * F.col("all")).alias("cut")))
    # The value counts itself once among those that have its last word there.
    is_word = (F.col("part") == "word") & (F.col("longer") >= 2) & (F.col("same") <= 1 + F.col("longer") / 2)
    # Of a copy and its longer one neither tells how likely the wording is without them; a first word is taken as certain.
    likely = (F.greatest(F.col("same") - 2, F.lit(0)) + 0.5) / (F.greatest(F.col("all") - 2, F.lit(0)) + 1)
    weight = F.when(F.col("part") == "chain", F.col("bits") + F.when(F.col("key").isNotNull(), -F.log2(F.least(likely, F.lit(1.0)))).otherwise(0.0))
    verdict = ans.groupBy("id", "field").agg(F.min(is_end)["cut"].alias("e"), F.max(F.coalesce(is_word, F.lit(False))).alias("w"), F.sum(weight).alias("bits"), F.max("mark").alias("mark"))
    sizes = values.groupBy("field").agg(F.count("*").alias("n"))
    verdict = verdict.join(F.broadcast(sizes), "field")
    # Broken characters and escapes are a loss whatever stands before; an ellipsis is, unless phrases of this wording close so.
    why = {
        "copy": F.coalesce(F.col("bits") >= F.log2(F.col("n") * (F.col("n") - 1) / 2.0 + 1), F.lit(False)),
        "mark": (F.col("mark") == 2) | (F.col("mark") == 1) & F.coalesce(F.col("e"), F.lit(True)),
        "phrase": F.coalesce("e", F.lit(False)) | F.col("w"),
    }
    found = verdict.select("id", "field", F.array_join(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in why.items()]), lambda x: x.isNotNull()), "+").alias("evidence")).filter("evidence <> ''")
    return values.join(found, ["id", "field"]).select("id", "field", "provenance", "value", "evidence")


def truncation_report(clips: DataFrame) -> DataFrame:
    """Per provenance and field: values, cut values, their share, and the length at which most are cut."""
    values = _values(clips).groupBy(F.coalesce("provenance", F.lit("unknown")).alias("provenance"), "field").agg(F.count("*").alias("n_values"))
    cut = truncated(clips).groupBy(F.coalesce("provenance", F.lit("unknown")).alias("provenance"), "field", F.length("value").alias("len")).agg(F.count("*").alias("c"))
    cut = cut.groupBy("provenance", "field").agg(F.sum("c").alias("n_truncated"), F.max_by("len", F.struct("c", "len")).alias("usual_length"))
    out = values.join(cut, ["provenance", "field"], "left").withColumn("n_truncated", F.coalesce("n_truncated", F.lit(0)))
    return out.withColumn("share_truncated", F.round(F.col("n_truncated") / F.col("n_values"), 6))
