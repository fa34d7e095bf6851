"""Problem 5: passages of evaluation items inside documents.

Prefix-filtered set join over shingles of five words. Every window of ``WINDOW`` words of an item has WINDOW - 4 shingles; if
one word in ten may be altered (``ALTERED`` in a window that lies unluckily), at least ``LEAST`` of them stand unaltered in the
document. The shingles are ordered by how many documents hold them, counted over the whole corpus, and a document must hold one of the
WINDOW - 4 - LEAST + 1 rarest of a window: these are the join tokens, and only they are posted, so a pair of document and item exists only
where both hold such a token, at places between which a passage fits (positional bound). Pairs then need ``LEAST`` shingles
in all, and what is left is verified word by word over item-sized windows of the document: at least WINDOW words of the item in a
row, one in ten altered at most. Passages may be broken by other text of up to ``GAP`` words.

Looks don't count: mark-up, letter case, punctuation, soft hyphens, odd blanks, line breaks and wide characters are taken
away on both sides. Words are what blanks separate; they are compared by 64-bit hashes. The sentence with which items of a language
open alike is no part of an item (:func:`bodies`, computed over all items).

The corpus is read once: words become numbers, and those documents are written that hold LEAST shingles of any item, together
with the counts of shingles over all documents. Which shingles are looked for is a bitmap of at most ``BITS`` bits; where it errs, a
document too many is written. Items are a stated query set: against what was written they are taken in blocks of at most ``BLOCK_BYTES``
of text, each broadcast once, so what is broadcast never grows with the corpus. Results don't depend on the blocks.

Null or blank texts hold nothing; equal documents and equal items are reported each; rows with a null id are dropped; of several
texts of one item_id the first in order counts. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tideline.session import cut_lineage

SHINGLE = 5
WINDOW = 24
ALTERED = 0.1
LEAST = 4
GAP = 40
#: Fewest unaltered words of a passage.
LEAST_WORDS = WINDOW - int(WINDOW * ALTERED)
BLOCK_BYTES = 4_000_000
#: Items that begin with the same so many words and are so many at least open alike, as far as so many of them agree.
OPENING, ALIKE, AGREE = 6, 5, 0.9
#: Most bits of the bitmap of shingles (16 MB); 64 per shingle where that is less.
BITS = 1 << 27

_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(texts: pa.Array) -> pa.Array:
    """Lists of words as they count here."""
    t = texts
    if pc.any(pc.match_substring(t, "&")).as_py():
        t = pc.replace_substring_regex(t, "(?i)&(nbsp|thinsp|ensp|emsp|#160|#xa0);", " ")
        t = pc.replace_substring_regex(t, "&[A-Za-z]{2,8};|&#[0-9xXa-fA-F]{1,7};", "")
    if pc.any(pc.match_substring(t, "<")).as_py():
        t = pc.replace_substring_regex(t, r"(?i)<(br|p|div|li|tr|td)\s*/?>", " ")
        t = pc.replace_substring_regex(t, r"</?[A-Za-z][^<>]{0,60}>", "")
    t = pc.utf8_lower(pc.utf8_normalize(t, "NFKC"))
    t = pc.replace_substring_regex(t, r"[^\pL\pN\s\pZ]+", "")
    return pc.utf8_split_whitespace(pc.utf8_trim_whitespace(t))


def numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, one after the other, and where each text's begin and the last one's end."""
    lists = words(texts)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    off = lists.offsets.to_numpy()
    coded = lists.values.slice(off[0], off[-1] - off[0]).dictionary_encode()
    seen = np.fromiter((xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return seen[coded.indices.to_numpy()] if len(seen) else np.zeros(0, np.uint64), off - off[0]


def shingles(seq: np.ndarray) -> np.ndarray:
    """Codes of the runs of five words of ``seq``."""
    n = len(seq) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    code = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        code = (code ^ seq[k : k + n]) * _MIX
        code ^= code >> np.uint64(29)
    return code


def _inside(at: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text of each place, and whether a shingle from there on ends within it."""
    doc = np.searchsorted(off, at, side="right") - 1
    return doc, at + SHINGLE <= off[np.minimum(doc + 1, len(off) - 1)]


def bodies(items: DataFrame) -> DataFrame:
    """item_id, class (the smallest id with that body), body (words): items without the opening they share with others, at least
    WINDOW words long. Counted over all items: how many different ones begin with the same words, and which word most of
    these have at each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = words(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("item_id"), lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists], names=["item_id", "w"])

    one = items.select("item_id", "text").filter("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    w = cut_lineage(one.mapInArrow(run, "item_id bigint, w array<string>").withColumn("h", F.md5(F.concat_ws(" ", "w"))).withColumn("g", F.md5(F.concat_ws(" ", F.slice("w", 1, OPENING)))))
    differ = w.dropDuplicates(["h"])
    sizes = differ.groupBy("g").agg(F.count("*").alias("size")).filter(F.col("size") >= ALIKE)
    at = differ.join(sizes, "g").select("g", "size", F.posexplode("w").alias("p", "x")).groupBy("g", "size", "p", "x").agg(F.count("*").alias("c"))
    at = at.groupBy("g", "p").agg((F.max("c") >= AGREE * F.first("size")).alias("same"))
    # The opening ends at the first place where too few agree, or behind the last place there is.
    opening = at.groupBy("g").agg(F.coalesce(F.min(F.when(~F.col("same"), F.col("p"))), F.max("p") + 1).alias("n"))
    body = w.join(opening, "g", "left").select("item_id", F.expr("slice(w, coalesce(n, 0) + 1, size(w))").alias("body")).filter(F.size("body") >= WINDOW)
    body = body.withColumn("h", F.md5(F.concat_ws(" ", "body")))
    return cut_lineage(body.join(body.groupBy("h").agg(F.min("item_id").alias("class")), "h").select("item_id", "class", "body"))


def _hashed(body: pa.Array) -> list[np.ndarray]:
    """Word hashes of each body."""
    return [np.fromiter(map(xxh64_intdigest, b), np.uint64, len(b)) for b in body.to_pylist()]


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        c = [shingles(x) for x in _hashed(b.column("body"))]
        if c:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(c)).view(np.int64))], names=["code"])


def _bitmap(body: DataFrame) -> np.ndarray:
    """64 bits a word; bit (code mod size) is set for each shingle of an item. Words are put together by the cluster."""
    n = body.agg(F.coalesce(F.sum(F.size("body")), F.lit(0)).alias("n")).collect()[0].n
    size = min(BITS, 1 << max(12, int(64 * n).bit_length()))
    at = F.pmod("code", F.lit(size))
    rows = body.select("body").mapInArrow(_codes, "code bigint").groupBy(F.floor(at / 64).alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(code, 64) as int))")).alias("v")).collect()  # at most BITS / 64
    out = np.zeros(size // 64, np.int64)
    out[[r.k for r in rows]] = [r.v for r in rows]
    return out.view(np.uint64)


_SCANNED = "doc_id bigint, ids array<bigint>, code bigint, n bigint"


def _scan(bitmap):
    """Documents -> rows (doc_id, ids) of those that hold LEAST shingles of items, and rows (code, n): documents that hold it."""

    def counted(total: dict[int, int]) -> pa.RecordBatch:
        none = pa.nulls(len(total), pa.int64())
        k = np.fromiter(total, np.uint64, len(total)).view(np.int64)
        return pa.RecordBatch.from_arrays([none, pa.nulls(len(total), pa.list_(pa.int64())), pa.array(k), pa.array(list(total.values()), pa.int64())], names=["doc_id", "ids", "code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        mask = np.uint64(len(bits) * 64 - 1)
        total: dict[int, int] = {}
        for big in batches:
            for a in range(0, big.num_rows, 2000):
                b = big.slice(a, 2000)
                ids, off = numbers(b.column("text"))
                code = shingles(ids)
                low = code & mask
                at = np.flatnonzero((bits[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1))
                doc, ok = _inside(at, off)
                at, doc = at[ok], doc[ok]
                if not len(at):
                    continue
                keep = np.flatnonzero(np.bincount(doc, minlength=b.num_rows) >= LEAST)
                o = np.lexsort((code[at], doc))
                c, d = code[at][o], doc[o]
                once = np.concatenate([[True], (c[1:] != c[:-1]) | (d[1:] != d[:-1])])
                for k, n in zip(*(x.tolist() for x in np.unique(c[once], return_counts=True))):
                    total[k] = total.get(k, 0) + n
                if len(keep):
                    parts = [ids[off[k] : off[k + 1]] for k in keep]
                    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
                    none = pa.nulls(len(keep), pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(keep)), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts).view(np.int64))), none, none], names=["doc_id", "ids", "code", "n"])
                if len(total) > 500_000:
                    yield counted(total)
                    total = {}
        if total:
            yield counted(total)

    return run


class Index:
    """Shingles of one block of items, the join tokens among them, and where these stand."""

    def __init__(self, items: list[tuple[int, list[str]]], counts: dict[int, int]) -> None:
        self.ids = [i for i, _ in items]
        self.seqs = [np.fromiter(map(xxh64_intdigest, w), np.uint64, len(w)) for _, w in items]
        codes = [shingles(s) for s in self.seqs]
        self.codes = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.uint64)
        of = [np.searchsorted(self.codes, c) for c in codes]
        # All shingles of all items in one order, item * number of shingles + shingle, and their places.
        every = [x + k * len(self.codes) for k, x in enumerate(of)]
        every = np.concatenate(every) if every else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(x)) for x in of]) if of else every
        o = np.argsort(every, kind="stable")
        self.every, self.place = every[o], place[o]
        n = np.array([counts.get(c, 0) for c in self.codes.view(np.int64).tolist()], np.int64)
        rank = np.lexsort((np.arange(len(n)), n)).argsort()  # rarest first, equally rare ones by their code
        per = WINDOW - SHINGLE + 1
        need = per - LEAST + 1
        owner, pos, token = [], [], []
        for k, x in enumerate(of):
            w = np.lib.stride_tricks.sliding_window_view(rank[x], per)
            first = np.argpartition(w, need - 1, axis=1)[:, :need] if need < per else np.tile(np.arange(per), (len(w), 1))
            p = np.unique(first + np.arange(len(w))[:, None])
            owner.append(np.full(len(p), k)), pos.append(p), token.append(x[p])
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        owner, pos, token = join(owner), join(pos), join(token)
        o = np.argsort(token, kind="stable")
        self.owner, self.pos = owner[o], pos[o]
        self.start = np.searchsorted(token[o], np.arange(len(self.codes) + 1))
        self.length = np.array([len(s) for s in self.seqs])

    def lookup(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``codes`` that hold a shingle of the block, and which."""
        if not len(self.codes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        at = np.flatnonzero(self.codes[k] == codes)
        return at, k[at]

    def shared(self, item: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For shingles k, each asked about one item: those that it has (their places in k) and where it has them."""
        q = item * len(self.codes) + k
        lo = np.searchsorted(self.every, q, "left")
        many = np.searchsorted(self.every, q, "right") - lo
        return _spread(lo, many)


def _spread(start: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of several stretches from ``start``, ``many`` long: which stretch, and each place of it."""
    rep = np.repeat(np.arange(len(many)), many)
    return rep, np.arange(len(rep)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start, many)


def longest(cover: np.ndarray) -> int:
    """Length of the longest run of which at most one place in ten is not covered; 0 if under WINDOW.

    A run from s to e is one if 10 * bad(s, e) <= e - s, that is g[e] <= g[s] for g = 10 * (bad places before) - place; the first
    such s for each e is found in the running maximum of g.
    """
    g = 10 * np.concatenate([[0], np.cumsum(~cover)]) - np.arange(len(cover) + 1)
    first = np.searchsorted(np.maximum.accumulate(g), g)
    best = int((np.arange(len(g)) - first).max())
    return best if best >= WINDOW else 0


def holds(doc: np.ndarray, item: np.ndarray, dpos: np.ndarray, ipos: np.ndarray) -> int:
    """Length of the longest run of item words that the document holds with one in ten altered at most; 0 if under WINDOW.

    dpos, ipos: places of the shared shingles. Words count along the diagonals of these (word by word, so alterations stay
    visible); pieces that follow each other in item and document, at most GAP words apart, add up.
    """
    n = len(item)
    pieces = []
    diag = dpos - ipos
    o = np.argsort(diag, kind="stable")
    edges = np.flatnonzero(np.diff(diag[o])) + 1
    for part in np.split(o, edges) if len(edges) else (o,):
        d = int(diag[part[0]])
        lo, hi = max(0, -d), min(n, len(doc) - d)
        good = (doc[lo + d : hi + d] == item[lo:hi]).nonzero()[0] + lo
        # Equal words belong to a shared shingle if no more than two others stand between any two on the way to it.
        run = np.zeros(len(good), np.int64)
        run[1:] = (good[1:] - good[:-1] > 3).cumsum()
        mine = np.zeros(len(good), bool)
        mine[run[good.searchsorted(ipos[part])]] = True
        good = good[mine[run]]
        # Far parts of one diagonal are still one piece: between them the document has other words.
        pieces.append((int(good[0]) + d, int(good[0]), int(good[-1]) + 1, d, good))
    if sum(len(p[4]) for p in pieces) < LEAST_WORDS:
        return 0
    pieces.sort(key=lambda p: p[:4])
    begin = np.array([p[0] for p in pieces])
    best = 0
    for a_doc, a, b, d, good in pieces:
        cover = np.zeros(n, bool)
        cover[good] = True
        end_i, end_d = b, b + d
        # Of the pieces that begin near where this one ends in the document, each that goes on in the item.
        k = np.searchsorted(begin, end_d - 8)
        while k < len(pieces) and begin[k] <= end_d + GAP:
            _, a2, b2, d2, more = pieces[k]
            if d2 != d and (a2, d2) > (a, d) and b2 > end_i and a2 >= end_i - SHINGLE - 3 and begin[k] >= end_d - 8:
                cover[more] = True
                end_i, end_d = b2, b2 + d2
            k += 1
        if cover.sum() >= LEAST_WORDS:
            best = max(best, longest(cover))
    return best


def _match(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = broadcast.value
        n_items = max(1, len(index.ids))
        for b in batches:
            lists = b.column("ids")
            off = lists.offsets.to_numpy()
            flat = lists.values.to_numpy()[off[0] : off[-1]].view(np.uint64)
            off = off - off[0]
            at, k = index.lookup(shingles(flat))
            doc, ok = _inside(at, off)
            at, k, doc = at[ok], k[ok], doc[ok]
            # Pairs exist where a join token of the item stands in the document with room for a passage around it.
            rep, post = _spread(index.start[k], index.start[k + 1] - index.start[k])
            owner, ipos = index.owner[post], index.pos[post]
            size = np.diff(off)[doc]
            dpos = at - off[doc]
            room = np.minimum(dpos[rep], ipos) + np.minimum((size - dpos)[rep], index.length[owner] - ipos)
            pairs = np.unique((doc[rep] * n_items + owner)[room >= LEAST_WORDS])
            pdoc, pitem = pairs // n_items, pairs % n_items
            first = np.searchsorted(doc, np.arange(b.num_rows + 1))
            ids, out = b.column("doc_id").to_pylist(), []
            # So many pairs at a time that what they share fits in memory.
            ends = np.cumsum(first[pdoc + 1] - first[pdoc]) // 500_000
            for part in np.split(np.arange(len(pairs)), np.flatnonzero(np.diff(ends)) + 1):
                pair, hit = _spread(first[pdoc[part]], first[pdoc[part] + 1] - first[pdoc[part]])
                which, where = index.shared(pitem[part][pair], k[hit])
                # A place of the document counts once, however often the item has its shingle.
                once = np.bincount(pair[which[np.flatnonzero(np.diff(which, prepend=-1))]], minlength=len(part))
                begin = np.searchsorted(pair[which], np.arange(len(part) + 1))
                dp, ip = dpos[hit[which]], index.place[where]
                for j in np.flatnonzero(once >= LEAST).tolist():
                    d, i = int(pdoc[part[j]]), int(pitem[part[j]])
                    mine = slice(begin[j], begin[j + 1])
                    got = holds(flat[off[d] : off[d + 1]], index.seqs[i], dp[mine], ip[mine])
                    if got:
                        out.append((ids[d], index.ids[i], got, len(index.seqs[i])))
            if out:
                c = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int32())], names=["doc_id", "class", "n_words", "item_words"])

    return run


def leaks(documents: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, n_words (longest passage), item_words: one row per document and item it holds a passage of."""
    spark = documents.sparkSession
    body = bodies(items)
    one = body.filter("item_id = class")
    size = one.agg(F.coalesce(F.sum(F.length(F.concat_ws(" ", "body"))), F.lit(0)).alias("n")).collect()[0].n
    found = spark.createDataFrame([], "doc_id bigint, class bigint, n_words int, item_words int")
    if size:
        docs = documents.select("doc_id", "text").filter("doc_id is not null and text is not null")
        scanned = cut_lineage(docs.mapInArrow(_scan(spark.sparkContext.broadcast(_bitmap(one))), _SCANNED))
        kept = scanned.filter("ids is not null").select("doc_id", "ids")
        counts = scanned.filter("code is not null").groupBy("code").agg(F.sum("n").alias("n"))
        n_blocks = max(1, -(-int(size) // block_bytes))
        counts = cut_lineage(counts) if n_blocks > 1 else counts
        parts = []
        for k in range(n_blocks):
            block = one.filter(F.pmod(F.xxhash64("class"), F.lit(n_blocks)) == k)
            part = sorted((r["class"], r.body) for r in block.select("class", "body").collect())
            if part:
                of = block.select("body").mapInArrow(_codes, "code bigint").distinct().join(counts, "code")
                index = Index(part, {r.code: r.n for r in of.collect()})  # a row per shingle of the block
                parts.append(kept.mapInArrow(_match(spark.sparkContext.broadcast(index)), found.schema))
        found = reduce(DataFrame.unionByName, parts)
    return found.join(body.select("item_id", "class"), "class").select("doc_id", "item_id", "n_words", "item_words")


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per leaked item: its suite, documents that hold a passage, the longest passage and its share of the item."""
    per = leaks(documents, items).groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("n_words").alias("longest"), F.max(F.round(F.col("n_words") / F.col("item_words"), 4)).alias("largest_share"))
    return per.join(items.select("item_id", "suite").dropDuplicates(["item_id"]), "item_id", "left")
