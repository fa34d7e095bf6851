"""Problem 6: documents of several sources mixed to target weights.

Texts are counted in tokens of a public tokenizer. Per mix, slots 0, 1, 2, ... of ``block`` tokens each take the point
frac(i * golden ratio) through the cumulative weights to a source, so every stretch of the schedule has the target shares
within a few slots, and each source has as many slots as its share fills. The k-th slot of a source takes the k-th ``block`` tokens of its documents, which are shuffled by hash and laid end to
end; where they end the next round begins, within the slot if need be, up to ``max_repeats`` rounds. So a slot is worth as
much in a small source as in a large one. Slots beyond the last round stay empty and are reported.

Running totals and ranks are taken in ranges (see :func:`tideline.plans.skew.running_total`), so a source with a third of all
documents is never in one task. Null, blank and unknown-source documents are in no mix; repeated texts under other ids are
documents of their own. Shares of a mix that don't sum to 1 are taken as they are.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import plain
from tideline.plans.skew import running_total
from tideline.session import cut_lineage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to the vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
GOLDEN = 0.6180339887498949
BLOCK = 2000

_loaded: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a file of ranks that came with the job; loaded once per Python worker."""
    if path not in _loaded:
        import tiktoken

        with open(SparkFiles.get(path), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            keep = [b.column(i) for i, f in enumerate(b.schema.names) if f != "text"]
            names = [f for f in b.schema.names if f != "text"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(n, pa.int64())], names=[*names, "tokens"])

    return run


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source (plain spelling), tokens."""
    d = documents.select("doc_id", plain(F.col("source")).alias("source"), "text").filter("text is not null")
    documents.sparkSession.sparkContext.addFile(tokenizer)  # executors need not have it
    return d.mapInArrow(_counter(os.path.basename(tokenizer)), "doc_id bigint, source string, tokens bigint")


def _named(targets: DataFrame) -> DataFrame:
    return targets.select("mix_id", "source", "target_share", "max_repeats", "total_tokens").filter("mix_id is not null and source is not null").dropDuplicates()


def plan(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: tokens wanted, tokens at hand, repeats allowed."""
    have = counts.filter("tokens > 0").groupBy(F.col("source").alias("_src")).agg(F.sum("tokens").alias("have"), F.count("*").alias("n_docs"))
    t = _named(targets).withColumn("_src", plain(F.col("source"))).join(have, "_src", "left")
    t = t.withColumn("have", F.coalesce("have", F.lit(0))).withColumn("want", F.coalesce(F.col("target_share") * F.col("total_tokens"), F.lit(0.0)))
    return t.withColumn("reps", F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)))


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """mix_id, slot, source, k, size: the source of every slot, the slot's rank among those of its source, the tokens it takes.

    Every source has exactly the slots its share of ``total_tokens`` fills, the last of them in part. The points give each
    source its slots to within a few; what is too many is left out, what lacks stands at the end of the schedule.
    """
    t = _named(targets).select("mix_id", plain(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("w"), "total_tokens").filter("w > 0")
    t = t.withColumn("want", F.col("w") * F.col("total_tokens"))
    t = t.withColumn("need", F.ceil(F.col("want") / block - 1e-12).cast("bigint"))
    mixes = t.groupBy("mix_id").agg(F.sort_array(F.collect_list(F.struct("source", "w"))).alias("ws"), F.sum("need").alias("slots"), F.sum("w").alias("sw")).filter("slots > 0")
    # Cumulative weights, as an array per mix: a mix names its sources one by one, so this is small.
    cum = F.transform("ws", lambda x, i: F.struct(x["source"].alias("source"), (F.aggregate(F.slice("ws", F.lit(1), i + 1), F.lit(0.0), lambda a, y: a + y["w"]) / F.col("sw")).alias("c")))
    mixes = mixes.withColumn("cum", cum)
    chunk = 65_536
    s = mixes.select("mix_id", "cum", "slots", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("slots") - 1) / chunk))).alias("ch"))
    s = s.select("mix_id", "cum", "ch", F.explode(F.sequence(F.col("ch") * chunk, F.least(F.col("slots"), (F.col("ch") + 1) * chunk) - 1)).alias("slot"))
    x = F.pmod((F.col("slot") + 1) * F.lit(GOLDEN), F.lit(1.0))
    hit = F.filter("cum", lambda c: c["c"] > F.col("x"))
    s = s.withColumn("x", x).withColumn("source", F.coalesce(F.get(hit, F.lit(0))["source"], F.element_at("cum", -1)["source"])).select("mix_id", "slot", "ch", "source")
    per = s.groupBy("mix_id", "source", "ch").agg(F.count("*").alias("c"))
    w = Window.partitionBy("mix_id", "source")
    base = F.coalesce(F.sum("c").over(w.orderBy("ch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("mix_id", "source", "ch").orderBy("slot")) - 1
    s = s.withColumn("r", rank).join(per.select("mix_id", "source", "ch", base.alias("base")), ["mix_id", "source", "ch"]).select("mix_id", "slot", "source", (F.col("base") + F.col("r")).alias("k"))
    due = t.select("mix_id", "source", "need", "want").join(mixes.select("mix_id", "slots"), "mix_id")
    got = per.groupBy("mix_id", "source").agg(F.sum("c").alias("got"))
    late = due.join(got, ["mix_id", "source"], "left").filter(F.coalesce("got", F.lit(0)) < F.col("need"))
    late = late.select("mix_id", "source", "slots", F.explode(F.sequence(F.coalesce("got", F.lit(0)), F.col("need") - 1)).alias("k"))
    late = late.select("mix_id", (F.col("slots") + F.col("k")).alias("slot"), "source", "k")
    s = s.unionByName(late).join(due.select("mix_id", "source", "need", "want"), ["mix_id", "source"]).filter("k < need")
    return s.select("mix_id", "slot", "source", "k", F.least(F.lit(float(block)), F.col("want") - F.col("k") * block).alias("size"))


def blocks(counts: DataFrame, block: int = BLOCK, seed: int = 3) -> DataFrame:
    """doc_id, source, tokens, before, block: documents shuffled by hash, tokens before each, blocks of equal tokens within a source."""
    c = counts.filter("tokens > 0 and source is not null")
    c = running_total(c, ["source"], F.xxhash64(F.lit(seed), "doc_id"), F.col("tokens"), "before", tie=["doc_id"])
    return c.select("doc_id", "source", "tokens", "before", F.floor(F.col("before") / block).cast("bigint").alias("block"))


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, block: int = BLOCK, seed: int = 3) -> DataFrame:
    """mix_id, slot, source, doc_id, tokens, round: the mixed records in slot order; a document is in at most max_repeats rounds."""
    return _mixed(cut_lineage(token_counts(documents, tokenizer)), targets, block, seed)


def _mixed(counts: DataFrame, targets: DataFrame, block: int = BLOCK, seed: int = 3) -> DataFrame:
    b = blocks(counts, block, seed)
    p = plan(counts, targets).select("mix_id", F.col("_src").alias("source"), "have", "reps").filter("have > 0 and reps > 0")
    s = schedule(targets, block).join(p, ["mix_id", "source"]).withColumn("at", F.col("k") * block)
    # The rounds that a slot reaches into, and the stretch [lo, hi) of tokens it takes of each; a stretch lies in two blocks at most.
    first, last = F.floor(F.col("at") / F.col("have")).cast("bigint"), F.floor((F.col("at") + F.ceil("size") - 1) / F.col("have")).cast("bigint")
    s = s.filter(first < F.col("reps")).withColumn("round", F.explode(F.sequence(first, F.least(last, F.col("reps").cast("bigint") - 1))))
    start = F.col("at") - F.col("round") * F.col("have")
    s = s.withColumn("lo", F.greatest(start, F.lit(0)).cast("double")).withColumn("hi", F.least(start + F.col("size"), F.col("have").cast("double")))
    s = s.withColumn("block", F.explode(F.array_distinct(F.array(F.floor(F.col("lo") / block), F.floor((F.ceil("hi") - 1) / block)).cast("array<bigint>"))))
    # Blocks meet slots on (source, block): neither side has more rows of a key than a block has documents or mixes times rounds.
    j = s.join(b, ["source", "block"]).filter("before >= lo and before < hi")
    return j.select("mix_id", "slot", "source", "doc_id", "tokens", "round")


def mix_report(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, block: int = BLOCK) -> DataFrame:
    """Per mix and source: target share, tokens wanted, at hand, mixed, actual share, rounds, short.

    ``short`` is seen on what was mixed. A document counts where it begins, so the slots of a source hold at least the tokens
    wanted as long as documents are left, and fewer only if all of them were used ``max_repeats`` times.
    """
    counts = cut_lineage(token_counts(documents, tokenizer))
    got = _mixed(counts, targets, block).groupBy("mix_id", "source").agg(F.sum("tokens").alias("mixed"), F.max("round").alias("r"))
    r = plan(counts, targets).join(got.withColumnRenamed("source", "_src"), ["mix_id", "_src"], "left").withColumn("mixed", F.coalesce("mixed", F.lit(0)))
    total = F.sum("mixed").over(Window.partitionBy("mix_id"))
    return r.select("mix_id", "source", "target_share", F.round("want", 3).alias("want"), "have", "mixed", F.when(total > 0, F.round(F.col("mixed") / total, 6)).alias("actual_share"), (F.coalesce("r", F.lit(-1)) + 1).alias("rounds_used"), (F.col("mixed") < F.col("want") - 1e-6).alias("short"))
