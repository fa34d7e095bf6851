"""Problem 1: clips of evaluation splits that hold the same video as clips of train.

Edit-distance segment join. The string of a clip is the sequence of its cuts' inserts. If two strings of n and m inserts agree
in order in at least ``AGREE * max(n, m)`` places, at most k inserts have to be deleted or inserted to turn one into the
other, so of k+1 segments of the evaluation string one stands unaltered in the training string, shifted by no more places than
inserts may be missing on either side. Segments are looked up by hash, then a dynamic program over the band of allowed shifts
counts the agreeing inserts, for many pairs at a time.

Hot inserts: the segment borders are laid such that every segment holds an insert that is not heavy, where the string has
enough of them, and the segment is looked up by (at most) the two inserts that begin with it. Where it has not enough, heavy
segments stay in the join; their rows are cut into cells (:func:`tideline.plans.skew.join_grid`), so no task gets all of them.

Exact copies are classes: clips with one string, clips with one file. Links are found between classes; :func:`links` and
:func:`members` give them with what belongs to each, and reports are computed from their sizes. Only :func:`pairs`, whose
result is every pair by definition, expands them, again in cells.

Nulls: rows without id, split, or with a split that is neither train nor evaluation are no case. Unreadable inserts agree
with nothing but count as cuts. Useless digests (null, not 64 hex digits, one digit repeated) are no evidence. Empty tables
give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import EVAL_SPLITS, insert_name, latest, plain
from tideline.plans.skew import join_grid, join_unique
from tideline.session import cut_lineage

#: Share of the cuts' inserts that must agree in order.
AGREE = 0.75


def digest(c: Column) -> Column:
    x = F.lower(F.trim(c))
    return F.when(x.rlike("^[0-9a-f]{64}$") & ~x.rlike(r"^(.)\1{63}$"), x)


def edits(clips: DataFrame) -> DataFrame:
    """id, role (train or eval), split, provenance, sha, n (cuts), toks (readable inserts in time order), sid (key of the string)."""
    cuts = F.col("splice.cuts")
    by_time = F.transform(F.array_sort(F.transform(cuts, lambda x, i: F.struct(x["t_s"].alias("t"), i.alias("i"), x["insert_id"].alias("k")))), lambda x: x["k"])
    in_order = F.when(F.forall(cuts, lambda x: x["t_s"].isNotNull()), by_time).otherwise(F.transform(cuts, lambda x: x["insert_id"]))
    df = latest(clips, split=plain(F.col("split")), provenance=plain(F.col("source.provenance")), sha=digest(F.col("media.sha256")), raw=in_order)
    role = F.when(F.col("split") == "train", "train").when(F.col("split").isin(*EVAL_SPLITS), "eval")
    toks = F.filter(F.transform("raw", insert_name), lambda x: x.isNotNull())
    df = df.withColumn("role", role).filter("role is not null").withColumn("n", F.coalesce(F.size("raw"), F.lit(0))).withColumn("toks", F.coalesce(toks, F.array().cast("array<string>")))
    return df.withColumn("sid", F.md5(F.concat_ws(",", F.col("n").cast("string"), "toks"))).drop("raw")


def agreement(a: np.ndarray, b: np.ndarray, missing_a: int, missing_b: int) -> np.ndarray:
    """Longest common subsequences of the rows of a (p, n) and b (p, m) of which at most so many places stay unmatched.

    Cells (i, j) with -missing_a <= j - i <= missing_b are kept, one row of them at a time: n * (missing_a + missing_b + 1) steps,
    each over all p pairs.
    """
    (p, n), m = a.shape, b.shape[1]
    wide = missing_a + missing_b + 1
    padded = np.full((p, n + wide + m), -1, b.dtype)
    padded[:, missing_a : missing_a + m] = b
    row = np.zeros((p, wide), np.int32)
    for i in range(n):
        # Cell x of row i is j = i - missing_a + x; the next row's cell x comes from x (both places), x + 1 (a skipped) or x - 1.
        new = row + (padded[:, i : i + wide] == a[:, i : i + 1])
        new[:, :-1] = np.maximum(new[:, :-1], row[:, 1:])
        row = np.maximum.accumulate(new, 1)
    return row[:, m - n + missing_a]


@F.pandas_udf(T.IntegerType())
def agreeing(a: pd.Series, b: pd.Series, need: pd.Series) -> pd.Series:
    """Agreeing inserts of each pair, or 0 if fewer than ``need`` agree; pairs of equal lengths are worked on together."""
    codes, _ = pd.factorize(np.concatenate([np.concatenate(list(a)), np.concatenate(list(b))]))
    la, lb = a.map(len).to_numpy(), b.map(len).to_numpy()
    sa, sb = np.cumsum(la) - la, np.cumsum(lb) - lb + la.sum()
    out = np.zeros(len(a), np.int32)
    shape = pd.DataFrame({"n": la, "m": lb, "k": need.to_numpy()})
    for (n, m, k), at in shape.groupby(["n", "m", "k"]).indices.items():
        if k <= min(n, m):
            out[at] = agreement(codes[sa[at][:, None] + np.arange(n)], codes[sb[at][:, None] + np.arange(m)], n - k, m - k)
    return pd.Series(out)


def string_pairs(rows: DataFrame, agree: float = AGREE) -> DataFrame:
    """Pairs (eval_sid, train_sid) of different or equal strings that agree; ``rows`` as from :func:`edits`."""
    least = lambda n: f"cast(ceil({agree} * {n}) as int)"
    strings = rows.filter((F.col("n") > 0) & (F.size("toks") >= F.expr(least("n")))).select("role", "sid", "n", "toks").dropDuplicates(["role", "sid"]).withColumn("nn", F.size("toks"))
    strings = cut_lineage(strings)
    counts = strings.select(F.explode(F.array_distinct("toks")).alias("t")).groupBy("t").count()
    total = strings.count()
    # Fewer than 2048 * (mean length) inserts can have so many strings: a bounded list.
    bar = max(32, total // 2048)
    heavy = [r.t for r in counts.filter(F.col("count") > bar).select("t").collect()]
    ev = strings.filter("role = 'eval'").withColumn("k", F.expr(f"array_max(transform(sequence(n, greatest(n, cast(floor(nn / {agree}) as int))), m -> nn + m - 2 * {least('greatest(n, m)')}))"))
    rare = F.filter(F.sequence(F.lit(0), F.col("nn") - 1), lambda i: ~F.coalesce(F.get(F.col("toks"), i).isin(heavy), F.lit(False)) if heavy else F.lit(True))
    ev = ev.withColumn("_r", rare).withColumn("_at", F.expr("if(size(_r) > k, _r, sequence(0, nn - 1))"))
    ev = ev.withColumn("_seg", F.expr("transform(sequence(0, k), g -> struct(_at[cast(floor(g * size(_at) / (k + 1)) as int)] as p, if(g < k, _at[cast(floor((g + 1) * size(_at) / (k + 1)) as int)], nn) as e))"))
    ev = ev.select(F.col("sid").alias("eval_sid"), F.col("n").alias("n1"), F.col("nn").alias("nn1"), F.explode("_seg").alias("s"), "toks")
    ev = ev.select("eval_sid", "n1", "nn1", F.col("s.p").alias("p1"), F.expr("xxhash64(slice(toks, s.p + 1, least(2, s.e - s.p)))").alias("key"))
    tr = strings.filter("role = 'train'").select(F.col("sid").alias("train_sid"), F.col("n").alias("n2"), F.col("nn").alias("nn2"), "toks", F.explode(F.expr("sequence(0, nn - 1)")).alias("p2"))
    tr = tr.select("train_sid", "n2", "nn2", "p2", F.explode(F.expr("if(p2 + 1 < nn2, array(1, 2), array(1))")).alias("w"), "toks").select("train_sid", "n2", "nn2", "p2", F.expr("xxhash64(slice(toks, p2 + 1, w))").alias("key"))
    # Before a place of the evaluation string stand at most nn1 - need inserts that the other lacks, and the other way round.
    need = F.expr(least("greatest(n1, n2)"))
    near = (need <= F.least("nn1", "nn2")) & (F.col("p1") - F.col("p2") <= F.col("nn1") - need) & (F.col("p2") - F.col("p1") <= F.col("nn2") - need)
    found = join_grid(cut_lineage(ev), cut_lineage(tr), ["key"]).filter(near).select("eval_sid", "train_sid").distinct()
    text = lambda role, a: strings.filter(F.col("role") == role).select(F.col("sid").alias(f"{role}_sid"), F.col("toks").alias(a), F.col("n").alias(f"n_{role}"))
    found = found.join(text("eval", "a"), "eval_sid").join(text("train", "b"), "train_sid").withColumn("need", F.expr(least("greatest(n_eval, n_train)")))
    return found.withColumn("same", agreeing("a", "b", "need")).filter("same >= need").select("eval_sid", "train_sid", "same", "n_eval", "n_train")


def members(rows: DataFrame) -> DataFrame:
    """kind (file or edit), class, id, role: which clips belong to which class of equal copies."""
    pairs = F.explode(F.array(F.struct(F.lit("file").alias("kind"), F.col("sha").alias("class")), F.struct(F.lit("edit").alias("kind"), F.when(F.col("n") > 0, F.col("sid")).alias("class")))).alias("c")
    return rows.select("id", "role", pairs).select("c.*", "id", "role").filter("class is not null")


def links(rows: DataFrame, agree: float = AGREE) -> DataFrame:
    """kind, eval_class, train_class: which classes overlap; a file with itself, a string with each that agrees with it."""
    files = rows.filter("sha is not null").groupBy("sha").agg(F.count_if(F.col("role") == "eval").alias("e"), F.count_if(F.col("role") == "train").alias("t"))
    files = files.filter("e > 0 and t > 0").select(F.lit("file").alias("kind"), F.col("sha").alias("eval_class"), F.col("sha").alias("train_class"))
    edit = string_pairs(rows, agree).select(F.lit("edit").alias("kind"), F.col("eval_sid").alias("eval_class"), F.col("train_sid").alias("train_class"))
    return files.unionByName(edit)


def pairs(rows: DataFrame, agree: float = AGREE) -> DataFrame:
    """eval_id, train_id, same_file, same_edit: every pair of clips whose classes are linked; ``rows`` as from :func:`edits`."""
    m = members(rows)
    side = lambda role: m.filter(F.col("role") == role).select("kind", F.col("class").alias(f"{role}_class"), F.col("id").alias(f"{role}_id"))
    # A class may have many clips and many links, so both joins are cut into cells.
    ev = join_grid(cut_lineage(links(rows, agree)), side("eval"), ["kind", "eval_class"]).select("kind", "train_class", "eval_id")
    both = join_grid(cut_lineage(ev), side("train"), ["kind", "train_class"])
    return both.groupBy("eval_id", "train_id").agg(F.bool_or(F.col("kind") == "file").alias("same_file"), F.bool_or(F.col("kind") == "edit").alias("same_edit"))


def overlaps(clips: DataFrame, agree: float = AGREE) -> DataFrame:
    """eval_id, train_id, split, provenance (of the evaluation clip), same_file, same_edit: one row per pair."""
    rows = cut_lineage(edits(clips))
    of = rows.filter("role = 'eval'").select(F.col("id").alias("eval_id"), "split", "provenance")
    return join_unique(cut_lineage(pairs(rows, agree)), of, "eval_id", "inner").select("eval_id", "train_id", "split", "provenance", "same_file", "same_edit")


def class_report(clips: DataFrame, agree: float = AGREE) -> DataFrame:
    """id, role, class, n_links: one row per clip in a class, with the number of classes of the other side it is linked to.

    A clip with a usable file and cuts has two rows, one per kind.
    """
    rows = cut_lineage(edits(clips))
    l = cut_lineage(links(rows, agree))
    n = l.groupBy("kind", F.lit("eval").alias("role"), F.col("eval_class").alias("class")).agg(F.count("*").alias("n")).unionByName(l.groupBy("kind", F.lit("train").alias("role"), F.col("train_class").alias("class")).agg(F.count("*").alias("n")))
    return members(rows).join(n, ["kind", "role", "class"], "left").select("id", "role", "kind", "class", F.coalesce("n", F.lit(0)).alias("n_links"))


def overlap_report(clips: DataFrame, agree: float = AGREE) -> DataFrame:
    """Per evaluation split and provenance: clips, clips that overlap with train, pairs. Missing provenance reads ``unknown``.

    Pairs are counted, not listed: those of one file, plus those of agreeing edits, less those that are both, from the sizes
    of the groups with one file and one string.
    """
    rows = cut_lineage(edits(clips).withColumn("provenance", F.coalesce("provenance", F.lit("unknown"))).withColumn("sid", F.when(F.col("n") > 0, F.col("sid"))))
    group = ["split", "provenance"]
    ev = rows.filter("role = 'eval'").groupBy(*group, "sha", "sid").agg(F.count("*").alias("c"))
    tr = rows.filter("role = 'train'").groupBy("sha", "sid").agg(F.count("*").alias("t"))
    edit = cut_lineage(string_pairs(rows, agree).select(F.col("eval_sid").alias("sid"), F.col("train_sid").alias("tsid")))
    by_file = tr.filter("sha is not null").groupBy("sha").agg(F.sum("t").alias("nf"))
    by_edit = edit.join(tr.filter("sid is not null").groupBy(F.col("sid").alias("tsid")).agg(F.sum("t").alias("t")), "tsid").groupBy("sid").agg(F.sum("t").alias("ne"))
    both = ev.select("sha", "sid").distinct().join(edit, "sid").join(tr.withColumnRenamed("sid", "tsid"), ["sha", "tsid"]).groupBy("sha", "sid").agg(F.sum("t").alias("nb"))
    g = ev.join(by_file, "sha", "left").join(by_edit, "sid", "left").join(both, ["sha", "sid"], "left").fillna(0, ["nf", "ne", "nb"])
    p = F.col("nf") + F.col("ne") - F.col("nb")
    return g.groupBy(*group).agg(F.sum("c").alias("n_clips"), F.sum(F.when(p > 0, F.col("c")).otherwise(0)).alias("n_overlapping"), F.sum(F.col("c") * p).alias("n_pairs"), F.sum(F.col("c") * F.col("nf")).alias("n_same_file"))
