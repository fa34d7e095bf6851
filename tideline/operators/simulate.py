"""Replay of streams as training sequences: sampling schedule, bounded buffer, targets, and the state a policy walks into.

A replay has many more rows than its streams, and all of them follow from the one row of the stream. So streams are dealt to tasks and
each task walks its own, a block of samples at a time: no sample is ever shuffled, sorted or written on the way, and what a task
holds does not grow with a stream. :func:`states` does the walk for ticks that come from elsewhere, by columns and running sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.ordered import carry_last, previous, running
from tideline.rng import u01_many

#: Samples that are walked at once.
BLOCK = 16384
#: Actions and targets by code.
ACTIONS = ("clear", "hold", "flag", "other")
CLEAR, HOLD, FLAG, OTHER = range(4)


@dataclass(frozen=True)
class Replay:
    fps: float = 0.5
    burst_fps: float = 4.0
    jitter_s: float = 0.4
    window_s: int = 16
    max_window_frames: int = 2
    skip_rate: float = 0.05
    escalation_rate: float = 0.05
    partial: float = 0.4
    event_s: float = 10.0
    tokens: int = 40

    def gaps(self, fps: float, u: np.ndarray) -> np.ndarray:
        return np.maximum(1e-3, 1 / fps + self.jitter_s * (2 * u - 1))


@dataclass
class Ticks:
    """A block of samples of one stream, in order. ``target`` has codes of ACTIONS."""

    stream_id: str | None
    frame_idx: np.ndarray
    t: np.ndarray
    alarmed: np.ndarray
    escalated: np.ndarray
    evicted: np.ndarray
    window_frames: np.ndarray
    in_event: np.ndarray
    target: np.ndarray
    gap: np.ndarray
    walks: dict[str, dict[str, np.ndarray]] = field(default_factory=dict)


#: What a policy answers to a block: codes of ACTIONS.
Policy = Callable[[Ticks], np.ndarray]


def targets(x: Ticks) -> np.ndarray:
    """The policy that always does what it should."""
    return x.target


def _schedule(key: str | None, duration: float, alarm: float, r: Replay) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """frame_idx and t of each sample before ``duration``, in blocks: one gap after the other, short ones from the first sample at
    or after the alarm on."""
    i, t = 0, 0.0
    while t < duration:
        idx = np.arange(i, i + min(BLOCK, int((duration - t) * r.fps * 1.05) + 16))
        (u,) = u01_many(["gap"], key, idx)
        at = np.cumsum(np.concatenate([[t], r.gaps(r.fps, u)]))
        i, t, at = i + len(idx), at[-1], at[:-1]
        n = int(np.searchsorted(at, duration))
        turn = int(np.searchsorted(at, alarm)) if alarm == alarm else n
        if turn < n:
            yield idx[: turn + 1], at[: turn + 1]
            break
        yield idx[:n], at[:n]
    else:
        return
    m, start, k, s = int(idx[turn]), at[turn], 0, 0.0
    while start + s < duration:
        ks = np.arange(k, k + min(BLOCK, int((duration - start - s) * r.burst_fps) + 16))
        (u,) = u01_many(["burst"], key, ks)
        sums = np.cumsum(np.concatenate([[s], r.gaps(r.burst_fps, u)]))[1:]
        k, s, at = k + len(ks), sums[-1], start + sums
        n = int(np.searchsorted(at, duration))
        yield m + 1 + ks[:n], at[:n]


class _Walk:
    """The state of events as the actions of one policy make it, from block to block."""

    def __init__(self, policy: Policy, r: Replay) -> None:
        self.policy, self.r = policy, r
        self.last, self.tokens, self.since = HOLD, 0, 0

    def __call__(self, x: Ticks) -> dict[str, np.ndarray]:
        a = np.where(x.escalated, self.policy(x), HOLD)
        decides = np.where((a == FLAG) | (a == CLEAR), np.arange(1, len(a) + 1), 0)
        last = np.concatenate([[self.last], a])[np.maximum.accumulate(decides)]
        closing = (a == CLEAR) & (np.concatenate([[self.last], last[:-1]]) == FLAG)
        is_open = last == FLAG
        # What has gathered since the last closing, at which nothing is added.
        tokens, since = self.tokens + np.cumsum((a == FLAG) * self.r.tokens), self.since + np.cumsum(is_open)
        tokens, since = (v - np.maximum.accumulate(np.where(closing, v, 0)) for v in (tokens, since))
        self.last, self.tokens, self.since = last[-1], tokens[-1], since[-1]
        return {"action": a, "event_open": is_open, "event_tokens": tokens, "n_since_open": since}


def _replay(key: str | None, duration: float, nu: float, alarm: float, policies: dict[str, Policy], r: Replay) -> Iterator[Ticks]:
    """The samples that are kept, in blocks; nu and alarm are NaN where there is none."""
    if not math.isfinite(duration):
        raise ValueError(f"stream {key!r} has no end")
    window, was, before = np.empty(0), 0, math.nan
    walks = {name: _Walk(p, r) for name, p in policies.items()}
    for idx, t in _schedule(key, duration, alarm, r):
        skip, up = u01_many(["skip", "up"], key, idx)
        keep = skip >= r.skip_rate
        idx, t, up = idx[keep], t[keep], up[keep]
        if not len(idx):
            continue
        seen = np.concatenate([window, t])
        held = np.arange(len(window) + 1, len(seen) + 1) - np.searchsorted(seen, t - r.window_s)
        alarmed = t >= alarm
        escalated = alarmed | (up < r.escalation_rate)
        inside = (t >= nu) & (t <= nu + r.event_s)
        x = Ticks(
            key, idx, t, alarmed, escalated, np.concatenate([[was], held[:-1]]) + 1 - held, np.where(alarmed, np.minimum(r.max_window_frames, held), escalated), inside,
            np.where(inside, np.where((t - nu) / r.event_s < r.partial, HOLD, FLAG), CLEAR), np.diff(t, prepend=before),
        )
        x.walks = {name: w(x) for name, w in walks.items()}
        window, was, before = seen[np.searchsorted(seen, t[-1] - r.window_s) :], held[-1], t[-1]
        yield x


_TYPES = {"frame_idx": "bigint", "t": "double", "alarmed": "boolean", "escalated": "boolean", "evicted": "bigint", "window_frames": "bigint", "in_event": "boolean", "label": "string", "gap": "double"}
_WALK_TYPES = {"action": "string", "event_open": "boolean", "event_tokens": "bigint", "n_since_open": "bigint"}
_NAMES = pa.array(ACTIONS)


def _batch(blocks: Sequence[Ticks], names: Sequence[str]) -> pa.RecordBatch:
    def column(name: str) -> pa.Array:
        walk, _, what = name.rpartition(".")
        if name == "stream_id":
            return pa.array([x.stream_id for x in blocks], pa.string()).take(pa.array(np.repeat(np.arange(len(blocks)), [len(x.t) for x in blocks])))
        v = np.concatenate([x.walks[walk][what] if walk else x.target if name == "label" else getattr(x, name) for x in blocks])
        if what in ("label", "action"):
            return _NAMES.take(pa.array(v))
        return pa.array(v, pa.float64(), mask=np.isnan(v)) if what == "gap" else pa.array(v.astype(np.int64) if v.dtype.kind == "i" else v)

    return pa.RecordBatch.from_arrays([column(n) for n in names], [n.replace(".", "_") for n in names])


def simulate(streams: DataFrame, r: Replay = Replay(), columns: Sequence[str] = tuple(c for c in _TYPES if c != "gap"), policies: dict[str, Policy] | None = None) -> DataFrame:
    """streams (stream_id, duration, nu, alarm; a row each) -> stream_id and ``columns`` of each sample that is kept.

    Too similar samples are skipped at random and neither buffered nor emitted. ``label``: hold while less than ``partial`` of the event is seen,
    then flag, else clear. ``gap``: time since the sample before, null for the first. Each of ``policies`` walks along by its own actions (what
    is not escalated holds): column ``name.action`` is returned as ``name_action``, and so are event_open, event_tokens and n_since_open. A flag
    opens an event (or goes on with it) and adds tokens, a clear closes the open one and empties it."""
    names, walkers = ["stream_id", *columns], policies or {}
    kinds = {"stream_id": "string"} | _TYPES | {f"{p}.{c}": kind for p in walkers for c, kind in _WALK_TYPES.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, n = [], 0
        for batch in batches:
            for s in batch.to_pylist():
                if s["duration"] is None:
                    continue
                nu, alarm = (math.nan if s[c] is None else s[c] for c in ("nu", "alarm"))
                for x in _replay(s["stream_id"], s["duration"], nu, alarm, walkers, r):
                    blocks.append(x)
                    n += len(x.t)
                    if n >= BLOCK:
                        yield _batch(blocks, names)
                        blocks, n = [], 0
        if blocks:
            yield _batch(blocks, names)

    spark = streams.sparkSession
    # A few bytes a stream are what is shuffled. Number and hash are given: by their size they would all go to one task, and an exchange by the
    # stream itself is left out if there was one before.
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = streams.select("stream_id", *[F.col(c).cast("double") for c in ("duration", "nu", "alarm")]).repartition(tasks, F.xxhash64("stream_id"))
    return dealt.mapInArrow(run, ", ".join(f"{n.replace('.', '_')} {kinds[n]}" for n in names))


def states(ticks: DataFrame, action: Column, r: Replay = Replay()) -> DataFrame:
    """``ticks`` with action, event_open, event_tokens and n_since_open as the actions make them; what is not escalated holds.

    A flag opens an event (or goes on with it) and adds tokens, a clear closes the open one and empties it."""
    d = ticks.withColumn("action", F.when(F.col("escalated"), action).otherwise("hold"))
    deciding = F.when(F.col("action").isin("flag", "clear"), F.col("action"))
    d = carry_last(d, ["stream_id"], "frame_idx", deciding, "_last")
    d = previous(d, ["stream_id"], "frame_idx", F.col("_last"), "_before")
    closing = (F.col("action") == "clear") & F.coalesce(F.col("_before") == "flag", F.lit(False))
    d = running(d, ["stream_id"], "frame_idx", closing.cast("bigint"), "_event")
    d = d.withColumn("event_open", F.coalesce(F.col("_last") == "flag", F.lit(False)))
    for out, x in (("event_tokens", F.when(F.col("action") == "flag", r.tokens).otherwise(0)), ("n_since_open", F.col("event_open").cast("bigint"))):
        d = running(d, ["stream_id", "_event"], "frame_idx", x.cast("bigint"), out)
    return d.drop("_last", "_before", "_event")
