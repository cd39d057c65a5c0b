"""Fixed-window quotas, exact and without walking a key's hits one after another.

A window opens at the first hit of a key and lasts ``window_ms``; the next hit at or
after its end opens the next one. The chain of openings is sequential, so it is cut
into time segments. A segment is a step function from the end of the window that is open
when it begins to the end of the one that is open when it ends (phase 1). Functions are
composed in levels, ``FAN`` neighbours to a block, and the ends handed down again from
blocks to their members (phase 2, a parallel prefix); then every segment is resolved on its
own (phase 3). Hits are first reduced to one row per key and millisecond, which bounds every
segment no matter how many hits a key has. Where no key has more than ``STEPS`` steps, all its
functions are one block.

Inside a window a hit is judged by the charges before it, and charges are at least 1,
so whole milliseconds are accepted or refused at once. Only the one millisecond in
which the quota runs out is ranked, and only its first ``limit`` hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship_by_value
from .lineage import cut
from .skew import HOT_ROWS, salted_join

# Budgets as (limit, window in milliseconds).
BUDGETS = {
    "ip": (4000, 10_000),
    "project": (2000, 10_000),
    "alert": (15, 3_600_000),
    "subscribe": (5, 60_000),
}

# Bounds a segment at 1.8 million milliseconds, one row each.
SEGMENT_MS = 1_800_000
# Segments or blocks that make a block of the next level, and the steps of a key that need no levels.
FAN = 256
STEPS = 500_000
# Before any time: no window is open.
NEVER = -(1 << 62)


def _groups(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[list[np.ndarray]]:
    """Column slices per (key, seg) of sorted batches, joined across batch borders."""
    held: list[list[np.ndarray]] = []

    def joined() -> list[np.ndarray]:
        return held[0] if len(held) == 1 else [np.concatenate(c) for c in zip(*held)]

    for batch in batches:
        if not len(batch):
            continue
        arrays = [batch[c].to_numpy() for c in columns]
        key, seg = arrays[0], arrays[1]
        starts = np.flatnonzero((key[1:] != key[:-1]) | (seg[1:] != seg[:-1])) + 1
        bounds = [0, *starts.tolist(), len(key)]
        if held and not (held[-1][0][-1] == key[0] and held[-1][1][-1] == seg[0]):
            yield joined()
            held = []
        for a, b in zip(bounds[:-2], bounds[1:-1]):
            held.append([c[a:b] for c in arrays])
            yield joined()
            held = []
        held.append([c[bounds[-2]:] for c in arrays])
    if held:
        yield joined()


class _Rows:
    """Output columns gathered into frames of even size."""

    def __init__(self, names: tuple[str, ...], most: int = 50_000):
        self.names, self.most, self.parts, self.size = names, most, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pd.DataFrame]:
        self.parts.append(columns)
        self.size += len(columns[0])
        if self.size >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pd.DataFrame]:
        if self.parts:
            yield pd.DataFrame({c: np.concatenate(v) for c, v in zip(self.names, zip(*self.parts))})
        self.parts, self.size = [], 0


def _distinct(until: np.ndarray, end: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """A step function without needless steps, as far as it can be entered: before ``limit``."""
    n = int(np.searchsorted(until, limit, "left")) + 1
    until, end = until[:n], end[:n]
    last = np.append(end[1:] != end[:-1], True)
    return until[last], end[last]


def _entries(window_ms: int, segment_ms: int):
    """Phase 1: a segment's step function. A window that ends by ``until``, and after the step before, is followed by others until one ends at ``exit``;
    a window that ends behind the last step outlives the segment."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = _Rows(("key", "at", "until", "exit"))
        for keys, segs, hits in _groups(batches, ["key", "seg", "ms"]):
            seg = int(segs[0])
            limit = seg * segment_ms + window_ms
            if len(hits) == 1:
                # sparse keys: most segments hold a single hit
                yield from rows.add(keys, segs, hits, hits + window_ms)
                continue
            # an open window reaches less than window_ms into the segment
            n = min(len(hits), int(np.searchsorted(hits, limit, "left")) + 1)
            out = hits[:n] + window_ms
            alive = np.flatnonzero(out <= hits[-1])
            while len(alive):
                out[alive] = hits[np.searchsorted(hits, out[alive], "left")] + window_ms
                alive = alive[out[alive] <= hits[-1]]
            until, end = _distinct(hits[:n], out, limit)
            yield from rows.add(keys[: len(until)], segs[: len(until)], until, end)
        yield from rows.flush()

    return run


def _after(until: np.ndarray, end: np.ndarray, entered: np.ndarray) -> np.ndarray:
    """Values of a step function."""
    step = np.searchsorted(until, entered, "left")
    return np.where(step < len(until), end[np.minimum(step, len(until) - 1)], entered)


def _composed(window_ms: int, block_ms: int, origin_ms: int):
    """Phase 2, upwards: the functions of a block's members in order as one function."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = _Rows(("key", "at", "until", "exit"))
        block = None
        for keys, _, blocks, until, end in _groups(batches, ["key", "at", "block", "until", "exit"]):
            if (keys[0], blocks[0]) != block:
                if block is not None:
                    yield from rows.add(np.full(len(u), block[0], object), np.full(len(u), block[1]), u, x)
                block, u, x = (keys[0], blocks[0]), until, end
                limit = origin_ms + int(blocks[0]) * block_ms + window_ms
            else:
                x = _after(until, end, x)
                if u[-1] < limit:
                    # Windows that outlive all members so far meet the new one first.
                    u, x = np.concatenate([u, until]), np.concatenate([x, end])
            u, x = _distinct(u, x, limit)
        if block is not None:
            yield from rows.add(np.full(len(u), block[0], object), np.full(len(u), block[1]), u, x)
        yield from rows.flush()

    return run


def _entered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Phase 2, downwards: the end of the window open at the beginning of each member, from that of its block.

    The block's own row stands first, with that end as ``exit``. A key without one has a single block, before which no window is open.
    """
    rows = _Rows(("key", "at", "open_until"))
    key, ends = None, NEVER
    for keys, at, until, end in _groups(batches, ["key", "at", "until", "exit"]):
        if keys[0] != key:
            key, ends = keys[0], NEVER
        if at[0] < 0:
            ends = int(end[0])
            continue
        yield from rows.add(keys[:1], at[:1], np.array([ends]))
        step = int(np.searchsorted(until, ends, "left"))
        if step < len(until):
            ends = int(end[step])
    yield from rows.flush()


def _resolve(window_ms: int):
    """Phase 3: the window opening every millisecond belongs to.

    The first row of a segment has the end of the window open at its beginning as ``charge``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = _Rows(("key", "ms", "charge", "opened"), 20_000)
        for keys, _, hits, charge in _groups(batches, ["key", "seg", "ms", "charge"]):
            ends, keys, hits, charge = int(charge[0]), keys[1:], hits[1:], charge[1:]
            opening = np.empty(len(hits), dtype="int64")
            i = int(np.searchsorted(hits, ends, "left"))
            if i:
                opening[:i] = ends - window_ms
            while i < len(hits):
                j = int(np.searchsorted(hits, hits[i] + window_ms, "left"))
                opening[i:j] = hits[i]
                i = j
            yield from rows.add(keys, hits, charge, opening)
        yield from rows.flush()

    return run


def _open_at_segments(per_ms: DataFrame, window_ms: int, segment_ms: int, fan: int, steps: int) -> DataFrame:
    """(key, seg, open_until): the end of the window that is open when a segment of a key begins."""
    # function rows feed the way up and the way down
    found = cut(per_ms.select("key", "seg", "ms").repartition("key", "seg").sortWithinPartitions("key", "seg", "ms")
                .mapInPandas(_entries(window_ms, segment_ms), "key string, at bigint, until bigint, exit bigint"))
    span = found.groupBy("key").agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high")).agg(
        F.max("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).first()
    origin = span["low"] or 0
    count = (span["high"] or 0) - origin + 1
    if (span["n"] or 0) <= steps:
        fan = max(fan, count)
    levels, size = [found.withColumn("at", F.col("at") - origin)], fan
    while size < count:
        grouped = levels[-1].withColumn("block", F.floor(F.col("at") / fan).cast("bigint"))
        levels.append(cut(grouped.repartition("key", "block").sortWithinPartitions("key", "block", "at", "until").select("key", "at", "block", "until", "exit")
                          .mapInPandas(_composed(window_ms, size * segment_ms, origin * segment_ms), "key string, at bigint, until bigint, exit bigint")))
        size *= fan
    entered = None
    for functions in reversed(levels):
        rows = functions.select("key", F.floor(F.col("at") / fan).cast("bigint").alias("block"), "at", "until", "exit")
        if entered is not None:
            rows = rows.unionByName(entered.select(
                "key", F.col("at").alias("block"), F.lit(-1).cast("bigint").alias("at"), F.lit(NEVER).alias("until"), F.col("open_until").alias("exit")))
        entered = (rows.repartition("key", "block").sortWithinPartitions("key", "block", "at", "until").select("key", "at", "until", "exit")
                   .mapInPandas(_entered, "key string, at bigint, open_until bigint"))
    return entered.select("key", (F.col("at") + origin).alias("seg"), "open_until")


def anchored_windows(hits: DataFrame, window_ms: int, segment_ms: int | None = None, fan: int = FAN, steps: int = STEPS) -> DataFrame:
    """(key, ms, charge, opened) per distinct millisecond of ``hits(key, ms, charge)``."""
    segment_ms = segment_ms or SEGMENT_MS
    # key spelled as text for the Python side
    per_ms = (hits.groupBy(F.col("key").cast("string").alias("key"), "ms").agg(F.sum("charge").cast("bigint").alias("charge"))
              .withColumn("seg", F.floor(F.col("ms") / segment_ms).cast("bigint")))
    first = _open_at_segments(per_ms, window_ms, segment_ms, fan, steps).select("key", "seg", F.lit(NEVER).alias("ms"), F.col("open_until").alias("charge"))
    return (per_ms.select("key", "seg", "ms", "charge").unionByName(first).repartition("key", "seg").sortWithinPartitions("key", "seg", "ms")
            .mapInPandas(_resolve(window_ms), "key string, ms bigint, charge bigint, opened bigint"))


def aligned_windows(hits: DataFrame, window_ms: int) -> DataFrame:
    """Same shape, with windows aligned to multiples of ``window_ms``; no Python, no chain."""
    return (
        hits.groupBy("key", "ms").agg(F.sum("charge").cast("bigint").alias("charge"))
        .withColumn("opened", (F.floor(F.col("ms") / window_ms) * window_ms).cast("bigint")))


def _retry_after(shared: bool, window_ms: int) -> Column:
    left = F.col("opened") + window_ms - F.col("ms")
    if not shared:
        return F.greatest(F.lit(1), F.ceil(left / 1000)).cast("int")
    # a shared counter reports its time to live rounded to seconds; zero reads as a full window
    ttl = F.floor((left + 500) / 1000)
    return F.when(ttl <= 0, -(-window_ms // 1000)).otherwise(ttl).cast("int")


def decide(hits: DataFrame, windows: DataFrame, limit: int, window_ms: int, mode: str = "memory",
           min_rows: int = HOT_ROWS) -> DataFrame:
    """Verdict per hit: (hit_id, key, ms, opened, ok, retry_after, used, remaining).

    ``memory``: refused when the charges before the hit reach the limit, refusals are
    free, so the first hit of a window always passes. ``shared``: the hit is charged
    first and refused when the sum exceeds the limit. ``hits`` has ``hit_id`` (unique,
    also the order inside a millisecond), ``key``, ``ms`` and ``charge`` >= 1.
    """
    if mode not in ("memory", "shared"):
        raise ValueError(f"unknown mode {mode}")
    shared = mode == "shared"
    inside = Window.partitionBy("key", "opened").orderBy("ms").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("charge").over(inside), F.lit(0).cast("bigint"))
    whole = F.when(F.col("base") + F.col("charge") <= limit, True).when(F.col("base") >= limit, False)
    # read by three branches below
    per_ms = cut(windows.withColumn("base", base).withColumn("whole", whole)
                 .select("key", "ms", "opened", "base", "whole", F.col("charge").alias("_rows")))
    # charges are at least 1, so they bound the hits of a millisecond
    weights = per_ms.select("key", "ms", "_rows")
    edges = per_ms.where(F.col("whole").isNull()).select("key", "ms", "base")
    order = Window.partitionBy("key", "ms").orderBy("hit_id")
    first = (
        salted_join(hits, edges, ["key", "ms"], "inner", row_key=F.xxhash64("hit_id"), min_rows=min_rows, weights=weights)
        .withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit))
    before = F.col("base") + F.coalesce(F.sum("charge").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fits = (before + F.col("charge") <= limit) if shared else (before < limit)
    # charges only add up, so the accepted hits of a millisecond are those up to the last one
    last_ok = first.withColumn("fits", fits).where("fits").groupBy("key", "ms").agg(F.max("hit_id").alias("last_ok"))
    judged = salted_join(hits.select("hit_id", "key", "ms"), per_ms.join(last_ok, ["key", "ms"], "left").drop("_rows"),
                         ["key", "ms"], "inner", row_key=F.xxhash64("hit_id"), min_rows=min_rows, weights=weights)
    ok = F.coalesce(F.col("whole"), F.col("hit_id") <= F.col("last_ok"), F.lit(False))
    return judged.select(
        "hit_id", "key", "ms", "opened", ok.alias("ok"), F.when(~ok, _retry_after(shared, window_ms)).alias("retry_after"))


def rate_limit(hits: DataFrame, limit: int, window_ms: int, mode: str = "memory", aligned: bool = False,
               segment_ms: int | None = None, min_rows: int = HOT_ROWS) -> DataFrame:
    """Judge every hit against a fixed-window quota, anchored at first hits unless ``aligned``."""
    windows = aligned_windows(hits, window_ms) if aligned else anchored_windows(hits, window_ms, segment_ms)
    return decide(hits, windows, limit, window_ms, mode, min_rows)


def budget_use(hits: DataFrame, windows: DataFrame, verdicts: DataFrame, limit: int) -> DataFrame:
    """Points consumed and left per window, counting accepted hits only."""
    used = (
        verdicts.where("ok").join(hits.select("hit_id", "charge"), "hit_id")
        .groupBy("key", "opened").agg(F.sum("charge").cast("bigint").alias("used"), F.count("*").alias("accepted")))
    refused = verdicts.groupBy("key", "opened").agg(F.count_if(~F.col("ok")).alias("refused"))
    return refused.join(used, ["key", "opened"], "left").select(
        "key", "opened", F.coalesce("accepted", F.lit(0).cast("bigint")).alias("accepted"), "refused",
        F.coalesce("used", F.lit(0).cast("bigint")).alias("used"),
        F.greatest(F.lit(0).cast("bigint"), limit - F.coalesce("used", F.lit(0).cast("bigint"))).alias("remaining"))


def open_windows(hits: DataFrame, limit: int, window_ms: int, now_ms: int, mode: str = "memory") -> DataFrame:
    """Counters still alive at ``now_ms`` and what they have counted by then; the rest is what a sweep evicts.

    Later hits don't exist yet. In memory mode refused hits are not charged.
    """
    seen = hits.where(F.col("ms") <= now_ms)
    windows = anchored_windows(seen, window_ms)
    if mode == "memory":
        live = budget_use(seen, windows, decide(seen, windows, limit, window_ms, mode), limit).select("key", "opened", F.col("used").alias("count"))
    else:
        live = windows.groupBy("key", "opened").agg(F.sum("charge").alias("count"))
    return live.where((F.col("opened") <= now_ms) & (F.col("opened") + window_ms > now_ms)).select(
        "key", "opened", "count", (F.col("opened") + window_ms).alias("reset_at"))


ship_by_value(__name__)
