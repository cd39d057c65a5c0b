"""Fixed-window quota as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..shipping import ship_by_value

OUTPUT = "hit_id string, key string, ms bigint, opened bigint, ok boolean, retry_after int"
CLOSED = "key string, opened bigint, reset_at bigint, hits bigint, used bigint"


class Budget:
    """A key's window: when it opened, the hits it has seen and what was charged."""

    def __init__(self, limit: int, window_ms: int, shared: bool = False):
        self.limit, self.window_ms, self.shared = limit, window_ms, shared

    def judge(self, state: tuple[int, int, int] | None, ms: np.ndarray, charge: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Opening and verdict of hits in order of ``ms``, and the windows they fell into, a given one first.

        One step per window: charges only add up, so the accepted hits of a window are those before its sum reaches the limit.
        """
        opened, ok = np.empty(len(ms), np.int64), np.empty(len(ms), bool)
        windows = [] if state is None else [state]
        i = 0
        while i < len(ms):
            if not windows or ms[i] >= windows[-1][0] + self.window_ms:
                windows.append((int(ms[i]), 0, 0))
            begin, hits, used = windows[-1]
            # hits that arrive late fall into the window that is open
            j = max(i + 1, int(np.searchsorted(ms, begin + self.window_ms, "left")))
            sums = used + np.cumsum(charge[i:j])
            if self.shared:
                ok[i:j] = sums <= self.limit
                used = int(sums[-1])
            else:
                ok[i:j] = sums - charge[i:j] < self.limit
                used += int(charge[i:j][ok[i:j]].sum())
            opened[i:j] = begin
            windows[-1] = (begin, hits + j - i, used)
            i = j
        return opened, ok, windows

    def retry_after(self, left: np.ndarray) -> np.ndarray:
        if self.shared:
            seconds = (left + 500) // 1000
            return np.where(seconds == 0, -(-self.window_ms // 1000), seconds)
        return np.maximum(1, -(-left // 1000))


class FixedWindow(StatefulProcessor):
    """Verdicts, or the windows that closed. State is three numbers a key, gone when the window's end has passed if ``timed``."""

    def __init__(self, budget: Budget, timed: bool, closed: bool):
        self.budget, self.timed, self.closed = budget, timed, closed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "opened bigint, hits bigint, used bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # the key's share of one micro-batch, which the source's trigger limit bounds
        hits = pd.concat(list(rows), ignore_index=True).sort_values(["ms", "hit_id"], kind="stable", ignore_index=True)
        ms = hits["ms"].to_numpy()
        state = self.window.get() if self.window.exists() else None
        opened, ok, windows = self.budget.judge(state, ms, hits["charge"].to_numpy())
        self.window.update(windows[-1])
        if self.timed:
            end = windows[-1][0] + self.budget.window_ms
            if state is not None and state[0] + self.budget.window_ms != end:
                self.handle.deleteTimer(state[0] + self.budget.window_ms)
            self.handle.registerTimer(end)
        if self.closed:
            yield self._frame(key, windows[:-1])
            return
        retry = self.budget.retry_after(opened + self.budget.window_ms - ms)
        frame = pd.DataFrame({"hit_id": hits["hit_id"], "key": key[0], "ms": ms, "opened": opened, "ok": ok, "retry_after": pd.Series(retry, dtype="Int32").mask(ok)})
        yield frame.astype({"retry_after": "Int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.window.get() if self.window.exists() else None
        over = state is not None and state[0] + self.budget.window_ms <= expiredTimerInfo.getExpiryTimeInMs()
        if over:
            self.window.clear()
        yield self._frame(key, [state] if over else []) if self.closed else pd.DataFrame(
            {c: pd.Series(dtype=t) for c, t in (("hit_id", "object"), ("key", "object"), ("ms", "int64"), ("opened", "int64"), ("ok", "bool"), ("retry_after", "Int32"))})

    def _frame(self, key, windows: list[tuple[int, int, int]]) -> pd.DataFrame:
        table = np.array(windows, np.int64).reshape(-1, 3)
        return pd.DataFrame({"key": pd.Series([key[0]] * len(table), dtype="object"), "opened": table[:, 0], "reset_at": table[:, 0] + self.budget.window_ms,
                             "hits": table[:, 1], "used": table[:, 2]})

    def close(self) -> None:
        pass


def _run(hits: DataFrame, limit: int, window_ms: int, mode: str, late: str | None, closed: bool) -> DataFrame:
    if mode not in ("memory", "shared"):
        raise ValueError(f"unknown mode {mode}")
    rows = hits.select("hit_id", "key", "ms", "charge")
    if late is not None:
        rows = rows.withColumn("at", F.timestamp_millis("ms")).withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=FixedWindow(Budget(limit, window_ms, mode == "shared"), late is not None, closed), outputStructType=CLOSED if closed else OUTPUT,
        outputMode="append", timeMode="EventTime" if late is not None else "None")


def rate_limit_stream(hits: DataFrame, limit: int, window_ms: int, mode: str = "memory", late: str | None = None) -> DataFrame:
    """Verdict per hit of ``hits(hit_id string, key string, ms bigint, charge bigint)``.

    Hits of a key are taken in (ms, hit_id) order within a micro-batch. Bound micro-batches
    at the source (maxFilesPerTrigger, maxOffsetsPerTrigger); for a backlog use the batch
    operator, which spreads a hot key. With ``late``, an event-time timer drops a key's window when no hit can fall into it any more: when
    the time of all hits, less ``late``, has passed its end. Hits that come later than that are not judged.
    """
    return _run(hits, limit, window_ms, mode, late, False)


def closed_windows_stream(hits: DataFrame, limit: int, window_ms: int, late: str, mode: str = "memory") -> DataFrame:
    """Every window once it is over: (key, opened, reset_at, hits, used).

    A window is over when a later hit of its key opens the next one, or when an event-time timer finds its end passed; idle keys leave no state behind.
    """
    return _run(hits, limit, window_ms, mode, late, True)


ship_by_value(__name__)
