"""First-seen alerts with a throttle, as keyed state of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import levels
from ..operators.fixwork import with_fingerprint
from ..operators.quota import BUDGETS
from ..shipping import ship_by_value
from .quota import Budget

SEEN = "project_id string, fingerprint string, id string, ms bigint, last bigint, at timestamp"
ALERTS = "project_id string, fingerprint string, id string, ms bigint, sent boolean"


def _earliest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A batch's first entry and last time per project and shape, so that a hot project or shape ships few rows."""
    for rows in batches:
        rows = rows.sort_values(["ms", "id"], kind="stable")
        by = rows.groupby(["project_id", "fingerprint"], sort=False, dropna=False)
        first = by.first().reset_index()
        first["last"] = by["ms"].max().to_numpy()
        first["at"] = pd.to_datetime(first["last"], unit="ms")
        yield first[["project_id", "fingerprint", "id", "ms", "last", "at"]]


class FirstSeen(StatefulProcessor):
    """A project's shapes with the time each was last seen, and its alert window."""

    def __init__(self, budget: Budget, remember_ms: int):
        self.budget, self.remember_ms = budget, remember_ms
        # few timers a project: shapes are forgotten in groups, up to an eighth of the span late
        self.step_ms = max(1, remember_ms // 8)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.shapes = handle.getMapState("shapes", "fingerprint string", "last bigint")
        self.window = handle.getValueState("window", "opened bigint, hits bigint, used bigint")

    def _forget_at(self, last: int) -> int:
        return -(-(last + self.remember_ms) // self.step_ms) * self.step_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows), ignore_index=True).sort_values(["ms", "id"], kind="stable")
        last = seen.groupby("fingerprint", sort=False)["last"].max()
        firsts = seen.drop_duplicates("fingerprint")
        fresh, timers = [], set()
        for shape in firsts["fingerprint"].tolist():
            at, known = int(last[shape]), self.shapes.containsKey((shape,))
            before = int(self.shapes.getValue((shape,))[0]) if known else None
            fresh.append(not known)
            if before is None or at > before:
                self.shapes.updateValue((shape,), (at,))
                timers.add(self._forget_at(at))
        new = firsts[np.array(fresh, bool)]
        state = self.window.get() if self.window.exists() else None
        _, sent, windows = self.budget.judge(state, new["ms"].to_numpy(), np.ones(len(new), np.int64))
        if windows and windows[-1] != state:
            self.window.update(windows[-1])
            timers.add(windows[-1][0] + self.budget.window_ms)
        for t in timers:
            self.handle.registerTimer(t)
        yield pd.DataFrame({"project_id": pd.Series([key[0]] * len(new), dtype="object"), "fingerprint": new["fingerprint"].to_numpy(), "id": new["id"].to_numpy(), "ms": new["ms"].to_numpy(), "sent": sent})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        if self.window.exists() and self.window.get()[0] + self.budget.window_ms <= now:
            self.window.clear()
        gone = [shape for shape, (at,) in self.shapes.iterator() if self._forget_at(at) <= now]
        for shape in gone:
            self.shapes.removeKey(shape)
        yield pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("project_id", "object"), ("fingerprint", "object"), ("id", "object"), ("ms", "int64"), ("sent", "bool"))})

    def close(self) -> None:
        pass


def first_seen_alerts(entries: DataFrame, remember: str = "7 days", late: str = "10 minutes", limit: int | None = None, window_ms: int | None = None) -> DataFrame:
    """One row per project and shape of a fixable entry when it is first seen, and whether its alert is ``sent``: at most ``limit`` a project and window.

    ``entries`` has a guarded time ``event_ts``. A shape not seen for ``remember`` is forgotten and would be new again; a window is forgotten at its end. So state
    holds the shapes of that span and no more. A shape whose alert was refused counts as seen.
    """
    budget = Budget(limit or BUDGETS["alert"][0], window_ms or BUDGETS["alert"][1])
    spark = entries.sparkSession
    span = spark.sql(f"select cast(date_diff(millisecond, timestamp '2000-01-01', timestamp '2000-01-01' + interval '{remember}') as bigint) as ms").first()["ms"]
    shaped = with_fingerprint(entries.where(levels.fixable(F.col("level")) & F.col("event_ts").isNotNull()))
    rows = shaped.select("project_id", "fingerprint", "id", F.unix_millis("event_ts").alias("ms")).mapInPandas(_earliest, SEEN)
    return rows.withWatermark("at", late).groupBy("project_id").transformWithStateInPandas(
        statefulProcessor=FirstSeen(budget, span), outputStructType=ALERTS, outputMode="append", timeMode="EventTime")


ship_by_value(__name__)
