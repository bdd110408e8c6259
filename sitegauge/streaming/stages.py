"""Durations of processing stages from a stream of start and finish events.

State is kept per run of ``stage_run`` consecutive targets, as every call for a key and every access to its state costs far more
than a row; the key is the run's lowest target. It holds two lists: events that the watermark has not passed, and the starts still
open; they are matched per (target, stage). Events may arrive in any order within the allowed delay: they wait in the first list until the watermark passes their time, when
an event-time timer takes them, in order of their ids, against the open starts. A start open for longer than
``open_stage_days`` is given up by a second timer, so a finish that never comes does not hold state for good.

Event time is the time stamp rounded up to the millisecond: Spark drops what is not later than the watermark, so whatever
the watermark has passed is complete.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sitegauge.params import DEFAULT, Params

DURATION_SCHEMA = "target_id long, stage string, start_id long, finish_id long, status string, duration_ms long"
COLUMNS = ["event_id", "status", "ms", "at"]
#: What events of a run are matched by: the target's distance from the lowest one, and the stage.
BY = ["distance", "stage"]
_STATE = "distance int, stage string, event_id long, status string, ms long, at long"


def match(rows: pd.DataFrame, by: list[str] = []) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(pairs, starts still open) of events in order: each finish closes the latest open start, without one it is dropped.

    Events are matched per value of the ``by`` columns, which both results carry. The nesting depth after each event is a
    running sum that never falls below zero; at one depth starts and finishes alternate, so a pair is a start and the next
    row of its depth.
    """
    group = rows.groupby(by, dropna=False, sort=False).ngroup().to_numpy() if by else np.zeros(len(rows), "i8")
    rows = rows.assign(group=group, step=np.where(rows["status"] == "running", 1, -1)).sort_values("group", kind="stable")
    group, step = rows["group"].to_numpy(), rows["step"].to_numpy()
    total = rows.groupby("group")["step"].cumsum()
    floor = np.minimum(total, 0).groupby(group).cummin()
    lost = (step < 0) & (total < floor.groupby(group).shift(1, fill_value=0))
    level = total - floor + (step < 0)
    kept = rows.assign(level=level)[~lost].sort_values(["group", "level"], kind="stable")
    follows = (kept["level"].shift(-1) == kept["level"]) & (kept["group"].shift(-1) == kept["group"])
    closed = ((kept["step"] == 1) & (kept["step"].shift(-1) == -1) & follows).to_numpy()
    first, second = kept[closed], kept[np.concatenate([[False], closed[:-1]])] if len(kept) else kept
    pairs = pd.DataFrame({
        **{c: first[c].to_numpy() for c in by},
        "start_id": first["event_id"].to_numpy(), "finish_id": second["event_id"].to_numpy(), "status": second["status"].to_numpy(),
        "took": second["ms"].to_numpy() - first["ms"].to_numpy()})
    return pairs, kept[(kept["step"] == 1) & ~closed].sort_index()[[*by, *COLUMNS]]


class StageDurations(StatefulProcessor):
    def __init__(self, open_ms: int):
        self.open_ms = open_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _STATE)
        self.open = handle.getListState("open", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows))
        self.waiting.appendList(self._tuples(fresh))
        self._wake(int(fresh["at"].min()))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = self._rows(self.waiting)
        due = waiting[waiting["at"] <= passed].sort_values("event_id")
        rows = pd.concat([self._rows(self.open), due], ignore_index=True)
        pairs, left = match(rows, BY)
        later = waiting[waiting["at"] > passed]
        left = left[left["at"] + self.open_ms >= passed]
        self._keep(self.waiting, later)
        self._keep(self.open, left)
        if len(later):
            self._wake(int(later["at"].min()))
        if len(left):
            self._wake(int(left["at"].min()) + self.open_ms + 1)
        pairs = pairs[pairs["took"] <= self.open_ms]
        if len(pairs):
            target = pairs["distance"].astype("i8") + key[0] if key[0] is not None else None
            yield pd.DataFrame({
                "target_id": target, "stage": pairs["stage"], "start_id": pairs["start_id"], "finish_id": pairs["finish_id"], "status": pairs["status"],
                "duration_ms": np.maximum(0, pairs["took"])})

    def close(self) -> None:
        pass

    def _wake(self, at: int) -> None:
        """A timer fires once the watermark is past it; rows due at ``at`` need the watermark to reach it."""
        self.handle.registerTimer(at - 1)

    @staticmethod
    def _rows(state) -> pd.DataFrame:
        return pd.DataFrame(list(state.get()), columns=[*BY, *COLUMNS])

    @staticmethod
    def _tuples(rows: pd.DataFrame) -> list[tuple]:
        stage = rows["stage"].astype(object)
        return list(rows.assign(stage=stage.where(stage.notna(), None))[[*BY, *COLUMNS]].itertuples(index=False, name=None))

    def _keep(self, state, rows: pd.DataFrame) -> None:
        if len(rows):
            state.put(self._tuples(rows))
        else:
            state.clear()


def stream_stage_durations(events: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Streaming form of :func:`sitegauge.streaming.live.stage_durations`; rows come once the watermark has passed a finish."""
    at = F.timestamp_millis(F.ceil(F.unix_micros("ts") / 1000))
    distance = F.coalesce(F.pmod("target_id", F.lit(p.stage_run)), F.lit(0)).cast("int")
    rows = events.select((F.col("target_id") - distance).cast("long").alias("target_id"), distance.alias("distance"), "stage", "event_id", "status", F.unix_millis("ts").alias("ms"), at.alias("time"))
    timed = rows.withWatermark("time", p.late_events).withColumn("at", F.unix_millis("time"))
    return timed.groupBy("target_id").transformWithStateInPandas(StageDurations(p.open_stage_ms), DURATION_SCHEMA, "append", "EventTime")
