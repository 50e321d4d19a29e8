"""Tracking of picks as a stream: what each night says of a pick is told only where it differs from what was told last.

A pick's state is one small row: the signals told last and whether its move was told. An event-time timer drops it when the
time for signals is over, so that the state grows with the picks that are open, not with all that ever were. What the stream
tells is what the nights in a row tell (plans/tracking.py), as long as each night's rows arrive within the watermark.

Needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass = PROVIDER.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..calendar import add_business_days
from ..functions import scoring as sc

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "scenario_id long, code string, night timestamp, event string, detail string"


class Tracker(StatefulProcessor):
    """The state of one pick. Rows of one batch are taken in order of their nights; those past the pick's end tell nothing."""

    def init(self, handle) -> None:
        self.handle = handle
        self.told = handle.getValueState("told", "signals string, moved boolean")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        signals, moved = self.told.get() if self.told.exists() else ("", False)
        fresh = not self.told.exists()
        frame = pd.concat(list(rows)).sort_values("night", kind="stable")
        out, end = [], None
        for r in frame.itertuples(index=False):
            end = r.expires
            if r.night > r.expires:
                continue
            if isinstance(r.moved_at, str) and not moved:
                moved = True
                out.append((r.night, "moved", r.moved_at))
            if isinstance(r.signals, str) and r.signals and r.signals != signals:
                signals = r.signals
                out.append((r.night, "sell_signal", signals))
        if (frame["night"] <= frame["expires"]).any():
            self.told.update((signals, moved))
            if fresh:
                self.handle.registerTimer(int(end.timestamp() * 1000))
        if out:
            yield pd.DataFrame([(key[0], key[1], *o) for o in out], columns=["scenario_id", "code", "night", "event", "detail"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self.told.clear()
        return iter(())

    def close(self) -> None:
        pass


def track(nights: DataFrame, calendar: DataFrame, late: str = "7 days") -> DataFrame:
    """A stream of what each night says of each pick (scenario_id, code, first_date, night as timestamp, signals joined by "|",
    moved_at as text) to the rows to append: (scenario_id, code, night, event, detail)."""
    ends = add_business_days(nights, "first_date", F.lit(sc.LONGEST_WAIT), "expires", calendar).withColumn("expires", F.col("expires").cast("timestamp"))
    rows = ends.select("scenario_id", "code", "night", "expires", "signals", "moved_at").withWatermark("night", late)
    return rows.groupBy("scenario_id", "code").transformWithStateInPandas(Tracker(), EVENTS, "Append", "EventTime")
