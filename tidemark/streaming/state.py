"""Scenario state as a stream: records change the kept state of their scenario as they arrive.

Within a micro-batch a scenario's records are applied in the order of the batch fold (kind, then number); records of a
scenario that has no row of its own yet are dropped. The state of a scenario is one small row.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import KINDS

FIELDS = "status string, strength string, started_date date, clock_date date, end_reason string, n_updates int, rise double, rise_version int"


def _changed(s: dict | None, x) -> dict | None:
    """The state after one record (k, day, change, status, strength, reason, rise)."""
    if x.k == KINDS["scenario"]:
        on = x.day if x.status == "進行中" else None
        return {"status": x.status, "strength": x.strength, "started_date": on, "clock_date": on, "end_reason": None, "n_updates": 0, "rise": x.rise, "rise_version": 1}
    if s is None:
        return None
    s = dict(s)
    if x.k == KINDS["scenario_update"]:
        s["n_updates"] += 1
        s["strength"] = x.strength or s["strength"]
        if x.rise is not None:
            s["rise"], s["rise_version"] = x.rise, s["rise_version"] + 1
        if x.change == "強化" and s["status"] == "進行中":
            s["clock_date"] = x.day
        elif x.change == "起動" and s["status"] == "待機":
            s.update(status="進行中", started_date=x.day, clock_date=x.day)
        elif x.change == "消滅":
            s.update(status="終了", end_reason="シナリオが崩れた")
    elif x.k == KINDS["scenario_status"]:
        s["status"], s["end_reason"] = x.status, x.reason or s["end_reason"]
        if x.status == "進行中" and s["started_date"] is None:
            s.update(started_date=x.day, clock_date=x.day)
    return s


def fold(records: DataFrame, key: str = "scenario_id") -> DataFrame:
    """A stream of records (key, k, s, day, change, status, strength, reason, rise) to a stream of the states they leave."""
    kind = records.schema[key].dataType.simpleString()
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(keys: tuple, frames: Iterator, kept: GroupState):
        import pandas as pd

        rows = pd.concat(list(frames))
        rows = rows.astype(object).where(rows.notna(), None).sort_values(["k", "s"], kind="stable")
        state = dict(zip(names, kept.get, strict=True)) if kept.exists else None
        for x in rows.itertuples(index=False):
            state = _changed(state, x)
        if state is None:
            return
        kept.update(tuple(state.values()))
        yield pd.DataFrame([[keys[0], *state.values()]], columns=[key, *names])

    return records.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {FIELDS}", FIELDS, "update", GroupStateTimeout.NoTimeout)
