"""Nights in a row: what a night writes depends on what the nights before it wrote.

Three tables keep what a night leaves, each row with its night: snapshots of the ranking (scenario_id, code, priced), the
tracking of picks (scenario_id, code, event, detail) and statuses (scenario_id, status, reason). A night reads them as of the
night before and returns the rows to append, so a night that is run again over the same tables gives the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..calendar import with_seq
from ..functions import scoring as sc
from ..operators.prices import excess_return, moved
from ..shared import cut
from .nightly import dormant, endings, first_picks, new_signals, reacted

# Fixed values.
ENDED, ASLEEP = "終了", "休眠"
WEAK_ENDS = ["材料が弱かった", "連想が市場に届かなかった", "シナリオが崩れた"]
WEAKENING, BREAKING = "弱体化", "消滅"


@dataclass(frozen=True)
class Kept:
    """What the nights so far have written; every frame has `night`."""

    snapshots: DataFrame
    tracking: DataFrame
    statuses: DataFrame

    def before(self, day: Column) -> Kept:
        return Kept(*[t.where(F.col("night") < day) for t in (self.snapshots, self.tracking, self.statuses)])

    def plus(self, new: Kept) -> Kept:
        return Kept(self.snapshots.unionByName(new.snapshots), self.tracking.unionByName(new.tracking), self.statuses.unionByName(new.statuses))


def night(day: str, picks: DataFrame, updates: DataFrame, prices: DataFrame, sigma: DataFrame, by_day: DataFrame, calendar: DataFrame, kept: Kept) -> Kept:
    """The rows that this night adds to each table.

    picks (scenario_id, code, first_date, expected_days, median, prob, stage, started): all up to the day. updates
    (scenario_id, type): those committed so far. prices and sigma are what tonight's feed gives, up to the day; a code whose
    feed gives nothing is not evaluated, and its priced-in degree is that of its last snapshot.
    """
    today = F.lit(day).cast("date")
    old = kept.before(today)
    status = old.statuses.groupBy("scenario_id").agg(F.max_by(F.struct("status", "reason"), "night").alias("s")).select("scenario_id", F.col("s.status").alias("old_status"), F.col("s.reason").alias("old_reason"))
    last = old.snapshots.groupBy("scenario_id", "code").agg(F.max_by("priced", "night").alias("last_priced"))
    told = updates.groupBy("scenario_id").agg(F.bool_or(F.col("type").isin(WEAKENING, BREAKING)).alias("weakened"), F.bool_or(F.col("type") == BREAKING).alias("broken"))

    ev = picks.withColumn("day", today).join(status, "scenario_id", "left").join(last, ["scenario_id", "code"], "left").join(told, "scenario_id", "left")
    ev = ev.withColumns({"weakened": F.coalesce("weakened", F.lit(False)), "broken": F.coalesce("broken", F.lit(False))})
    ev = reacted(excess_return(ev, prices, by_day, "first_date", "day"), sigma, "first_date", "day", "hit")
    ev = with_seq(with_seq(ev, "first_date", "__a", calendar), "day", "__b", calendar).withColumn("elapsed", F.col("__b") - F.col("__a")).drop("__a", "__b")
    seen = ~F.col("started") | F.col("excess").isNotNull()
    priced = F.when(~F.col("started"), 0.0).when(seen, sc.priced_in(F.col("excess"), F.col("median"))).otherwise(F.coalesce("last_priced", F.lit(0.0)))
    ev = cut(ev.withColumns({"seen": seen, "priced": priced, "waiting_days": F.col("elapsed"), "tier1_reacted": F.col("hit"), "reacted": F.col("hit")}))

    open_ = ev.where("old_status is null")
    ended = cut(endings(open_))
    fresh = sc.freshness(F.col("started"), F.col("elapsed"), F.col("expected_days"))
    left = open_.join(ended, "scenario_id", "left_anti").withColumn("confidence", F.round(sc.confidence(F.col("prob"), F.col("median"), F.col("priced"), fresh), 9))
    asleep = cut(dormant(left.select("scenario_id").distinct(), left))
    active = left.join(asleep, "scenario_id", "left_anti")
    snapshots = active.where("seen").select(today.alias("night"), "scenario_id", "code", "priced")
    statuses = ended.select(today.alias("night"), "scenario_id", F.lit(ENDED).alias("status"), F.col("end_reason").alias("reason"))
    statuses = statuses.unionByName(asleep.select(today.alias("night"), "scenario_id", F.lit(ASLEEP).alias("status"), F.lit(None).cast("string").alias("reason")))

    # Signals of all that is tracked, ended or not; only those that differ from what was told last.
    reason = F.coalesce("end_reason", F.when(F.col("old_status") == ENDED, F.col("old_reason")))
    all_of_them = ev.join(ended, "scenario_id", "left").join(active.select("scenario_id", F.lit(True).alias("active")).distinct(), "scenario_id", "left").withColumn("reason", reason)
    weak = F.col("weakened") | F.coalesce(F.col("reason").isin(WEAK_ENDS), F.lit(False)) | (F.col("reason").isNotNull() & (F.col("priced") < sc.PRICED_NEARLY))
    remaining = F.when(F.coalesce("active", F.lit(False)) & F.col("seen") & F.col("started"), F.col("expected_days") - F.col("elapsed")).otherwise(99)
    signals = all_of_them.select("scenario_id", "code", F.col("elapsed").alias("days_since_pick"), sc.sell_signals(F.lit(False), weak, F.col("priced"), remaining).alias("signals")).where(F.size("signals") > 0)
    emitted = old.tracking.where("event = 'sell_signal'").select("scenario_id", "code", F.split("detail", r"\|").alias("signals"), F.col("night").alias("_seq"))
    new = new_signals(signals, emitted).select("scenario_id", "code", F.lit("sell_signal").alias("event"), F.array_join("signals", "|").alias("detail"))

    done = old.tracking.where("event = 'moved'").select("scenario_id", "code")
    asked = ev.where("first_date < day").select("scenario_id", "code", "first_date", "expected_days").join(done, ["scenario_id", "code"], "left_anti")
    moves = moved(asked, prices, by_day, calendar).where("moved").select("scenario_id", "code", F.lit("moved").alias("event"), F.date_format("moved_at", "yyyy-MM-dd").alias("detail"))
    ranked = ev.select("scenario_id", "code", F.lit("本命").alias("tier"), F.date_format("first_date", "yyyy-MM-dd").alias("detail"))
    picked = first_picks(ranked, old.tracking.where("event = 'picked'")).select("scenario_id", "code", F.lit("picked").alias("event"), "detail")
    tracking = picked.unionByName(moves).unionByName(new).select(today.alias("night"), "scenario_id", "code", "event", "detail")
    return Kept(cut(snapshots), cut(tracking), cut(statuses))
