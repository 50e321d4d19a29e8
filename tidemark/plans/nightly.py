"""The close-of-day transition: grades, end rules, the cap on active scenarios, moves, signals - in this order,
each step on what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..calendar import add_business_days, with_seq
from ..functions import scoring as sc
from ..operators.prices import as_of, excess_return, moved
from ..operators.state import ACTIVE
from ..shared import cut


def endings(evaluated: DataFrame) -> DataFrame:
    """(scenario_id, end_reason) of scenarios that end: reactions of any candidate (stage 2 or later), the
    largest priced-in degree."""
    one = evaluated.groupBy("scenario_id").agg(
        F.bool_or("broken").alias("broken"), F.first("started").alias("started"), F.first("waiting_days").alias("waiting_days"), F.first("elapsed").alias("elapsed"),
        F.first("expected_days").alias("expected_days"), F.bool_or("tier1_reacted").alias("tier1"), F.bool_or(F.col("reacted") & (F.col("stage") >= 2)).alias("reacted"), F.max("priced").alias("priced"),
    )
    cols = [F.col(c) for c in ("broken", "started", "waiting_days", "elapsed", "expected_days", "tier1", "reacted", "priced")]
    return one.select("scenario_id", sc.end_reason(*cols).alias("end_reason")).where("end_reason is not null")


def dormant(active: DataFrame, confidence: DataFrame) -> DataFrame:
    """Active scenarios beyond the cap, the least confident first; a scenario without candidates counts as 0. The few most
    confident ones are taken (each task's best, then the best of all), and the others are all that isn't among them."""
    best = confidence.groupBy("scenario_id").agg(F.max("confidence").alias("c"))
    told = active.join(best, "scenario_id", "left").withColumn("c", F.coalesce("c", F.lit(0.0)))
    kept = told.orderBy(F.desc("c"), F.desc("scenario_id")).limit(ACTIVE).select("scenario_id")
    return told.select("scenario_id").join(F.broadcast(kept), "scenario_id", "left_anti")


def new_signals(signals: DataFrame, emitted: DataFrame) -> DataFrame:
    """Signals (scenario_id, code, days_since_pick, signals) that differ from the last emitted ones, up to the
    limit of days after the pick."""
    last = emitted.groupBy("scenario_id", "code").agg(F.max_by("signals", "_seq").alias("__last"))
    out = signals.join(last, ["scenario_id", "code"], "left")
    changed = ~F.coalesce("__last", F.array().cast("array<string>")).eqNullSafe(F.col("signals"))
    return out.where(changed & (F.col("days_since_pick") <= sc.LONGEST_WAIT)).drop("__last")


def first_picks(ranked: DataFrame, tracked: DataFrame) -> DataFrame:
    """Picks that appear for the first time."""
    return ranked.where("tier = '本命'").join(tracked.select("scenario_id", "code"), ["scenario_id", "code"], "left_anti")


def reacted(spans: DataFrame, sigma: DataFrame, since: str, until: str, into: str) -> DataFrame:
    """spans (code, since, until, ...) with whether any day in them reached the mark: the last such day up to `until`
    isn't before `since`."""
    marks = sigma.where(F.col("sigma") >= sc.REACTION).select("code", "date", F.col("date").alias("last"))
    out = as_of(spans.withColumn("date", F.col(until)), marks, ["code"], value="last", into="__last")
    return out.withColumn(into, F.coalesce(F.col("__last") >= F.col(since), F.lit(False))).drop("date", "__last")


def final_grades(grades: DataFrame, prices: DataFrame, index: DataFrame, sigma: DataFrame, calendar: DataFrame) -> DataFrame:
    """(scenario_id, detail) of grades (scenario_id, code, first_date, grade, unchecked, day) that are due: given before the
    day, with the next business day reached. A grade waits while prices don't reach that day; the larger sigma of its
    two days confirms or lowers it, no sigma at all leaves it unchecked."""
    due = add_business_days(grades, "first_date", F.lit(1), "next_day", calendar).where("first_date < day and next_day <= day")
    last = prices.groupBy("code").agg(F.max("date").alias("last"))
    newest = index.agg(F.max("date").alias("newest"))  # one row
    days = due.select("scenario_id", "code", F.explode(F.array("first_date", "next_day")).alias("date"))
    top = days.join(sigma.select("code", "date", "sigma"), ["code", "date"]).groupBy("scenario_id").agg(F.max("sigma").alias("s"))
    out = due.join(last, "code", "left").join(F.broadcast(newest)).join(top, "scenario_id", "left")
    lower = sc.checked_grade(F.col("grade"), F.col("s") >= sc.REACTION)
    verdict = (
        F.when(~F.col("unchecked") & F.col("last").isNotNull() & (F.least("last", "newest") < F.col("next_day")), "waiting")
        .when(F.col("unchecked") | F.col("last").isNull() | F.col("s").isNull(), F.concat("grade", F.lit("|unchecked")))
        .when(lower != F.col("grade"), F.concat(lower, F.lit("|lowered")))
        .when((F.col("s") >= sc.REACTION) & F.col("grade").isin("B", "C"), F.concat("grade", F.lit("|overlooked")))
        .otherwise(F.concat("grade", F.lit("|kept")))
    )
    return out.select("scenario_id", verdict.alias("detail"))


def transition(night: DataFrame, prices: DataFrame, index: DataFrame, sigma: DataFrame, by_day: DataFrame, calendar: DataFrame) -> DataFrame:
    """(kind, scenario_id, detail) that one night writes, each step on what the ones before it decided.

    night: (scenario_id, code, first_date, expected_days, median, prob, stage, started, grade, unchecked, day), a candidate
    each; prices and index reach up to the day. Scenarios that end this night don't count for the cap; those that ended for
    a weak reason, or ended without being priced in, give the signal of a weakened scenario.
    """
    ev = excess_return(night, prices, by_day, "first_date", "day")
    ev = reacted(ev, sigma, "first_date", "day", "hit")
    ev = with_seq(with_seq(ev, "first_date", "__a", calendar), "day", "__b", calendar).withColumn("elapsed", F.col("__b") - F.col("__a"))
    ev = ev.withColumn("priced", F.when(F.col("started"), F.coalesce(sc.priced_in(F.col("excess"), F.col("median")), F.lit(0.0))).otherwise(0.0))
    ev = ev.withColumns({"broken": F.lit(False), "waiting_days": F.col("elapsed"), "tier1_reacted": F.col("hit"), "reacted": F.col("hit")})
    ev = cut(ev)
    ended = cut(endings(ev))
    fresh = sc.freshness(F.col("started"), F.col("elapsed"), F.col("expected_days"))
    ev = ev.withColumn("confidence", F.round(sc.confidence(F.col("prob"), F.col("median"), F.col("priced"), fresh), 9))
    active = ev.select("scenario_id").distinct().join(ended, "scenario_id", "left_anti")
    asleep = cut(dormant(active, ev))
    moves = moved(night.where("first_date < day").select("scenario_id", "code", "first_date", "expected_days"), prices, by_day, calendar).where("moved")
    told = ev.join(ended, "scenario_id", "left").join(asleep.withColumn("__asleep", F.lit(True)), "scenario_id", "left")
    reason = F.col("end_reason")
    weak = F.coalesce(reason.isin("材料が弱かった", "連想が市場に届かなかった", "シナリオが崩れた"), F.lit(False)) | (reason.isNotNull() & (F.col("priced") < sc.PRICED_NEARLY))
    open_ = F.col("started") & reason.isNull() & F.col("__asleep").isNull()
    signals = sc.sell_signals(F.lit(False), weak, F.col("priced"), F.when(open_, F.col("expected_days") - F.col("elapsed")).otherwise(99))
    signed = told.withColumn("signals", F.array_join(signals, "|")).where((F.col("signals") != "") & (F.col("elapsed") <= sc.LONGEST_WAIT))
    row = lambda kind, df, detail: df.select(F.lit(kind).alias("kind"), "scenario_id", detail.alias("detail"))
    parts = [
        row("grade_final", final_grades(night, prices, index, sigma, calendar), F.col("detail")), row("ended", ended, reason),
        row("dormant", asleep, F.lit("over the cap")), row("moved", moves, F.date_format("moved_at", "yyyy-MM-dd")), row("sell_signal", signed, F.col("signals")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
