"""Scenario state as a fold over an event log: kinds are applied in a fixed order, each by sequence number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PICKS, ACTIVE = 3, 15  # picks of a day, scenarios at a time
# Reasons of the second ranking pass, the order in which record kinds are applied.
NOT_STARTED = "待機中(未起動)"
NO_PRICES = "株価データが無い"
KINDS = {"scenario": 0, "candidate": 1, "check_plan": 2, "scenario_update": 3, "scenario_status": 4}


def fold(log: DataFrame, key: str, kind: Column, seq: Column, day: Column, change: Column, status: Column, strength: Column, reason: Column, rise: Column | None = None) -> DataFrame:
    """One row a scenario: status, strength, started_date, clock_date, end_reason, n_updates, rise, rise_version.

    The steps of one scenario are ordered by (kind, seq) and folded; a scenario's own log is small. A scenario row
    starts afresh; records of ids that no scenario row has are dropped. A rise that an update gives replaces the last
    one and counts a version.
    """
    rise = F.lit(None).cast("double") if rise is None else rise
    step = F.struct(kind.alias("k"), seq.alias("s"), day.alias("day"), change.alias("change"), status.alias("status"), strength.alias("strength"), reason.alias("reason"), rise.alias("rise"))
    logs = log.groupBy(key).agg(F.sort_array(F.collect_list(step)).alias("steps")).where(F.get("steps", F.lit(0))["k"] == KINDS["scenario"])
    null_day, null_text = F.lit(None).cast("date"), F.lit(None).cast("string")
    start = F.struct(null_text.alias("status"), null_text.alias("strength"), null_day.alias("started"), null_day.alias("clock"), null_text.alias("reason"), F.lit(0).alias("n"), F.lit(None).cast("double").alias("rise"), F.lit(0).alias("version"))

    def apply(acc, x):
        fresh, update, told = x["k"] == KINDS["scenario"], x["k"] == KINDS["scenario_update"], x["k"] == KINDS["scenario_status"]
        opens = fresh & (x["status"] == "進行中")
        wakes = update & (x["change"] == "起動") & (acc["status"] == "待機")
        renews = update & (x["change"] == "強化") & (acc["status"] == "進行中")
        dies = update & (x["change"] == "消滅")
        begins = told & (x["status"] == "進行中") & acc["started"].isNull()
        status = F.when(fresh | told, x["status"]).when(wakes, "進行中").when(dies, "終了").otherwise(acc["status"])
        raised = update & x["rise"].isNotNull()
        return F.struct(
            status.alias("status"),
            F.when(fresh, x["strength"]).when(update, F.coalesce(x["strength"], acc["strength"])).otherwise(acc["strength"]).alias("strength"),
            F.when(opens | wakes | begins, x["day"]).when(fresh, null_day).otherwise(acc["started"]).alias("started"),
            F.when(opens | wakes | begins | renews, x["day"]).when(fresh, null_day).otherwise(acc["clock"]).alias("clock"),
            F.when(fresh, null_text).when(dies, "シナリオが崩れた").when(told, F.coalesce(x["reason"], acc["reason"])).otherwise(acc["reason"]).alias("reason"),
            F.when(fresh, 0).otherwise(acc["n"] + update.cast("int")).alias("n"),
            F.when(fresh | raised, x["rise"]).otherwise(acc["rise"]).alias("rise"),
            F.when(fresh, 1).otherwise(acc["version"] + raised.cast("int")).alias("version"),
        )

    out = logs.withColumn("__f", F.aggregate("steps", start, apply))
    names = {"status": "status", "strength": "strength", "started": "started_date", "clock": "clock_date", "reason": "end_reason", "n": "n_updates", "rise": "rise", "version": "rise_version"}
    return out.select(key, *[F.col(f"__f.{a}").alias(b) for a, b in names.items()])


def plan_status(plan: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Status of each plan arrow: the last plain row replaces the arrow whole, later status rows overlay it."""
    rows = plan.groupBy(*keys).agg(F.max(F.when(~F.col("is_update"), F.col(seq))).alias("__p"), F.max_by("status", F.when(~F.col("is_update"), F.col(seq))).alias("__own"), F.max(F.when(F.col("is_update"), F.col(seq))).alias("__u"), F.max_by("status", F.when(F.col("is_update"), F.col(seq))).alias("__told"))
    return rows.where("__p is not null").select(*keys, F.when(F.col("__u") > F.col("__p"), F.col("__told")).otherwise(F.col("__own")).alias("status"))


def override(ranked: DataFrame, by: list[str], has_prices: Column, waiting: Column, max_picks: int = MAX_PICKS) -> DataFrame:
    """ranked (rank, reason, side) after a second pass: no prices, then waiting, replace the reason, and the first max_picks
    by rank that are long and have none are promoted; ranks stay as they are."""
    from pyspark.sql import Window

    reason = F.when(waiting, NOT_STARTED).when(~has_prices, NO_PRICES).otherwise(F.col("reason"))
    out = ranked.withColumn("reason", reason)
    able = F.col("reason").isNull() & (F.col("side") == "long")
    run = F.sum(able.cast("int")).over(Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("tier", F.when(able & (run <= max_picks), "本命").otherwise("監視"))


def rank_picks(candidates: DataFrame, by: list[str], order: list[Column], max_picks: int = MAX_PICKS) -> DataFrame:
    """candidates with rank (by order) and tier: the first max_picks without a reason, within each group."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(*order)
    out = candidates.withColumn("rank", F.row_number().over(w))
    run = F.sum(F.col("reason").isNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("tier", F.when(F.col("reason").isNull() & (run <= max_picks), "本命").otherwise("監視"))
