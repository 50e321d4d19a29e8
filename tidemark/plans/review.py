"""The monthly review: rates of picks whose outcome is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..calendar import with_seq
from ..functions import scoring as sc
from ..operators.evidence import plan_shares
from ..operators.prices import HORIZON, MOVE_BEGINS
from ..operators.tables import latest_by


def closed(elapsed: Column, expected_days: Column) -> Column:
    """Whether a pick's window is over: more business days than its expected ones, at most the longest horizon."""
    return elapsed > F.least(expected_days, F.lit(HORIZON))


def metrics(picks: DataFrame, decisions: DataFrame, today: Column, calendar: DataFrame) -> DataFrame:
    """One row a month of first picks (scenario_id, code, first_date, expected_days, moved, at_pick, scenario, stage), with
    the latest decision on each (scenario_id, code, action, _seq). Picks that neither moved nor are closed are pending."""
    out = with_seq(with_seq(picks.withColumn("__today", today), "first_date", "__a", calendar), "__today", "__b", calendar)
    out = out.withColumn("done", F.coalesce(F.col("moved") | closed(F.col("__b") - F.col("__a"), F.col("expected_days")), F.lit(False))).withColumn("month", F.trunc("first_date", "month"))
    out = out.join(latest_by(decisions, ["scenario_id", "code"], [F.col("_seq")], ["action"]), ["scenario_id", "code"], "left")
    hit, done = F.col("moved").cast("int"), F.col("done")
    rate = lambda which, value=hit: F.round(F.avg(F.when(which, value)), 3)
    bought, passed = done & (F.col("action") == "買う"), done & F.col("action").isin("監視", "見送り")
    stocks = out.groupBy("month").agg(
        F.count_if(done).alias("picks"), F.count_if(~done).alias("pending"), rate(done).alias("hit_rate_by_stock"), rate(done & (F.col("stage") == 1)).alias("stage1_hit_rate"),
        rate(done & F.col("moved") & F.col("at_pick").isNotNull(), (F.col("at_pick") < MOVE_BEGINS).cast("int")).alias("lead_rate"),
        F.count_if(bought).alias("bought"), rate(bought).alias("bought_hit_rate"), F.count_if(passed).alias("passed"), rate(passed).alias("passed_hit_rate"),
    )
    one = out.where("done").groupBy("month", "scenario").agg(F.bool_or("moved").alias("hit"))
    scenarios = one.groupBy("month").agg(F.count("*").alias("scenarios"), F.count_if("hit").alias("k"))
    k, n = F.col("k"), F.col("scenarios")
    scenarios = scenarios.select("month", "scenarios", F.round(k / n, 3).alias("hit_rate_by_scenario"), sc.wilson(k, n, False).alias("low"), sc.wilson(k, n, True).alias("high"))
    return stocks.join(scenarios, "month", "left")


def failures(picks: DataFrame, plan: DataFrame, today: Column, calendar: DataFrame) -> DataFrame:
    """(month, scenario_id, code, arrows) of first picks (scenario_id, code, first_date, expected_days, moved) whose window is
    over without a move, with the arrows (arrow_no, status) of their check plans; no plan gives none."""
    out = with_seq(with_seq(picks.withColumn("__today", today), "first_date", "__a", calendar), "__today", "__b", calendar)
    out = out.where(~F.coalesce("moved", F.lit(False)) & closed(F.col("__b") - F.col("__a"), F.col("expected_days")))
    return out.join(plan_shares(plan), "scenario_id", "left").select(F.trunc("first_date", "month").alias("month"), "scenario_id", "code", "arrows")


def monthly_input(metrics: DataFrame, related: DataFrame) -> DataFrame:
    """(month, input): the review's input document, with how many related companies moved (month, moved)."""
    movers = related.groupBy("month").agg(F.count_if("moved").alias("related_movers"))
    out = metrics.join(movers, "month", "left").withColumn("related_movers", F.coalesce("related_movers", F.lit(0)))
    return out.select("month", F.to_json(F.struct(*out.columns)).alias("input"))


def write_cases(outcomes: DataFrame, path: str) -> None:
    """Computed outcomes of past cases as a table of their own, beside the curated files, which stay as they are."""
    outcomes.write.mode("overwrite").parquet(path)
