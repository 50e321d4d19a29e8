"""What evidence and check plans say of a scenario."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Statuses of an arrow, statuses of a listing that keep a code from being picked.
CONFIRMED, DENIED, UNSEEN = "確認", "否定", "未確認"
POSTS = ["監理", "整理"]
LOW_TIER = 3  # sources of this tier and above don't carry a scenario alone


def plan_shares(plan: DataFrame) -> DataFrame:
    """(scenario_id, verified, denied, arrows) of plan rows (scenario_id, arrow_no, status): the share of arrows that are
    confirmed, the number of those denied, and all of them as no and status, by number."""
    return plan.groupBy("scenario_id").agg(
        F.avg(F.when(F.col("status") == CONFIRMED, 1).otherwise(0)).alias("verified"), F.count_if(F.col("status") == DENIED).cast("int").alias("denied"),
        F.sort_array(F.collect_list(F.struct("arrow_no", "status"))).alias("arrows"),
    )


def low_tier_only(evidence: DataFrame) -> DataFrame:
    """(scenario_id) of scenarios with supporting evidence, all of it from low tiers; evidence (scenario_id, supports, source_tier)."""
    return evidence.where("supports = 'for'").groupBy("scenario_id").agg(F.min("source_tier").alias("__t")).where(F.col("__t") >= LOW_TIER).select("scenario_id")


def on_post(listing: DataFrame, code: str) -> DataFrame:
    """(code) of codes whose row of the listing's last day (code, date, status) is a monitored post."""
    last = listing.agg(F.max("date").alias("__last"))  # one row
    return listing.join(F.broadcast(last), F.col("date") == F.col("__last")).where(F.col("status").isin(POSTS)).select(code).distinct()


def flagged(rows: DataFrame, keys: DataFrame, into: str) -> DataFrame:
    """rows with whether their key is among keys (distinct)."""
    return rows.join(keys.withColumn(into, F.lit(True)), keys.columns, "left").withColumn(into, F.coalesce(into, F.lit(False)))
