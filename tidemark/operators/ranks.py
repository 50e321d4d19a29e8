"""Places and running sums in an order, without a task that holds all rows or all rows of a key."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut

_PLACES = 33  # bits that a task's own count has in monotonically_increasing_id


def numbered(df: DataFrame, order: list[Column], into: str, by: list[str] | None = None) -> DataFrame:
    """df with each row's place in `order`, from 1; within `by`, if given.

    Rows are sorted into ranges (one sampled range exchange, a hot key of `by` is spread over as many ranges as it needs)
    and stored with their place in their range. A range begins after the counts of those before it: one number a range goes
    through the driver. Within `by`, a key's places are less its first one, which is one more aggregation by key.
    """
    keys = by or []
    sort = [F.col(k).asc_nulls_first() for k in keys] + list(order)
    stored = cut(df.orderBy(*sort).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", _PLACES)
    counts = sorted(stored.groupBy(part.alias("part")).count().collect())
    begun = [0, *accumulate(r["count"] for r in counts)]
    spark = df.sparkSession
    starts = spark.createDataFrame([(r["part"], b) for r, b in zip(counts, begun, strict=False)], "__part long, __begun long")
    placed = stored.withColumn("__part", part).join(F.broadcast(starts), "__part")
    placed = placed.withColumn(into, F.col("__begun") + F.col("__at").bitwiseAND((1 << _PLACES) - 1) + 1).drop("__part", "__begun", "__at")
    if not keys:
        return placed
    first = placed.groupBy(*keys).agg(F.min(into).alias("__first"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    joined = placed.alias("a").join(first.alias("b"), same)
    return joined.select(*[(F.col(f"a.{into}") - F.col("b.__first") + 1).alias(into) if c == into else F.col(f"a.`{c}`") for c in placed.columns])


def running(df: DataFrame, order: list[Column], amount: str, into: str, by: list[str] | None = None) -> DataFrame:
    """df with the sum of `amount` (whole numbers) over the rows before each in `order`, its own not counted; within `by`, if given.

    As in `numbered`: ranges are sorted and stored, a range's rows are summed by themselves, and a range starts from the sum
    of those before it. Within `by`, a key's sums are less its least one.
    """
    keys = by or []
    sort = [F.col(k).asc_nulls_first() for k in keys] + list(order)
    stored = cut(df.orderBy(*sort).withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", _PLACES))
    sums = sorted(stored.groupBy("__part").agg(F.sum(amount).alias("s")).collect())
    begun = [0, *accumulate(r["s"] or 0 for r in sums)]
    starts = df.sparkSession.createDataFrame([(r["__part"], b) for r, b in zip(sums, begun, strict=False)], "__part long, __begun long")
    before = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)  # a range
    told = stored.join(F.broadcast(starts), "__part").withColumn(into, F.col("__begun") + F.coalesce(F.sum(amount).over(before), F.lit(0))).drop("__part", "__begun", "__at")
    if not keys:
        return told
    told = cut(told)
    first = told.groupBy(*keys).agg(F.min(into).alias("__first"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    joined = told.alias("a").join(first.alias("b"), same)
    return joined.select(*[(F.col(f"a.{into}") - F.col("b.__first")).alias(into) if c == into else F.col(f"a.`{c}`") for c in told.columns])
