"""Price operators: as-of look-ups, returns, volatility, sigma, turnover, limit bands.

A series is (code, date, close, volume); the benchmark is (date, close). Each code's rows are one window
partition, which the number of trading days bounds. The benchmark is spread over the calendar once and joined
by date: its size too is bounded by the number of days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOOKBACK = 240  # calendar days of prices that an evaluation reads

# Lower bound of the price band and its daily limit width.
LIMIT_BANDS = [
    (0, 30), (100, 50), (200, 80), (500, 100), (700, 150), (1000, 300), (1500, 400), (2000, 500), (3000, 700),
    (5000, 1000), (7000, 1500), (10000, 3000), (15000, 4000), (20000, 5000), (30000, 7000), (50000, 10000),
    (70000, 15000), (100000, 30000), (150000, 40000), (200000, 50000), (300000, 70000), (500000, 100000),
    (700000, 150000), (1000000, 300000), (1500000, 400000), (2000000, 500000), (3000000, 700000),
    (5000000, 1000000), (7000000, 1500000), (10000000, 3000000), (15000000, 4000000), (20000000, 5000000),
    (30000000, 7000000), (50000000, 10000000),
]


def last_values(probes: DataFrame, series: DataFrame, by: list[str], on: str, value: str, into: str, inclusive: bool) -> DataFrame:
    """probes with the series' last value on or before (inclusive) or strictly before their date: one window over both
    sides, for probes of which a key has few."""
    left = probes.withColumn("__v", F.lit(None).cast(series.schema[value].dataType)).withColumn("__k", F.lit(1 if inclusive else -1))
    right = series.select(*by, on, F.col(value).alias("__v")).withColumn("__k", F.lit(0))
    w = Window.partitionBy(*by).orderBy(on, "__k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = left.unionByName(right, allowMissingColumns=True)
    return both.withColumn(into, F.last("__v", ignorenulls=True).over(w)).where(F.col("__k") != 0).drop("__v", "__k")


def rejoin(rows: DataFrame, told: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """rows with the values that `told`, a row for each distinct combination of keys, has for theirs (nulls are equal)."""
    told = told.select(*[F.col(c).alias(f"__{c}") for c in keys], *values)
    return rows.join(told, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys], "left").drop(*[f"__{c}" for c in keys])


def as_of(probes: DataFrame, series: DataFrame, by: list[str], on: str = "date", value: str = "close", into: str = "close", inclusive: bool = True) -> DataFrame:
    """probes with the series' last value on or before (inclusive) or strictly before their date. Distinct (by, date) are
    looked up, and what is found joins the probes, so that many probes of one key and day cost one row of that
    key's window."""
    told = last_values(probes.select(*by, on).distinct(), series, by, on, value, into, inclusive)
    return rejoin(probes, told, [*by, on], [into])


def benchmark_by_day(benchmark: DataFrame, calendar: DataFrame) -> DataFrame:
    """(b_date, b_before, b_on): benchmark close strictly before, and on or before, each calendar day."""
    w = Window.orderBy("d")  # a row for each day of the calendar
    daily = calendar.select("d").join(benchmark.select(F.col("date").alias("d"), "close"), "d", "left")
    on = daily.withColumn("b_on", F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return on.select(F.col("d").alias("b_date"), F.lag("b_on").over(w).alias("b_before"), "b_on")


def daily_features(prices: DataFrame, window: int = 20, surged_days: int = 20) -> DataFrame:
    """prices with prev_close, ret, n, vol (through the row), prior_vol (through the row before), turnover and
    ret_k, all null where the history is too short."""
    w = Window.partitionBy("code").orderBy("date")
    out = prices.withColumn("prev_close", F.lag("close").over(w)).withColumn("n", F.row_number().over(w))
    out = out.withColumn("ret", F.try_divide(F.col("close"), F.col("prev_close")) - 1)
    through, before = w.rowsBetween(-(window - 1), 0), w.rowsBetween(-window, -1)
    return out.withColumns(
        {
            "vol": F.when(F.col("n") >= 3, F.stddev_samp("ret").over(through)),
            "prior_vol": F.when(F.col("n") >= 4, F.stddev_samp("ret").over(before)),
            "turnover": F.avg(F.col("close") * F.col("volume")).over(through),
            "ret_k": F.try_divide(F.col("close"), F.lag("close", surged_days).over(w)) - 1,
        }
    )


def day_sigma(features: DataFrame, by_day: DataFrame) -> DataFrame:
    """features with excess (over the benchmark, same day) and sigma = excess / prior volatility; with no
    volatility sigma is infinite where there is an excess, 0 where it is 0; null without an excess."""
    out = features.join(F.broadcast(by_day), F.col("date") == F.col("b_date"), "left")
    excess = F.col("ret") - (F.try_divide(F.col("b_on"), F.col("b_before")) - 1)
    out = out.withColumn("excess", excess)
    sigma = F.when(F.col("prior_vol") == 0, F.when(F.col("excess") != 0, F.lit(float("inf"))).when(F.col("excess") == 0, 0.0)).otherwise(F.try_divide(F.col("excess"), F.col("prior_vol")))
    return out.withColumn("sigma", F.when(F.col("prior_vol").isNotNull(), sigma))


def excess_return(spans: DataFrame, prices: DataFrame, by_day: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """spans (code, start, end, ...) with the return from the close strictly before start to the close on or
    before end, over the benchmark's; equal spans are looked up once."""
    keys = ["code", *dict.fromkeys((start, end))]
    asked = spans.select(*keys).distinct()
    out = last_values(asked.withColumn("date", F.col(start)), prices, ["code"], "date", "close", "from_close", False)
    out = last_values(out.withColumn("date", F.col(end)), prices, ["code"], "date", "close", "to_close", True)
    first = by_day.select(F.col("b_date").alias("__s"), F.col("b_before").alias("__b0"))
    last = by_day.select(F.col("b_date").alias("__e"), F.col("b_on").alias("__b1"))
    out = out.join(F.broadcast(first), F.col(start) == F.col("__s"), "left").join(F.broadcast(last), F.col(end) == F.col("__e"), "left")
    value = (F.try_divide(F.col("to_close"), F.col("from_close")) - 1) - (F.try_divide(F.col("__b1"), F.col("__b0")) - 1)
    return rejoin(spans, out.withColumn("excess", value), keys, ["excess"])


def price_limit(price: Column) -> Column:
    """Width of the band whose lower bound is the greatest at or below the price; null for negative prices."""
    out = F.when(price < 0, F.lit(None).cast("double"))
    for lower, width in reversed(LIMIT_BANDS):
        out = out.when(price >= lower, F.lit(float(width)))
    return out


# A move: its excess, the excess at which it has begun, and the longest span it may take in business days.
MOVE, MOVE_BEGINS, HORIZON = 0.10, 0.05, 20


def moved(picks: DataFrame, prices: DataFrame, by_day: DataFrame, calendar: DataFrame) -> DataFrame:
    """picks (scenario_id, code, first_date, expected_days) with max_excess (at least 0), moved_at, moved and
    days_to_move over the horizon after the pick date; equal spans are followed once."""
    from ..calendar import add_business_days, with_seq

    keys = ["code", "first_date", "expected_days"]
    asked = picks.select(*keys).distinct()
    out = add_business_days(asked, "first_date", F.least("expected_days", F.lit(HORIZON)), "end_date", calendar)
    out = add_business_days(out, "first_date", F.lit(1), "start", calendar)
    out = as_of(out.withColumn("date", F.col("start")), prices, ["code"], into="base", inclusive=False).drop("date")
    base = by_day.select(F.col("b_date").alias("__s"), F.col("b_before").alias("__b0"))
    out = out.join(F.broadcast(base), F.col("start") == F.col("__s"), "left").drop("__s")
    days = prices.select("code", F.col("date").alias("day"), F.col("close").alias("day_close")).join(F.broadcast(by_day.select("b_date", "b_on")), F.col("day") == F.col("b_date"))
    # Spans meet prices month by month of the horizon, so that the range condition has an equality beside it.
    month = lambda c: F.trunc(c, "month")
    spread = out.withColumn("__m", F.explode(F.sequence(month("first_date"), month("end_date"), F.expr("interval 1 month"))))
    hit = spread.join(days.withColumn("__m", month("day")), ["code", "__m"]).where("day > first_date and day <= end_date")
    excess = (F.try_divide(F.col("day_close"), F.col("base")) - 1) - (F.try_divide(F.col("b_on"), F.col("__b0")) - 1)
    seen = hit.withColumn("excess", excess).groupBy(*keys).agg(
        F.greatest(F.max("excess"), F.lit(0.0)).alias("max_excess"),
        F.min(F.when(F.col("excess") >= MOVE_BEGINS, F.col("day"))).alias("moved_at"),
        F.bool_or(F.col("excess") >= MOVE).alias("moved"),
    )
    done = picks.join(seen, keys, "left").withColumn("max_excess", F.coalesce("max_excess", F.lit(0.0))).withColumn("moved", F.coalesce("moved", F.lit(False)))
    done = with_seq(with_seq(done, "first_date", "__a", calendar), "moved_at", "__b", calendar)
    return done.withColumn("days_to_move", F.col("__b") - F.col("__a")).drop("__a", "__b")


def near(asked: DataFrame, home: DataFrame, foreign: DataFrame | None = None, days: int = LOOKBACK) -> DataFrame:
    """asked (code, eval_date), each once, with the bars (code, date, ...) of the `days` calendar days up to it. Codes of four
    characters that begin with a digit are home ones; the others are looked up in the foreign source, if there is one. A code
    without bars gives no row. Bars outside all asked days are dropped before the join, by the span of each code."""
    asked = asked.select("code", "eval_date").where("code is not null and eval_date is not null").distinct()
    own = F.col("code").rlike(r"^\d...$")
    bars = home if foreign is None else home.where(own).unionByName(foreign.where(~own))
    span = asked.groupBy("code").agg(F.date_sub(F.min("eval_date"), days).alias("__from"), F.max("eval_date").alias("__to"))
    bars = bars.join(span, "code").where("date between __from and __to").drop("__from", "__to")
    # Each bar goes to the asked days of its own and the next blocks of `days` only, so the join is by equal keys.
    block = lambda c: F.floor(F.unix_date(c) / days)
    at = asked.withColumn("__b", F.explode(F.array(block(F.col("eval_date")), block(F.col("eval_date")) - 1)))
    met = at.join(bars.withColumn("__b", block(F.col("date"))), ["code", "__b"]).drop("__b")
    return met.where((F.col("date") <= F.col("eval_date")) & (F.col("date") >= F.date_sub("eval_date", days)))
