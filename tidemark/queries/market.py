"""Queries over prices: bars, as-of, returns, volatility, sigma, turnover, bands, business days."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import calendar
from ..operators import prices as ops
from ..sources.files import normalised
from . import base
from .base import query


def _sigma(spark, d):
    by_day = ops.benchmark_by_day(base.benchmark(spark, d), calendar.dimension(spark))
    return ops.day_sigma(ops.daily_features(base.prices(spark, d)), by_day)


SIG = ("px", "idx", "cal", "bday", "feat", "sig")


@query("SELECT code, date, close, volume FROM px WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-06-30'", ("px",))
def px_daily_bars(spark, d):
    """SRC17: bars with columns in any case and more of them than are wanted, normalised, in a closed range of dates."""
    close = F.col("close")
    raw = base.prices(spark, d).select("code", F.col("date").cast("timestamp").alias("Date"), *[close.alias(c) for c in ("Open", "HIGH", "low", "Close", "Adj")], F.col("volume").alias("VOLUME"))
    return normalised(raw, "1996-01-01", "1996-06-30").select("code", "date", "close", "volume")


def _probes(spark, d):
    codes = base.prices(spark, d).select("code").distinct()
    ends = spark.range(0, 80).select(F.expr("last_day(add_months(date'1995-01-01', cast(id as int)))").alias("date"))
    return codes.join(F.broadcast(ends))


_PROBES = "probes AS (SELECT code, CAST(last_day(DATE '1995-01-01' + to_months(CAST(i AS INTEGER))) AS DATE) AS date FROM (SELECT DISTINCT code FROM px), range(80) r(i))"


@query(f"SELECT * FROM (WITH {_PROBES} SELECT p.code, p.date, px.close FROM probes p ASOF LEFT JOIN px ON p.code = px.code AND px.date < p.date)", ("px",))
def asof_close_before(spark, d):
    """JN1: the last close strictly before a date."""
    return ops.as_of(_probes(spark, d), base.prices(spark, d), ["code"], inclusive=False).select("code", "date", "close")


@query(f"SELECT * FROM (WITH {_PROBES} SELECT p.code, p.date, px.close FROM probes p ASOF LEFT JOIN px ON p.code = px.code AND px.date <= p.date)", ("px",))
def asof_close_on_or_before(spark, d):
    """JN2: the last close on or before a date."""
    return ops.as_of(_probes(spark, d), base.prices(spark, d), ["code"]).select("code", "date", "close")


@query(
    """SELECT DISTINCT q.key, q.source, q.day, coalesce(a.value, 0.0) AS value
    FROM (SELECT DISTINCT key, source, CAST(DATE '2024-01-01' + CAST(5 * i AS INTEGER) AS DATE) AS day FROM attn, range(6) r(i)) q
    ASOF LEFT JOIN attn a ON q.key = a.key AND q.source = a.source AND a.date <= q.day""",
    ("attn",),
)
def attention_asof(spark, d):
    """JN3: the latest value up to a day, 0 where there is none."""
    a = base.attention(spark, d)
    days = spark.range(6).select(F.expr("date_add(date'2024-01-01', cast(5 * id as int))").alias("date"))
    probes = a.select("key", "source").distinct().join(F.broadcast(days))
    out = ops.as_of(probes, a, ["key", "source"], value="value", into="v")
    return out.select("key", "source", F.col("date").alias("day"), F.coalesce("v", F.lit(0.0)).alias("value"))


@query(
    """SELECT s.scenario_id, s.code, round((c1.close / c0.close - 1) - (b1.b_on / b0.b_before - 1), 6) AS excess
    FROM (SELECT *, CAST(first_date + 30 AS DATE) AS until FROM picks) s
    ASOF LEFT JOIN px c0 ON s.code = c0.code AND c0.date < s.first_date
    ASOF LEFT JOIN px c1 ON s.code = c1.code AND c1.date <= s.until
    LEFT JOIN bday b0 ON b0.b_date = s.first_date LEFT JOIN bday b1 ON b1.b_date = s.until""",
    ("px", "idx", "cal", "bday", "picks"),
)
def excess_return_window(spark, d):
    """WIN1: return over the benchmark from before the pick to 30 days after."""
    spans = base.picks(spark, d).select("scenario_id", "code", F.col("first_date").alias("start"), F.date_add("first_date", 30).alias("end"))
    by_day = ops.benchmark_by_day(base.benchmark(spark, d), calendar.dimension(spark))
    return ops.excess_return(spans, base.prices(spark, d), by_day).select("scenario_id", "code", F.round("excess", 6).alias("excess"))


@query("SELECT code, date, round(vol, 6) AS vol FROM feat WHERE vol IS NOT NULL", ("px", "feat"))
def daily_vol_20(spark, d):
    """WIN2, AGG10: sample deviation of the last 20 daily returns."""
    return ops.daily_features(base.prices(spark, d)).where("vol is not null").select("code", "date", F.round("vol", 6).alias("vol"))


@query("SELECT code, date, round(excess, 6) AS excess, round(sigma, 6) AS sigma FROM sig WHERE sigma IS NOT NULL", SIG)
def day_excess_sigma_20(spark, d):
    """WIN3: the day's excess in units of the volatility before it."""
    return _sigma(spark, d).where("sigma is not null").select("code", "date", F.round("excess", 6).alias("excess"), F.round("sigma", 6).alias("sigma"))


@query("SELECT code, date, round(sigma, 6) AS sigma FROM sig WHERE sigma >= 2", SIG)
def signal_reacted_days(spark, d):
    """WIN5, TOP6, flagship: all reactions."""
    return _sigma(spark, d).where("sigma >= 2").select("code", "date", F.round("sigma", 6).alias("sigma"))


@query("SELECT code, date, round(ret_k, 6) AS ret_20 FROM feat WHERE ret_k IS NOT NULL", ("px", "feat"))
def return_over_20(spark, d):
    """WIN4: return over 20 rows."""
    return ops.daily_features(base.prices(spark, d)).where("ret_k is not null").select("code", "date", F.round("ret_k", 6).alias("ret_20"))


@query("SELECT code, date, round(turnover, 6) AS turnover FROM feat", ("px", "feat"))
def avg_turnover_20(spark, d):
    """AGG9: mean of close times volume over 20 rows."""
    return ops.daily_features(base.prices(spark, d)).select("code", "date", F.round("turnover", 6).alias("turnover"))


@query(
    """SELECT code, date, close, round_even(sigma, 2) AS sigma, round_even(ret_k, 4) AS return_20d, round_even(turnover, 0) AS avg_turnover
    FROM sig WHERE date >= (SELECT max(date) FROM px) - 240 QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) = 1""",
    SIG,
)
def market_state_latest(spark, d):
    """WIN10: the latest row of each code within 240 days of the last date."""
    s = _sigma(spark, d)
    last = base.prices(spark, d).agg(F.max("date").alias("last"))
    near = s.join(F.broadcast(last), F.col("date") >= F.date_sub("last", 240))
    top = near.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))).where("r = 1")
    return top.select("code", "date", "close", F.bround("sigma", 2).alias("sigma"), F.bround("ret_k", 4).alias("return_20d"), F.bround("turnover", 0).alias("avg_turnover"))


@query(
    """SELECT a.code, eval_date, count(*) AS bars, min(date) AS first, max(date) AS last, round(arg_max(close, date), 6) AS close FROM (
        SELECT DISTINCT CASE WHEN code < 18 THEN lpad(CAST(code + 1300 AS VARCHAR), 4, '0') ELSE 'F' || code END AS code, CAST(date_trunc('month', first_date) AS DATE) AS eval_date FROM picks) a
    JOIN (SELECT CAST(code + 1300 AS VARCHAR) AS code, date, close FROM px UNION ALL
        SELECT 'F' || c_nationkey, CAST(o_orderdate AS DATE), CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2) b
    ON a.code = b.code AND date BETWEEN eval_date - 240 AND eval_date GROUP BY 1, 2""",
    ("px", "picks"),
)
def loaded_prices(spark, d):
    """SRC19: the bars that an evaluation at each month's start reads: 240 days of each code, foreign codes from the second source."""
    code = lambda c: F.when(c < 18, (c + 1300).cast("string")).otherwise(F.concat(F.lit("F"), c.cast("string")))
    asked = base.picks(spark, d).select(code(F.col("code")).alias("code"), F.trunc("first_date", "month").alias("eval_date"))
    home = base.prices(spark, d).select((F.col("code") + 1300).cast("string").alias("code"), "date", "close")
    nation = base.read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("F"), "c_nationkey").alias("code"))
    orders = base.read(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").cast("decimal(18,2)").alias("paid")).join(nation, "o_custkey")
    foreign = orders.groupBy("code", "date").agg((F.sum("paid").cast("double") / F.count("*")).alias("close"))
    return ops.near(asked, home, foreign).groupBy("code", "eval_date").agg(F.count("*").alias("bars"), F.min("date").alias("first"), F.max("date").alias("last"), F.round(F.max_by("close", "date"), 6).alias("close"))


@query(
    """SELECT code, date, round(max(abs_z), 6) AS z FROM (SELECT code, date, CASE WHEN n >= 22 THEN abs(ret / nullif(prior_vol, 0)) END AS abs_z FROM feat)
    WHERE abs_z >= 3 GROUP BY code, date""",
    ("px", "feat"),
)
def overnight_moves(spark, d):
    """WIN9: last return against the deviation of the 20 before, without a benchmark."""
    f = ops.daily_features(base.prices(spark, d)).where("n >= 22")
    z = f.withColumn("z", F.abs(F.try_divide("ret", "prior_vol"))).where("z >= 3")
    return z.select("code", "date", F.round("z", 6).alias("z"))


_bands = ", ".join(f"({a}, {b})" for a, b in ops.LIMIT_BANDS)


@query(
    f"""SELECT p.p_partkey, CAST(max(w) AS DOUBLE) AS limit_width FROM (SELECT p_partkey, p_retailprice * (p_partkey % 50) AS price FROM part) p
    JOIN (VALUES {_bands}) b(lower, w) ON p.price >= b.lower GROUP BY p.p_partkey"""
)
def price_limit_band(spark, d):
    """JN19, SC20: width of the band of a price."""
    p = base.read(spark, d, "part").select("p_partkey", (F.col("p_retailprice") * (F.col("p_partkey") % 50)).alias("price"))
    return p.select("p_partkey", ops.price_limit(F.col("price")).alias("limit_width"))


@query(
    """SELECT o_orderkey, s.is_bd, CASE WHEN n = 0 THEN s.d ELSE t.d END AS shifted, e.bd_seq - s.bd_seq AS days_between
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(o_orderkey % 41 - 20 AS INTEGER) AS n FROM orders) o
    JOIN cal s ON s.d = o.day JOIN cal e ON e.d = CAST(o.day + 3 * n AS DATE)
    JOIN cal t ON t.is_bd AND t.bd_seq = s.bd_seq + n + CASE WHEN n < 0 AND NOT s.is_bd THEN 1 ELSE 0 END""",
    ("cal",),
)
def business_day_math(spark, d):
    """SC10-12: business-day test, shift and distance."""
    cal = calendar.dimension(spark)
    o = base.read(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), (F.col("o_orderkey") % 41 - 20).cast("int").alias("n"))
    o = calendar.add_business_days(o.withColumn("until", F.expr("date_add(day, 3 * n)")), "day", F.col("n"), "shifted", cal)
    o = calendar.with_seq(calendar.with_seq(o, "day", "a", cal), "until", "b", cal)
    flag = cal.select(F.col("d").alias("day"), "is_bd")
    return o.join(F.broadcast(flag), "day").select("o_orderkey", "is_bd", "shifted", (F.col("b") - F.col("a")).alias("days_between"))


def _moved(spark, d):
    cal = calendar.dimension(spark)
    by_day = ops.benchmark_by_day(base.benchmark(spark, d), cal)
    return ops.moved(base.picks(spark, d).select("scenario_id", "code", "first_date", "expected_days"), base.prices(spark, d), by_day, cal)


MOVED = ("px", "idx", "cal", "bday", "picks", "moved")


@query("SELECT scenario_id, code, round(max_excess, 6) AS max_excess, moved_at, moved, days_to_move FROM moves", MOVED)
def moved_within_horizon(spark, d):
    """WIN6, AGG19: best excess over the horizon, the day a move began, and whether it went far enough."""
    return _moved(spark, d).select("scenario_id", "code", F.round("max_excess", 6).alias("max_excess"), "moved_at", "moved", "days_to_move")


@query(
    """SELECT date_trunc('month', first_date)::DATE AS month, count(*) AS picks, CAST(count_if(moved) AS BIGINT) AS hits, round(avg(CASE WHEN moved THEN 1.0 ELSE 0.0 END), 3) AS hit_rate,
    count(days_to_move) AS begun, list_sort(list(days_to_move) FILTER (WHERE days_to_move IS NOT NULL))[count(days_to_move) // 2 + 1] AS upper_median_days FROM moves GROUP BY 1""",
    MOVED,
)
def monthly_hit_rates(spark, d):
    """AGG16, PIP7: hit rate by month, with the upper median of days to the move."""
    m = _moved(spark, d).groupBy(F.trunc("first_date", "month").alias("month"), "days_to_move").agg(F.count("*").alias("n"), F.count_if("moved").alias("hits"))
    # Rates and the middle come from counts of distinct values, not from a list of all rows.
    w, begun = Window.partitionBy("month"), F.when(F.col("days_to_move").isNotNull(), F.col("n"))
    run = m.withColumn("upto", F.sum(begun).over(w.orderBy("days_to_move"))).withColumn("all", F.sum(begun).over(w))
    return run.groupBy("month").agg(
        F.sum("n").alias("picks"), F.sum("hits").alias("hits"), F.round(F.sum("hits") / F.sum("n"), 3).alias("hit_rate"),
        F.coalesce(F.sum(begun), F.lit(0)).alias("begun"), F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("days_to_move"))).alias("upper_median_days"),
    )


@query(
    """SELECT month, round(avg(CASE WHEN best >= 0.10 THEN 1.0 ELSE 0.0 END), 3) AS base_rate, count(*) AS codes FROM (
        SELECT m.month, m.code, max((m.close / m.c0 - 1) - (coalesce(i.close, i0.close) / i0.close - 1)) AS best
        FROM (SELECT *, date_trunc('month', date)::DATE AS month, row_number() OVER w AS k, first_value(close) OVER w AS c0, first_value(date) OVER w AS d0
              FROM px WINDOW w AS (PARTITION BY code, date_trunc('month', date) ORDER BY date)) m
        JOIN idx i0 ON i0.date = m.d0 LEFT JOIN idx i ON i.date = m.date WHERE m.k BETWEEN 2 AND 21 GROUP BY m.month, m.code) GROUP BY month""",
    ("px", "idx"),
)
def base_rate_by_month(spark, d):
    """AGG17, JN20: share of codes whose best excess within 20 rows of the month's first reaches the mark."""
    w = Window.partitionBy("code", "month").orderBy("date")
    p = base.prices(spark, d).withColumn("month", F.trunc("date", "month"))
    p = p.withColumns({"k": F.row_number().over(w), "c0": F.first("close").over(w), "d0": F.first("date").over(w)}).where("k between 2 and 21")
    i = base.benchmark(spark, d)
    first = i.select(F.col("date").alias("d0"), F.col("close").alias("i0"))
    p = p.join(first, "d0").join(i.select("date", F.col("close").alias("i1")), "date", "left")
    excess = (F.col("close") / F.col("c0") - 1) - (F.coalesce("i1", "i0") / F.col("i0") - 1)
    best = p.groupBy("month", "code").agg(F.max(excess).alias("best"))
    return best.groupBy("month").agg(F.round(F.avg(F.when(F.col("best") >= 0.10, 1.0).otherwise(0.0)), 3).alias("base_rate"), F.count("*").alias("codes"))
