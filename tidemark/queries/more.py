"""Queries over smaller operators: look-ups, flags, dates, rounding, past cases, signals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import tables
from . import base
from .base import query


@query("SELECT event_id, CAST(ts + INTERVAL 9 HOUR AS DATE) AS jst_day, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso FROM events")
def dates_in_japan(spark, d):
    """SC8, SC9: Japanese date and ISO form of a UTC time."""
    return base.read(spark, d, "events").select("event_id", tx.jst_date(F.col("ts").cast("timestamp")).alias("jst_day"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("iso"))


_HEAT = "(VALUES (1, '上昇中'), (2, '横ばい'), (4, '冷却中'))"


@query(
    f"""SELECT o_orderkey, arg_min(temperature, pos) AS temperature FROM (
        SELECT o_orderkey, unnest([o_orderkey % 5, o_orderkey % 7, o_orderkey % 3]) AS theme, unnest([0, 1, 2]) AS pos FROM orders) JOIN {_HEAT} t(id, temperature) ON theme = id GROUP BY o_orderkey"""
)
def first_theme_temperature(spark, d):
    """JN10: the temperature of the first theme that has one."""
    heat = spark.createDataFrame([(1, "上昇中"), (2, "横ばい"), (4, "冷却中")], "theme long, temperature string")
    k = F.col("o_orderkey")
    themes = base.read(spark, d, "orders").select("o_orderkey", F.posexplode(F.array(k % 5, k % 7, k % 3)).alias("pos", "theme"))
    return themes.join(F.broadcast(heat), "theme").groupBy("o_orderkey").agg(F.min_by("temperature", "pos").alias("temperature"))  # heat: three rows


@query(
    """SELECT n_nationkey AS theme_id, n_name AS name, version, market_premise, temperature, date_diff('day', (SELECT max(CAST(o_orderdate AS DATE)) FROM orders), DATE '1998-08-10') >= 7 AS due FROM nation
    LEFT JOIN (SELECT s_nationkey, arg_max(s_suppkey % 7 + 1, s_suppkey) AS version, arg_max(s_name, s_suppkey) AS market_premise FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey
    LEFT JOIN (SELECT c_nationkey, arg_max(CASE WHEN o_orderstatus = 'P' THEN '上昇中' WHEN o_orderstatus = 'O' THEN '横ばい' ELSE '冷却中' END, o_orderkey) AS temperature FROM orders JOIN customer ON c_custkey = o_custkey
        WHERE c_acctbal > 0 AND c_nationkey <> 7 GROUP BY 1) ON c_nationkey = n_nationkey"""
)
def theme_states(spark, d):
    """JN8, FLT14: themes with their latest premise card and temperature, if they have any, and whether temperatures are due."""
    from ..plans import pack

    themes = base.read(spark, d, "nation").select(F.col("n_nationkey").alias("theme_id"), F.col("n_name").alias("name"))
    cards = base.read(spark, d, "supplier").select(F.col("s_nationkey").alias("theme_id"), (F.col("s_suppkey") % 7 + 1).alias("version"), F.col("s_name").alias("market_premise"), F.col("s_suppkey").alias("_seq"))
    told = base.read(spark, d, "customer").where("c_acctbal > 0 and c_nationkey <> 7").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("theme_id"))
    heat = F.when(F.col("o_orderstatus") == "P", "上昇中").when(F.col("o_orderstatus") == "O", "横ばい").otherwise("冷却中")
    orders = base.read(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("run_date"), heat.alias("temperature"), F.col("o_orderkey").alias("_seq"))
    return pack.theme_states(themes, cards, orders.join(told, "o_custkey"), "1998-08-10").select("theme_id", "name", F.col("card.version").cast("long").alias("version"), F.col("card.market_premise").alias("market_premise"), "temperature", "due")


@query(
    """SELECT user_id, round(avg(CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.0 END), 6) AS verified_ratio, CAST(count_if(event_type = 'error') AS BIGINT) AS denied,
    bool_or(value > 300) AS tier1_reacted, bool_or(value > 200 AND event_type = 'click') AS candidate_reacted, max(value) AS priced_in FROM events GROUP BY user_id"""
)
def scenario_flags(spark, d):
    """AGG11, AGG13: verified share, denied count, any / any / max by scenario."""
    kind, value = F.col("event_type"), F.col("value")
    return base.read(spark, d, "events").groupBy("user_id").agg(
        F.round(F.avg(F.when(kind == "view", 1.0).otherwise(0.0)), 6).alias("verified_ratio"), F.count_if(kind == "error").alias("denied"),
        F.bool_or(value > 300).alias("tier1_reacted"), F.bool_or((value > 200) & (kind == "click")).alias("candidate_reacted"), F.max("value").alias("priced_in"),
    )


@query(
    """SELECT e.event_id, coalesce(a.s_suppkey, k.c_custkey) AS resolved FROM events e
    LEFT JOIN supplier a ON e.event_id % 2 = 0 AND a.s_suppkey = e.user_id LEFT JOIN customer k ON k.c_custkey = e.user_id * 3 WHERE coalesce(a.s_suppkey, k.c_custkey) IS NOT NULL"""
)
def reference_resolution(spark, d):
    """JN23, VAL5: a new reference's id, else a known one, else the row is dropped."""
    e = base.read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("new_ref"), (F.col("user_id") * 3).alias("known_ref"))
    new = base.read(spark, d, "supplier").select(F.col("s_suppkey").alias("new_ref"), F.col("s_suppkey").alias("a"))
    known = base.read(spark, d, "customer").select(F.col("c_custkey").alias("known_ref"), F.col("c_custkey").alias("k"))
    out = e.join(new, "new_ref", "left").join(known, "known_ref", "left")
    return out.select("event_id", F.coalesce("a", "k").alias("resolved")).where("resolved is not null")


@query(
    """SELECT user_id, max(CAST(ts AS DATE)) AS last, date_diff('day', max(CAST(ts AS DATE)), DATE '2024-02-05') >= 7 AS due FROM events WHERE event_type = 'signup' GROUP BY user_id"""
)
def themes_due(spark, d):
    """FLT14: due if nothing came for a week."""
    e = base.read(spark, d, "events").where("event_type = 'signup'").groupBy("user_id").agg(F.max(F.to_date("ts")).alias("last"))
    return e.select("user_id", "last", (F.datediff(F.lit("2024-02-05").cast("date"), "last") >= 7).alias("due"))


@query(
    """SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY list_position(['P', 'O', 'F'], o_orderstatus), o_orderkey) AS INTEGER) AS place
    FROM orders QUALIFY place <= 30"""
)
def status_order(spark, d):
    """TOP5, TOP7, FLT9: a custom order of statuses, then the id; the first 30 of each group."""
    order = F.array_position(F.array(F.lit("P"), F.lit("O"), F.lit("F")), F.col("o_orderstatus"))
    w = Window.partitionBy("o_custkey").orderBy(order, "o_orderkey")
    return base.read(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("place")).where("place <= 30")


@query(
    """SELECT o_orderkey, CAST(CASE WHEN month(d) = 2 AND day(d) = 29 THEN d + 365 ELSE d + INTERVAL 1 YEAR END AS DATE) AS next_year, round_even(o_totalprice / 7, 2) AS half_even
    FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders)"""
)
def dates_and_rounding(spark, d):
    """SC13, SC30: a year later, and rounding of halves to even."""
    return base.read(spark, d, "orders").select("o_orderkey", tx.a_year_later(F.to_date("o_orderdate")).alias("next_year"), F.bround(F.col("o_totalprice") / 7, 2).alias("half_even"))


@query("SELECT s_suppkey, lower(s_name) || 'ab,c&d' AS name, replace(url_encode(s_name || ' é'), '+', '%20') AS encoded FROM supplier")
def names_and_urls(spark, d):
    """SC4, SC31: comparable company names (from full-width forms) and percent encoding."""
    wide = F.concat(F.lit("㈱"), F.translate("s_name", "0123456789", "０１２３４５６７８９"), F.lit("_A‐ B・,C&Dー"))
    return base.read(spark, d, "supplier").select("s_suppkey", tx.company_name(wide).alias("name"), tx.percent_encoded(F.concat("s_name", F.lit(" é"))).alias("encoded"))


@query(
    """SELECT scenario_id, round(greatest(coalesce(max(excess), 0), 0), 6) AS max_excess, coalesce(max(excess) >= 0.10, false) AS moved, CAST(min(CASE WHEN excess >= 0.05 THEN k END) AS INTEGER) AS days_to_move FROM (
        SELECT c.scenario_id, x.n - c.n AS k, (x.close / c.close - 1) - (b.b_on / b0.b_on - 1) AS excess
        FROM (SELECT p.scenario_id, f.* FROM picks p ASOF JOIN feat f ON p.code = f.code AND f.date <= p.first_date) c
        LEFT JOIN feat x ON x.code = c.code AND x.n > c.n AND x.n <= c.n + 20 LEFT JOIN bday b ON b.b_date = x.date LEFT JOIN bday b0 ON b0.b_date = c.date) GROUP BY scenario_id""",
    ("px", "idx", "cal", "bday", "feat", "picks"),
)
def past_case_outcomes(spark, d):
    """AGG20, PIP8: best excess within 20 rows of a past event (at least 0), whether it moved, rows to the first 5 %."""
    from .. import calendar
    from ..operators import prices as ops

    by_day = ops.benchmark_by_day(base.benchmark(spark, d), calendar.dimension(spark))
    f = ops.daily_features(base.prices(spark, d)).select("code", "date", "close", "n").join(F.broadcast(by_day.select(F.col("b_date").alias("date"), "b_on")), "date")
    f = f.withColumn("state", F.struct("n", "close", "b_on"))
    cases = base.picks(spark, d).select("scenario_id", "code", F.col("first_date").alias("date"))
    cases = ops.as_of(cases, f, ["code"], value="state", into="c").where("c is not null").drop("date")
    steps = cases.select("scenario_id", "code", "c", F.explode(F.sequence(F.col("c.n") + 1, F.col("c.n") + 20)).alias("n"))
    hit = steps.join(f.select("code", "n", "close", "b_on"), ["code", "n"], "left")
    excess = (F.col("close") / F.col("c.close") - 1) - (F.col("b_on") / F.col("c.b_on") - 1)
    hit = hit.withColumn("excess", excess).withColumn("k", F.col("n") - F.col("c.n"))
    return hit.groupBy("scenario_id").agg(
        F.round(F.greatest(F.coalesce(F.max("excess"), F.lit(0.0)), F.lit(0.0)), 6).alias("max_excess"),
        F.coalesce(F.max("excess") >= ops.MOVE, F.lit(False)).alias("moved"), F.min(F.when(F.col("excess") >= ops.MOVE_BEGINS, F.col("k"))).alias("days_to_move"),
    )


@query("SELECT min(last) AS barrier, count(*) AS codes FROM (SELECT code, max(date) AS last FROM px GROUP BY code)", ("px",))
def freshness_barrier(spark, d):
    """AGG21: the earliest of the codes' last days."""
    return base.prices(spark, d).groupBy("code").agg(F.max("date").alias("last")).agg(F.min("last").alias("barrier"), F.count("*").alias("codes"))


@query(
    """SELECT user_id, event_id, signals FROM (
        SELECT user_id, event_id, signals, lag(signals) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM (
            SELECT *, array_to_string(list_filter([CASE WHEN value > 100 THEN 'a' END, CASE WHEN event_type = 'error' THEN 'b' END], lambda x: x IS NOT NULL), '|') AS signals FROM events))
    WHERE signals <> coalesce(before, '')"""
)
def signal_changes(spark, d):
    """STF7, STF8: a list of signals is emitted only where it differs from the last one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    signals = F.array_join(F.array_compact(F.array(F.when(F.col("value") > 100, "a"), F.when(F.col("event_type") == "error", "b"))), "|")
    e = base.read(spark, d, "events").withColumn("signals", signals).withColumn("before", F.coalesce(F.lag("signals").over(w), F.lit("")))
    return e.where("signals <> before").select("user_id", "event_id", "signals")


@query(
    """SELECT code, CAST(bool_or(f = 'supplier') AS BOOLEAN) AS is_supplier FROM (SELECT s_nationkey AS code, 'supplier' AS f FROM supplier UNION SELECT c_nationkey, 'customer' FROM customer WHERE c_acctbal > 5000) GROUP BY code"""
)
def code_union(spark, d):
    """SET3, SET6: union of two code sets, distinct."""
    s = base.read(spark, d, "supplier").select(F.col("s_nationkey").alias("code"), F.lit("supplier").alias("f"))
    c = base.read(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("code"), F.lit("customer").alias("f"))
    return s.union(c).distinct().groupBy("code").agg(F.bool_or(F.col("f") == "supplier").alias("is_supplier"))


@query("SELECT event_id, user_id AS source, substring(repeat(event_type || ' ', 120), 1, 500) AS message FROM events")
def fetch_log_rows(spark, d):
    """SNK6, VAL10: log rows with messages cut to 500 characters."""
    e = base.read(spark, d, "events")
    return e.select("event_id", F.col("user_id").alias("source"), F.substring(F.repeat(F.concat("event_type", F.lit(" ")), 120), 1, 500).alias("message"))


@query(
    """SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 4 = 1 END, coalesce(f.g, substring('SABC', CAST(o_orderkey % 4 + 1 AS INTEGER), 1)) IN ('S', 'A')) AS attention_high
    FROM orders LEFT JOIN (SELECT o_orderkey AS k, 'B' AS g FROM orders WHERE o_orderkey % 3 = 0) f ON f.k = o_orderkey"""
)
def attention_fallback(spark, d):
    """JN12: the gate's flag, else whether the final or else the provisional grade is S or A."""
    o, k = base.read(spark, d, "orders").select("o_orderkey"), F.col("o_orderkey")
    final = tables.latest_by(o.where("o_orderkey % 3 = 0").withColumn("g", F.lit("B")), ["o_orderkey"], [F.col("g")], ["g"])
    flag = F.when(k % 4 != 0, k % 4 == 1)
    grade = F.coalesce("g", F.substring(F.lit("SABC"), (k % 4 + 1).cast("int"), F.lit(1)))
    return o.join(final, "o_orderkey", "left").select("o_orderkey", F.coalesce(flag, grade.isin("S", "A")).alias("attention_high"))
