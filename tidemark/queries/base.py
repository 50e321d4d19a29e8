"""Registry of queries and the adapters that read the shared tables as the engine's inputs.

An adapter is a projection or one aggregation, written once as a DataFrame and once as SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..calendar import days_off
from ..shared import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, needs: tuple[str, ...] = ()):
    """Register a function of (spark, sf_dir) under its name, with SQL that gives the same rows; `needs`
    names adapters whose common table expressions go before the SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = "WITH " + ",\n".join(CTE[n] for n in needs) + "\n" + sql if needs else sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(rows: DataFrame, *by: str) -> DataFrame:
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    out = rows.groupBy(*by).agg(money("l_extendedprice").alias("paid"), money("l_quantity").alias("volume"))
    return out.select(*by, (F.col("paid") / F.col("volume")).alias("close"), "volume")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, date, close, volume): lineitem by the supplier's nation and ship date."""
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("date"), "l_extendedprice", "l_quantity")
    code = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("code"))
    return _bars(lines.join(code, F.col("l_suppkey") == F.col("s_suppkey")), "code", "date")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, close): all of lineitem by ship date."""
    lines = read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date"), "l_extendedprice", "l_quantity")
    return _bars(lines, "date").select("date", "close")


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scenario_id, code, first_date, expected_days, median, prob, status): orders by the customer's nation."""
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    joined = orders.join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    return joined.select(
        key.alias("scenario_id"), F.col("c_nationkey").alias("code"), F.to_date("o_orderdate").alias("first_date"),
        (key % 26 + 3).cast("int").alias("expected_days"), ((key % 20 + 1) / F.lit(100.0)).alias("median"),
        ((key % 90 + 5) / F.lit(100.0)).alias("prob"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, title, kind, source, ts, code): documents as items, whole texts as titles; disclosures have a code."""
    i = F.col("doc_id")
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(
        i.alias("id"), F.coalesce("text", F.lit("")).alias("title"), F.when(i % 7 == 0, (i % 97).cast("string")).alias("code"),
        F.when(i % 7 == 0, "disclosure").otherwise("news").alias("kind"), "source",
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, doc_id * 7)").alias("ts"),
    )


def attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, source, date, value): daily counts of a user's events of one type."""
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("key"), F.col("event_type").alias("source"), F.to_date("ts").alias("date")).agg(F.count("*").cast("double").alias("value"))


_money = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)".format
_bar = f"{_money('l_extendedprice')} / {_money('l_quantity')} AS close"
_off = ", ".join(f"(DATE '{d}')" for d in days_off())
CTE = {
    "px": f"px AS (SELECT s_nationkey AS code, CAST(l_shipdate AS DATE) AS date, {_bar}, {_money('l_quantity')} AS volume FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)",
    "idx": f"idx AS (SELECT CAST(l_shipdate AS DATE) AS date, {_bar} FROM lineitem GROUP BY 1)",
    "cal": f"""days_off AS (SELECT * FROM (VALUES {_off}) v(d)),
        cal AS (SELECT d, is_bd, CAST(sum(CASE WHEN is_bd THEN 1 ELSE 0 END) OVER (ORDER BY d) AS INTEGER) AS bd_seq FROM (
            SELECT d, dayofweek(d) NOT IN (0, 6) AND d NOT IN (SELECT d FROM days_off) AS is_bd
            FROM (SELECT CAST(unnest(generate_series(DATE '1994-01-01', DATE '2030-12-31', INTERVAL 1 DAY)) AS DATE) AS d)))""",
    "bday": """bday AS (SELECT d AS b_date, lag(b_on) OVER (ORDER BY d) AS b_before, b_on FROM (
            SELECT d, last_value(close IGNORE NULLS) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) AS b_on FROM cal LEFT JOIN idx ON d = date))""",
    "feat": """feat AS (SELECT *, CASE WHEN n >= 3 THEN stddev_samp(ret) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS vol,
            CASE WHEN n >= 4 THEN stddev_samp(ret) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS prior_vol,
            avg(close * volume) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS turnover,
            close / lag(close, 20) OVER (PARTITION BY code ORDER BY date) - 1 AS ret_k
        FROM (SELECT *, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS ret, row_number() OVER (PARTITION BY code ORDER BY date) AS n FROM px))""",
    "sig": """sig AS (SELECT *, CASE WHEN prior_vol IS NULL THEN NULL WHEN prior_vol = 0 THEN CASE WHEN excess <> 0 THEN CAST('Infinity' AS DOUBLE) WHEN excess = 0 THEN 0 END ELSE excess / prior_vol END AS sigma
        FROM (SELECT feat.*, ret - (b_on / b_before - 1) AS excess FROM feat LEFT JOIN bday ON date = b_date))""",
    "picks": """picks AS (SELECT o_orderkey AS scenario_id, c_nationkey AS code, CAST(o_orderdate AS DATE) AS first_date, CAST(o_orderkey % 26 + 3 AS INTEGER) AS expected_days,
            (o_orderkey % 20 + 1) / 100.0::DOUBLE AS median, (o_orderkey % 90 + 5) / 100.0::DOUBLE AS prob, o_orderstatus AS status, o_orderpriority AS priority
        FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "items": """items AS (SELECT doc_id AS id, coalesce(text, '') AS title, CASE WHEN doc_id % 7 = 0 THEN CAST(doc_id % 97 AS VARCHAR) END AS code, CASE WHEN doc_id % 7 = 0 THEN 'disclosure' ELSE 'news' END AS kind, source,
            TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 7 MINUTE * doc_id AS ts FROM documents)""",
    "attn": "attn AS (SELECT user_id AS key, event_type AS source, CAST(ts AS DATE) AS date, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1, 2, 3)",
    "moved": """spans AS (SELECT p.scenario_id, p.code, p.first_date, p.expected_days, s.bd_seq AS seq, e.d AS end_date, n.d AS start
            FROM picks p JOIN cal s ON s.d = p.first_date JOIN cal e ON e.is_bd AND e.bd_seq = s.bd_seq + least(p.expected_days, 20) JOIN cal n ON n.is_bd AND n.bd_seq = s.bd_seq + 1),
        based AS (SELECT spans.*, px.close AS base, b_before AS b0 FROM spans ASOF LEFT JOIN px ON spans.code = px.code AND px.date < spans.start LEFT JOIN bday ON b_date = spans.start),
        hits AS (SELECT b.scenario_id, b.code, px.date AS day, (px.close / b.base - 1) - (bday.b_on / b.b0 - 1) AS excess
            FROM based b JOIN px ON px.code = b.code AND px.date > b.first_date AND px.date <= b.end_date JOIN bday ON bday.b_date = px.date),
        seen AS (SELECT scenario_id, code, greatest(max(excess), 0.0) AS max_excess, min(CASE WHEN excess >= 0.05 THEN day END) AS moved_at, bool_or(excess >= 0.10) AS moved FROM hits GROUP BY 1, 2),
        moves AS (SELECT p.scenario_id, p.code, p.first_date, p.expected_days, coalesce(max_excess, 0.0) AS max_excess, moved_at, coalesce(moved, false) AS moved, m.bd_seq - f.bd_seq AS days_to_move
            FROM picks p LEFT JOIN seen USING (scenario_id, code) LEFT JOIN cal f ON f.d = p.first_date LEFT JOIN cal m ON m.d = moved_at)""",
}
