"""Queries over listings, keyword feeds and masters, with payloads that are built from the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import feeds, masters
from . import base
from .base import query


@query(
    """SELECT s_suppkey, sha256('https://www.release.tdnet.info/inbs/' || s_suppkey || '.pdf') AS disclosure_id, CAST(10000 + s_suppkey AS VARCHAR) AS code, s_name AS company_name,
        'Notice of ' || s_name AS title, 'https://www.release.tdnet.info/inbs/' || s_suppkey || '.pdf' AS url,
        CASE WHEN s_suppkey % 5 <> 0 THEN TIMESTAMP '2024-01-03 00:00:00' + INTERVAL 1 HOUR * (s_suppkey % 24) + INTERVAL 1 MINUTE * (s_suppkey % 60) END AS published_at
    FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0"""
)
def disclosure_listing(spark, d):
    """SRC3: rows of a listing by cell class, with absolute URLs and times on the list's day; rows without a name or code
    cell are dropped."""
    s, k = base.read(spark, d, "supplier"), F.col("s_suppkey")
    cell = lambda kind, body: F.concat(F.lit(f'<td nowrap class="{kind} oddnew">'), body, F.lit("</td>"))
    local = F.expr("timestamp_ntz'2024-01-03 09:00:00' + make_dt_interval(0, cast(s_suppkey % 24 as int), cast(s_suppkey % 60 as int))")
    time = F.when(k % 5 == 0, "").otherwise(F.date_format(local, "HH:mm"))
    link = F.concat(F.lit('<a href="'), F.when(k % 2 == 0, F.lit("https://www.release.tdnet.info/inbs/")).otherwise(F.lit("/")), k.cast("string"), F.lit('.pdf" target="_blank"><b>Notice of</b>&nbsp;'), F.col("s_name"), F.lit("</a>"))
    day = F.to_date(F.when(k % 5 == 0, F.lit(None)).otherwise(local))
    name = F.when(k % 7 == 0, "").otherwise(cell("kjName", F.concat(F.lit(" "), F.col("s_name"))))
    code = F.when(k % 11 == 0, "").otherwise(cell("kjCode", (10000 + k).cast("string")))
    page = s.select("s_suppkey", day.alias("day"), F.concat(F.lit("<table><TR>"), cell("kjTime", time), code, name, cell("kjTitle", link), F.lit("</TR></table>")).alias("html"))
    return feeds.disclosures(page, "html", "day").select("s_suppkey", "disclosure_id", "code", "company_name", "title", "url", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


_OUTLETS = ["NHK", "Reuters", "Example Post", ""]


@query(
    """SELECT o_orderkey, 'google_news:' || o_orderpriority AS source, 'Order ' || o_orderkey AS title, media AS summary, CASE WHEN media IN ('NHK', 'Reuters') THEN 2 ELSE 3 END AS source_tier,
        sha256('Order ' || o_orderkey || chr(10) || media) AS text_hash
    FROM (SELECT *, ['NHK', 'Reuters', 'Example Post', ''][o_orderkey % 4 + 1] AS media FROM orders)"""
)
def keyword_feed(spark, d):
    """SRC2, SC7: entries of a keyword feed with outlet, headline without it, tier and label."""
    k = F.col("o_orderkey")
    media = F.element_at(F.array(*map(F.lit, _OUTLETS)), (k % 4 + 1).cast("int"))
    title = F.concat(F.lit("Order  "), k.cast("string"), F.when(media != "", F.concat(F.lit(" - "), media)).otherwise(""))
    entries = base.read(spark, d, "orders").select("o_orderkey", title.alias("title"), F.when(k % 3 == 0, F.concat(F.lit(" "), media)).alias("outlet"), F.col("o_orderpriority").alias("keyword"))
    return feeds.keyword_entries(entries, "title", "outlet", "keyword").select("o_orderkey", "source", "title", "summary", "source_tier", "text_hash")


def _sheet(spark, d):
    k = F.col("s_suppkey")
    code = F.when(k % 11 == 0, " ").when(k % 13 == 0, "nan").otherwise(F.concat(F.lit(" "), (1000 + k).cast("string")))
    return base.read(spark, d, "supplier").select(code.alias("コード"), F.concat("s_name", F.lit(" ")).alias("銘柄名"), F.lit("プライム").alias("市場・商品区分"), F.col("s_nationkey").alias("33業種区分"), F.lit("x").alias("規模"))


@query(
    """SELECT CAST(1000 + s_suppkey AS VARCHAR) AS code, s_name AS company_name, 'プライム' AS market, CAST(s_nationkey AS VARCHAR) AS industry33, CASE WHEN s_suppkey % 17 = 0 THEN '監理' ELSE '通常' END AS status
    FROM supplier WHERE s_suppkey % 11 <> 0 AND s_suppkey % 13 <> 0"""
)
def universe_rows(spark, d):
    """SRC11, SRC13: listed companies by header, blank codes dropped, statuses from the monitoring list."""
    posts = base.read(spark, d, "supplier").where("s_suppkey % 17 = 0").select((1000 + F.col("s_suppkey")).cast("string").alias("code"), F.lit("監理").alias("status"))
    return masters.universe(_sheet(spark, d), posts)


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS code, CASE WHEN o_orderkey % 5 > 1 THEN CAST(o_orderdate AS DATE) END AS earnings_date FROM orders WHERE o_orderkey % 19 <> 0"""
)
def earnings_rows(spark, d):
    """SRC12: earnings dates by header; blank and unreadable ones are null."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    text = F.when(k % 5 == 0, "").when(k % 5 == 1, "undecided").when(k % 5 == 2, F.date_format(day, "yyyy/M/d")).when(k % 5 == 3, F.date_format(day, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    sheet = base.read(spark, d, "orders").select(F.when(k % 19 == 0, "").otherwise(k.cast("string")).alias("コード"), F.lit("").alias("会社名"), text.alias("発表予定日"))
    return masters.earnings(sheet)


@query(
    """SELECT c_custkey, code, CASE WHEN s_name IS NULL THEN 'unknown code' WHEN length(given) >= 2 AND (contains(official, given) OR contains(given, official)) THEN 'name fits'
            WHEN given = 'nick' || code THEN 'alias' ELSE 'name differs' END AS reason, s_name AS master_name
    FROM (SELECT c_custkey, code, s_name, lower(s_name) AS official, lower(CASE c_custkey % 5 WHEN 0 THEN 'Supplier' WHEN 1 THEN s_name || 'Group' WHEN 2 THEN 'Nick' || code WHEN 3 THEN 'S' ELSE c_name END) AS given
        FROM (SELECT *, c_custkey % 120 + 1 AS code FROM customer) LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 9 <> 0) ON s_suppkey = code)"""
)
def company_check(spark, d):
    """JN18, SRC23, VAL3, VAL7, SC4: code and name against the latest master: equal or one inside the other once normal, else
    an alias of the code; rejected rows stay with the reason."""
    k, code = F.col("c_custkey"), F.col("c_custkey") % 120 + 1
    s = base.read(spark, d, "supplier")
    daily = s.where("s_suppkey % 9 <> 0").select("s_suppkey", "s_name", F.explode(F.array(*[F.lit(x).cast("date") for x in ("2024-01-04", "2024-01-05")])).alias("date"))
    daily = daily.unionByName(s.where("s_suppkey % 9 = 0").select("s_suppkey", "s_name", F.lit("2024-01-04").cast("date").alias("date")))
    names = masters.master(daily.select("date", F.col("s_suppkey").alias("code"), F.concat(F.lit("株式会社"), "s_name").alias("company_name")))
    aliases = spark.range(1, 121).select(F.concat(F.lit("ＮＩＣＫ・"), F.col("id").cast("string")).alias("alias"), F.col("id").alias("code"))
    c = base.read(spark, d, "customer").join(s.select(F.col("s_suppkey").alias("code"), "s_name"), code == F.col("code"), "left")
    given = F.when(k % 5 == 0, "㈱ Supplier").when(k % 5 == 1, F.concat("s_name", F.lit(" Group"))).when(k % 5 == 2, F.concat(F.lit("Nick_"), code.cast("string"))).when(k % 5 == 3, "S").otherwise(F.col("c_name"))
    out = masters.reconcile(c.select("c_custkey", code.alias("code"), given.alias("company_name")), names, aliases)
    return out.select("c_custkey", "code", "reason", F.regexp_replace("master_name", "^株式会社", "").alias("master_name"))
