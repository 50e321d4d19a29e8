"""Parsers of feeds and listings: XML, JSON payloads, HTML listings, headlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

RSS_SCHEMA = "title string, link string, description string, summary string, pubDate string, updated string, source struct<_VALUE: string, _url: string>"
TIMELINE = "timeline array<struct<series: string, data: array<struct<date: string, value: string, norm: string>>>>"
PAGEVIEWS = "items array<struct<project: string, article: string, granularity: string, timestamp: string, access: string, agent: string, views: long>>"
FILINGS = "results array<struct<docID: string, secCode: string, filerName: string, docTypeCode: string, submitDateTime: string, docDescription: string>>"
# Kept filing types with their labels, page-view projects, the listing's base address.
FILING_TYPES = {"350": "大量保有報告書", "360": "変更報告書", "030": "有価証券報告書", "140": "臨時報告書"}
LISTING_BASE = "https://www.release.tdnet.info/inbs/"
PROJECTS = {"ja.wikipedia": "wiki_ja", "en.wikipedia": "wiki_en"}


def feed_time(c: Column) -> Column:
    """RFC 822 (the weekday is dropped) or ISO time; null where neither fits."""
    bare = F.regexp_replace(F.regexp_replace(c, r"^\s*[A-Za-z]{3},\s*", ""), r"\s+(GMT|UTC|Z)\s*$", " +0000")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(c))


def read_rss(spark: SparkSession, path: str, source_name: str, tier: int) -> DataFrame:
    """RSS items to news rows; entries without a link or title are dropped."""
    raw = spark.read.format("xml").option("rowTag", "item").schema(RSS_SCHEMA).load(path)
    rows = raw.where("link is not null and trim(link) <> '' and title is not null and trim(title) <> ''")
    title, summary = tx.normal_space(F.col("title")), tx.normal_space(F.coalesce("summary", "description", F.lit("")))
    return rows.select(
        tx.sha256(F.trim("link")).alias("news_id"), F.lit(source_name).alias("source"), title.alias("title"), summary.alias("summary"), F.trim("link").alias("url"),
        tx.sha256(F.concat(title, F.lit("\n"), summary)).alias("text_hash"), F.lit(tier).alias("source_tier"), feed_time(F.coalesce("pubDate", "updated")).alias("published_at"),
        F.coalesce(F.trim(F.col("source._VALUE")), tx.title_media(F.col("title"))).alias("media"),
    )


ATOM_SCHEMA = "title struct<_VALUE: string, _type: string>, link array<struct<_href: string, _rel: string>>, summary struct<_VALUE: string, _type: string>, content struct<_VALUE: string, _type: string>, published string, updated string"


def read_atom(spark: SparkSession, path: str, source_name: str, tier: int) -> DataFrame:
    """Atom entries to the news rows of read_rss: the link is the first alternate one (or of no relation), the summary falls back
    to the content, the time to the last update."""
    raw = spark.read.format("xml").option("rowTag", "entry").schema(ATOM_SCHEMA).load(path)
    own = F.filter("link", lambda x: x["_rel"].isNull() | (x["_rel"] == "alternate"))
    url = F.trim(F.get(own, 0)["_href"])
    rows = raw.withColumn("url", url).where("url is not null and url <> '' and title._VALUE is not null and trim(title._VALUE) <> ''")
    title, summary = tx.normal_space(F.col("title._VALUE")), tx.normal_space(F.coalesce("summary._VALUE", "content._VALUE", F.lit("")))
    return rows.select(
        tx.sha256(F.col("url")).alias("news_id"), F.lit(source_name).alias("source"), title.alias("title"), summary.alias("summary"), "url",
        tx.sha256(F.concat(title, F.lit("\n"), summary)).alias("text_hash"), F.lit(tier).alias("source_tier"), feed_time(F.coalesce("published", "updated")).alias("published_at"),
        tx.title_media(F.col("title._VALUE")).alias("media"),
    )


def article_counts(articles: DataFrame, keyword: str, day: str) -> DataFrame:
    """(key, source, date, value) of a keyword's articles (published_at in UTC, media) of one Japanese day: distinct outlets, and
    articles; one whose time isn't known counts as that day's."""
    own = F.to_date(F.from_utc_timestamp("published_at", "Asia/Tokyo"))
    rows = articles.where(F.col("published_at").isNull() | (own == F.lit(day).cast("date")))
    one = rows.agg(F.count_distinct(F.nullif("media", F.lit(""))).cast("double").alias("google_news_media"), F.count("*").cast("double").alias("google_news_articles"))
    told = one.select(F.lit(keyword).alias("key"), F.lit(day).cast("date").alias("date"), F.stack(F.lit(2), F.lit("google_news_media"), F.col("google_news_media"), F.lit("google_news_articles"), F.col("google_news_articles")).alias("source", "value"))
    return told.select("key", "source", "date", "value")


def listing_rows(df: DataFrame, html: str, pattern: str) -> DataFrame:
    """df with one row for each match of a two-group pattern: href, label (tags stripped), pos."""
    one = F.regexp_extract_all(F.col(html), F.lit(pattern), 1)
    two = F.regexp_extract_all(F.col(html), F.lit(pattern), 2)
    out = df.withColumn("__x", F.arrays_zip(one.alias("href"), two.alias("label")))
    out = out.select(*df.columns, F.posexplode("__x").alias("pos", "__m"))
    return out.select(*df.columns, F.col("__m.href").alias("href"), tx.strip_tags(F.col("__m.label")).alias("label"), "pos")


def disclosures(df: DataFrame, html: str, list_date: str) -> DataFrame:
    """df's other columns with one row for each listed disclosure: disclosure_id, code, company_name, title, url,
    published_at. Cells are told by the first name of their class; rows without a name or code are dropped; a time is
    Japanese on the list's day."""
    kept = [c for c in df.columns if c != html]
    rows = df.select(*kept, F.explode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), 1)).alias("__row"))
    cell = F.lit(r'(?is)<td\b[^>]*\bclass="\s*([^"\s]*)[^"]*"[^>]*>(.*?)</td>')
    rows = rows.withColumn("__cells", F.arrays_zip(F.regexp_extract_all("__row", cell, 1).alias("kind"), F.regexp_extract_all("__row", cell, 2).alias("body")))
    own = lambda kind, which: F.try_element_at(F.filter("__cells", lambda x: x["kind"] == kind)["body"], F.lit(which))
    rows = rows.select(*kept, *[tx.strip_tags(own(f"kj{n}", -1)).alias(f"__{n}") for n in ("Time", "Code", "Name", "Title")], own("kjTitle", 1).alias("__html"))
    anchor = r'(?is)<a\b[^>]*\bhref="([^"]+)"[^>]*>(.*?)</a>'
    href, label = F.trim(F.regexp_extract("__html", anchor, 1)), F.regexp_extract("__html", anchor, 2)
    url = F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(LISTING_BASE), F.ltrim(href, F.lit("/"))))
    clock = r"^(\d{1,2}):(\d{2})$"
    local = F.when(F.col("__Time").rlike(clock), F.make_timestamp(F.year(list_date), F.month(list_date), F.day(list_date), F.regexp_extract("__Time", clock, 1).cast("int"), F.regexp_extract("__Time", clock, 2).cast("int"), F.lit(0)))
    rows = rows.where("__Code is not null and __Name <> ''")
    return rows.select(
        *kept, tx.sha256(url).alias("disclosure_id"), F.nullif("__Code", F.lit("")).alias("code"), F.col("__Name").alias("company_name"),
        F.when(href != "", tx.strip_tags(label)).otherwise(F.coalesce("__Title", F.lit(""))).alias("title"), url.alias("url"), F.to_utc_timestamp(local, "Asia/Tokyo").alias("published_at"),
    )


def keyword_entries(df: DataFrame, title: str, outlet: str, keyword: str) -> DataFrame:
    """df's other columns with source, title, summary, source_tier and text_hash of entries of a keyword feed: the outlet
    is the entry's own, else what ends the headline, and it is taken off the headline."""
    media = F.coalesce(F.nullif(F.trim(outlet), F.lit("")), tx.title_media(F.col(title)), F.lit(""))
    rows = df.withColumn("__media", media).withColumn("__title", tx.title_without_media(F.col(title), F.col("__media")))
    kept = [c for c in df.columns if c not in (title, outlet, keyword)]
    return rows.select(
        *kept, F.concat(F.lit("google_news:"), keyword).alias("source"), F.col("__title").alias("title"), F.col("__media").alias("summary"),
        tx.outlet_tier(F.col("__media")).alias("source_tier"), tx.sha256(F.concat("__title", F.lit("\n"), "__media")).alias("text_hash"),
    )


def timeline(df: DataFrame, json: str) -> DataFrame:
    """(date, value) of every numeric point."""
    series = df.select(F.explode(F.from_json(json, TIMELINE)["timeline"]).alias("s"))
    points = series.select(F.explode("s.data").alias("p"))
    return points.select(F.to_date(F.substring("p.date", 1, 8), "yyyyMMdd").alias("date"), F.expr("try_cast(p.value as double)").alias("value")).where("value is not null")


def pageviews(df: DataFrame, json: str) -> DataFrame:
    """df's other columns with (source, key, date, value)."""
    kept = [c for c in df.columns if c != json]
    rows = df.select(*kept, F.explode(F.from_json(json, PAGEVIEWS)["items"]).alias("i")).where("i.views is not null and i.timestamp is not null")
    source = F.lit("wiki_en")
    for project, name in PROJECTS.items():
        source = F.when(F.col("i.project") == project, name).otherwise(source)
    return rows.select(*kept, source.alias("source"), F.col("i.article").alias("key"), F.to_date(F.substring("i.timestamp", 1, 8), "yyyyMMdd").alias("date"), F.col("i.views").cast("double").alias("value"))


def filings(df: DataFrame, json: str) -> DataFrame:
    """Filings of the kept types that have an id; the title falls back to the type's name."""
    rows = df.select(F.explode(F.from_json(json, FILINGS)["results"]).alias("r")).where(F.col("r.docID").isNotNull() & F.col("r.docTypeCode").isin(*FILING_TYPES))
    label = F.lit(None).cast("string")
    for code, name in FILING_TYPES.items():
        label = F.when(F.col("r.docTypeCode") == code, name).otherwise(label)
    local = F.try_to_timestamp("r.submitDateTime", F.lit("yyyy-MM-dd HH:mm"))
    return rows.select(F.col("r.docID").alias("doc_id"), tx.security_code(F.col("r.secCode")).alias("code"), F.col("r.filerName").alias("company_name"), F.coalesce("r.docDescription", label).alias("title"), F.col("r.docTypeCode").alias("doc_type"), F.to_utc_timestamp(local, "Asia/Tokyo").alias("published_at"))
