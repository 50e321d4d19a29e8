"""The eight sources as jobs of one collection, from a configuration.

Network access is left to whatever saves payloads; a job reads them by a path (a folder or pattern on any store Spark reads) or,
for the disclosure listings, by the paged crawl with a fetcher. Every job is a plan from payloads to rows; nothing is fetched or
parsed on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import crawl, feeds, masters

# Names of the sources, and those under which the log has them where they differ.
ALL = ("rss", "google_news", "tdnet", "edinet", "gdelt", "wikipedia", "universe", "calendar")
LOGGED = {"universe": "jpx_universe", "calendar": "earnings_schedule"}


def _payloads(spark: SparkSession, path: str) -> DataFrame:
    """(path, body): each payload file whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("body"))


def _stem(c: str = "file"):
    """The keyword of a file named by its percent-encoded keyword; file names in the metadata are encoded once more."""
    return F.url_decode(F.url_decode(F.regexp_replace(F.col(c), r"\.[^.]*$", "")))


def _feeds(config: dict) -> Callable[[SparkSession], DataFrame]:
    def job(spark: SparkSession) -> DataFrame:
        parts = []
        for feed in config["feeds"]:  # tens of feeds
            read = feeds.read_atom if feed.get("format") == "atom" else feeds.read_rss
            parts.append(read(spark, feed["path"], feed["name"], feed["tier"]))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.dropDuplicates(["news_id"])

    return job


def _keywords(config: dict) -> Callable[[SparkSession], DataFrame]:
    """Saved keyword feeds, a file each, named by its percent-encoded keyword."""

    def job(spark: SparkSession) -> DataFrame:
        raw = spark.read.format("xml").option("rowTag", "item").schema(feeds.RSS_SCHEMA).load(config["path"]).withColumn("file", F.col("_metadata.file_name"))
        rows = raw.where("link is not null and trim(link) <> '' and title is not null and trim(title) <> ''")
        rows = rows.select(F.trim("link").alias("url"), "title", F.col("source._VALUE").alias("outlet"), _stem().alias("keyword"), feeds.feed_time(F.col("pubDate")).alias("published_at"))
        return feeds.keyword_entries(rows, "title", "outlet", "keyword")

    return job


def _disclosures(config: dict) -> Callable[[SparkSession], DataFrame]:
    def job(spark: SparkSession) -> DataFrame:
        spark.dataSource.register(crawl.PagedListing)
        pages = spark.read.format(crawl.PagedListing.name()).options(**config).load()
        return feeds.disclosures(pages.where("error is null").select("day", "body"), "body", "day")

    return job


def _parsed(config: dict, parse: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession], DataFrame]:
    return lambda spark: parse(_payloads(spark, config["path"]))


def _attention(df: DataFrame) -> DataFrame:
    """Timelines, a file each, named by the percent-encoded keyword; points of one day are averaged."""
    points = df.select(_stem().alias("key"), F.explode(F.from_json("body", feeds.TIMELINE)["timeline"]).alias("s")).select("key", F.explode("s.data").alias("p"))
    points = points.select("key", F.to_date(F.substring("p.date", 1, 8), "yyyyMMdd").alias("date"), F.expr("try_cast(p.value as double)").alias("value")).where("value is not null")
    return points.groupBy("key", "date").agg(F.avg("value").alias("value")).withColumn("source", F.lit("gdelt"))


def jobs(config: dict, only: Iterable[str] | None = None) -> dict[str, Callable[[SparkSession], DataFrame]]:
    """name in the log -> job, in the order of ALL, of the sources that are asked for (all, if none are named) and configured.

    config: source -> its settings: rss {feeds: [{path, name, tier, format}]}, tdnet the options of the paged crawl, the others
    {path}. A name that isn't a source is an error; a source without settings has no job.
    """
    asked = set(ALL if only is None else only)
    if unknown := asked - set(ALL):
        raise ValueError(f"no such source: {', '.join(sorted(unknown))}")
    make = {
        "rss": _feeds, "google_news": _keywords, "tdnet": _disclosures,
        "edinet": lambda c: _parsed(c, lambda df: feeds.filings(df, "body")),
        "gdelt": lambda c: _parsed(c, _attention),
        "wikipedia": lambda c: _parsed(c, lambda df: feeds.pageviews(df.select("body"), "body")),
        "universe": lambda c: lambda spark: masters.universe(masters.read_sheet(spark, c["path"])),
        "calendar": lambda c: lambda spark: masters.earnings(masters.read_sheet(spark, c["path"])),
    }
    return {LOGGED.get(name, name): make[name](config[name]) for name in ALL if name in asked and name in config}
