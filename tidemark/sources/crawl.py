"""Paged listings by day as a Spark data source: a partition a day, page after page until an empty one.

How a page is got is exchangeable: the option `fetcher` names a function "package.module:name" of (day, page, options) that
returns the page's bytes, or raises Missing where there is no such page. `saved_pages` takes them from a folder, as they were
saved; one that asks a network can stand in its place. Days are fetched by tasks of their own, so a day that fails doesn't stop
the others: its row has the fault, and `log` makes log rows of them.

    spark.dataSource.register(PagedListing)
    spark.read.format("paged_listing").option("start", "2024-01-04").option("end", "2024-01-31") \
        .option("fetcher", "tidemark.sources.crawl:saved_pages").option("folder", folder).load()

Rows: day, page (from 1), body, error. A day's pages end at the first one whose body has no row (the option `row`, a pattern), or
that is missing, or at `max_pages`. A first page that can't be got is a fault of a business day, unless it is only missing; a
later one that can't be got is the end. Weekends and holidays without a page give no row.
"""

from __future__ import annotations

import importlib
import re
import time
from datetime import date, timedelta
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..calendar import is_business_day

MAX_PAGES = 30
ROW = r"(?i)<tr\b"
ENCODINGS = ("utf-8", "cp932")


class Missing(Exception):
    """There is no such page."""


def saved_pages(day: date, page: int, options: dict[str, str]) -> bytes:
    """A page saved as <folder>/<yyyymmdd>_<page>.html."""
    path = Path(options["folder"]) / f"{day:%Y%m%d}_{page}.html"
    if not path.exists():
        raise Missing(str(path))
    return path.read_bytes()


def decoded(body: bytes) -> str:
    """The text in the first encoding that fits; characters that fit none are replaced."""
    for encoding in ENCODINGS:
        try:
            return body.decode(encoding)
        except UnicodeDecodeError:
            pass
    return body.decode(ENCODINGS[0], errors="replace")


class PagedListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return "day date, page int, body string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Day(InputPartition):
    def __init__(self, day: date) -> None:
        super().__init__(day)
        self.day = day


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        first, last = (date.fromisoformat(self.options[k]) for k in ("start", "end"))
        return [_Day(first + timedelta(days=k)) for k in range((last - first).days + 1)]

    def read(self, partition: _Day):
        module, _, name = self.options["fetcher"].partition(":")
        fetch, day = getattr(importlib.import_module(module), name), partition.day
        pause, row = float(self.options.get("pause", 0)), re.compile(self.options.get("row", ROW))
        for page in range(1, int(self.options.get("max_pages", MAX_PAGES)) + 1):
            if page > 1:
                time.sleep(pause)
            try:
                body = decoded(fetch(day, page, self.options))
            except Missing:
                return
            except Exception as e:  # a fault of this day is a row of its own
                if page == 1 and is_business_day(day):
                    yield (day, page, None, f"{type(e).__name__}: {e}"[:500])
                return
            if not row.search(body):
                return
            yield (day, page, body, None)


def log(pages: DataFrame, source: str) -> DataFrame:
    """Log rows of a crawl (source, day, ok, items, message): a row for each day that gave pages or a fault."""
    return pages.groupBy("day").agg(
        F.lit(source).alias("source"), F.bool_and(F.col("error").isNull()).alias("ok"), F.count("body").alias("items"), F.coalesce(F.max("error"), F.lit("")).alias("message")
    )
