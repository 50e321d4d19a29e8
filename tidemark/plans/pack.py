"""The day's pack: what passed the gate, with what it needs, as one JSON document a day."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


JAPAN = timezone(timedelta(hours=9))


def pack_window(day: date, now: datetime, previous: datetime | None = None) -> tuple[datetime, datetime]:
    """(start, end] of the items of a day's pack: from the previous pack, or the day's Japanese midnight, to now, or the
    day's end where that is earlier; a day yet to come is taken whole."""
    first = datetime(day.year, day.month, day.day, tzinfo=JAPAN)
    last = first + timedelta(days=1)
    return previous or first, last if now < first else min(now, last)


def day_packs(gated: DataFrame, urls: DataFrame, most_urls: int = 10) -> DataFrame:
    """(day, n_passed, pack, pack_hash): passed events by score with their first urls; the gate bounds how many
    pass, so a pack is small. The hash is the first 16 digits of the document's SHA-256."""
    passed = gated.where("passed").join(urls.groupBy("id").agg(F.slice(F.array_sort(F.collect_set("url")), 1, most_urls).alias("urls")), "id", "left")
    event = F.struct((-F.col("score")).alias("order"), "id", "title", "reason", "media_count", F.coalesce("urls", F.array().cast("array<string>")).alias("urls"))
    days = passed.groupBy("day").agg(F.sort_array(F.collect_list(event)).alias("events"))
    shown = F.transform("events", lambda e: F.struct(e["id"].alias("event_id"), e["title"].alias("title"), e["reason"].alias("reason"), e["media_count"].alias("media_count"), e["urls"].alias("urls")))
    out = days.select("day", F.size("events").alias("n_passed"), F.to_json(F.struct(F.date_format("day", "yyyy-MM-dd").alias("date"), shown.alias("events"))).alias("pack"))
    return out.withColumn("pack_hash", F.substring(F.sha2("pack", 256), 1, 16))


def write_pack(packs: DataFrame, path: str) -> None:
    """A pack that is there already stays as it is."""
    packs.write.mode("ignore").partitionBy("day").json(path)


def theme_states(themes: DataFrame, cards: DataFrame, temperatures: DataFrame, day: str) -> DataFrame:
    """themes (theme_id, name) with their latest card (version, market_premise) and temperature, by _seq; and whether the
    temperatures are due, which is one answer for all themes: none was ever taken, or the last is a week old."""
    card = cards.groupBy("theme_id").agg(F.max_by(F.struct("version", "market_premise"), "_seq").alias("card"))
    heat = temperatures.groupBy("theme_id").agg(F.max_by("temperature", "_seq").alias("temperature"))
    last = temperatures.agg(F.max("run_date").alias("__last"))  # one row
    due = F.col("__last").isNull() | (F.datediff(F.lit(day).cast("date"), "__last") >= 7)
    out = themes.join(card, "theme_id", "left").join(heat, "theme_id", "left").join(F.broadcast(last))
    return out.select("theme_id", "name", "card", "temperature", due.alias("due"))
