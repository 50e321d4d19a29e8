"""Masters from spreadsheets saved as CSV (listed companies, earnings dates), and the check of code and name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

# Headers of the published lists.
UNIVERSE_HEADERS = {"コード": "code", "銘柄名": "company_name", "市場・商品区分": "market", "33業種区分": "industry33"}
EARNINGS_HEADERS = {"コード": "code", "会社名": "company_name", "発表予定日": "earnings_date"}


def _renamed(df: DataFrame, headers: dict[str, str], required: list[str]) -> DataFrame:
    out = df.select(*[F.col(f"`{c}`").cast("string").alias(headers.get(c, c)) for c in df.columns])
    if missing := [c for c in required if c not in out.columns]:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")
    return out.withColumn("code", F.trim("code")).where("code <> '' and lower(code) <> 'nan'")


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A sheet saved as CSV with its header row, all columns as strings."""
    return spark.read.option("header", True).csv(path)


def universe(sheet: DataFrame, monitored: DataFrame | None = None) -> DataFrame:
    """(code, company_name, market, industry33, status) of listed companies; blank codes are dropped, a status is 通常
    unless `monitored` (code, status) says otherwise."""
    rows = _renamed(sheet, UNIVERSE_HEADERS, ["code", "company_name", "market", "industry33"])
    rows = rows.select("code", *[F.trim(c).alias(c) for c in ("company_name", "market", "industry33")])
    if monitored is None:
        return rows.withColumn("status", F.lit("通常"))
    return rows.join(monitored.select("code", "status"), "code", "left").withColumn("status", F.coalesce("status", F.lit("通常")))


def earnings(sheet: DataFrame) -> DataFrame:
    """(code, earnings_date); a blank or unreadable date is null."""
    rows = _renamed(sheet, EARNINGS_HEADERS, ["code", "earnings_date"])
    day = F.coalesce(*[F.to_date(F.try_to_timestamp("earnings_date", F.lit(f))) for f in ("yyyy-MM-dd", "yyyy/M/d", "yyyy-MM-dd HH:mm:ss")])
    return rows.select("code", day.alias("earnings_date"))


def master(universe_daily: DataFrame) -> DataFrame:
    """(code, master_name) of the latest day's universe."""
    from ..operators.tables import latest_snapshot

    return latest_snapshot(universe_daily, "date").select("code", F.col("company_name").alias("master_name"))


def reconcile(candidates: DataFrame, names: DataFrame, aliases: DataFrame, code: str = "code", name: str = "company_name") -> DataFrame:
    """candidates with master_name, ok and reason: the code must be known, and the name be the master's, hold it or be
    held by it (two characters at least), or be an alias (alias, code) of that code. Rejected rows stay, with why."""
    told = names.select(F.col("code").alias("__code"), "master_name", tx.company_name(F.col("master_name")).alias("__official"))
    known = aliases.select(tx.company_name(F.col("alias")).alias("__alias"), F.col("code").alias("__for")).distinct().withColumn("__is", F.lit(True))
    out = candidates.withColumn("__given", tx.company_name(F.col(name))).join(told, F.col(code) == F.col("__code"), "left")
    out = out.join(known, (F.col("__given") == F.col("__alias")) & (F.col(code) == F.col("__for")), "left")
    given, official = F.col("__given"), F.col("__official")
    fits = F.coalesce((F.length(given) >= 2) & ((given == official) | F.contains(official, given) | F.contains(given, official)), F.lit(False))
    reason = F.when(F.col("__code").isNull(), "unknown code").when(fits, "name fits").when(F.col("__is"), "alias").otherwise("name differs")
    return out.withColumns({"reason": reason, "ok": reason.isin("name fits", "alias")}).drop("__given", "__code", "__official", "__alias", "__for", "__is")
