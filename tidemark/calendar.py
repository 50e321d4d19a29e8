"""Business-day dimension: one row a day with a running count of business days.

A business day is a weekday that is no Japanese public holiday and not 31 December to 3 January. With seq(d)
the number of business days up to d, the days between a and b are seq(b) - seq(a) in either order, and a
date plus n business days is the date whose seq is seq(d) + n.

The dimension holds FIRST to LAST, about 13,500 rows whatever the data: small enough to broadcast.
"""

from __future__ import annotations

from datetime import date, timedelta
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST, LAST = date(1994, 1, 1), date(2030, 12, 31)


def _nth_monday(year: int, month: int, n: int) -> date:
    first = date(year, month, 1)
    return first + timedelta(days=(7 - first.weekday()) % 7 + 7 * (n - 1))


def _equinox(year: int, spring: bool) -> date:
    base = 20.8431 if spring else 23.2488
    day = int(base + 0.242194 * (year - 1980) - (year - 1980) // 4)
    return date(year, 3 if spring else 9, day)


@cache
def holidays() -> frozenset[date]:
    """Public holidays from the rules of the holiday law as it stood in each year."""
    found: set[date] = set()
    for y in range(FIRST.year, LAST.year + 1):
        days = {date(y, 1, 1), date(y, 2, 11), date(y, 4, 29), date(y, 5, 3), date(y, 5, 5), date(y, 11, 3), date(y, 11, 23)}
        days.add(_nth_monday(y, 1, 2) if y >= 2000 else date(y, 1, 15))
        days |= {_equinox(y, True), _equinox(y, False)}
        if y >= 2007:
            days.add(date(y, 5, 4))
        if y <= 2018:
            days.add(date(y, 12, 23))
        if y >= 2020:
            days.add(date(y, 2, 23))
        if y not in (2020, 2021):
            if y >= 1996:
                days.add(_nth_monday(y, 7, 3) if y >= 2003 else date(y, 7, 20))
            days.add(_nth_monday(y, 10, 2) if y >= 2000 else date(y, 10, 10))
            if y >= 2016:
                days.add(date(y, 8, 11))
        days.add(_nth_monday(y, 9, 3) if y >= 2003 else date(y, 9, 15))
        days |= {2019: {date(2019, 5, 1), date(2019, 10, 22)}, 2020: {date(2020, 7, 23), date(2020, 7, 24), date(2020, 8, 10)}, 2021: {date(2021, 7, 22), date(2021, 7, 23), date(2021, 8, 8)}}.get(y, set())
        named = set(days)
        for d in sorted(named):  # a holiday on a Sunday moves the day off to the next day that is none
            if d.weekday() == 6:
                off = d + timedelta(days=1)
                while y >= 2007 and off in named:
                    off += timedelta(days=1)
                if off not in named:
                    days.add(off)
        for d in sorted(named):  # a day between two holidays is one
            mid = d + timedelta(days=1)
            if mid + timedelta(days=1) in named and mid not in named and mid.weekday() != 6:
                days.add(mid)
        found |= days
    return frozenset(found)


def is_business_day(d: date) -> bool:
    return d.weekday() < 5 and d not in holidays() and (d.month, d.day) not in ((12, 31), (1, 1), (1, 2), (1, 3))


def days_off() -> list[date]:
    """Weekdays that are no business days."""
    every = (FIRST + timedelta(days=i) for i in range((LAST - FIRST).days + 1))
    return [d for d in every if d.weekday() < 5 and not is_business_day(d)]


def dimension(spark: SparkSession) -> DataFrame:
    """(d, is_bd, bd_seq)."""
    rows, seq = [], 0
    for i in range((LAST - FIRST).days + 1):
        d = FIRST + timedelta(days=i)
        bd = is_business_day(d)
        seq += bd
        rows.append((d, bd, seq))
    return spark.createDataFrame(rows, "d date, is_bd boolean, bd_seq int").coalesce(1)


def with_seq(df: DataFrame, on: str, into: str, calendar: DataFrame) -> DataFrame:
    """df with the business-day count of a date column (null for null dates and dates outside the dimension)."""
    dim = calendar.select(F.col("d").alias(f"__{into}"), F.col("bd_seq").alias(into))
    return df.join(F.broadcast(dim), F.col(on) == F.col(f"__{into}"), "left").drop(f"__{into}")


def add_business_days(df: DataFrame, on: str, n: Column, into: str, calendar: DataFrame) -> DataFrame:
    """df with the date n business days from a date column; n = 0 leaves the date as it is."""
    start = calendar.select(F.col("d").alias("__d"), F.col("bd_seq").alias("__s"), F.col("is_bd").alias("__b"))
    days = calendar.where("is_bd").select(F.col("bd_seq").alias("__t"), F.col("d").alias("__to"))
    out = df.join(F.broadcast(start), F.col(on) == F.col("__d"), "left").withColumn("__n", n)
    target = F.col("__s") + F.col("__n") + F.when((F.col("__n") < 0) & ~F.col("__b"), 1).otherwise(0)
    out = out.withColumn("__k", target).join(F.broadcast(days), F.col("__k") == F.col("__t"), "left")
    return out.withColumn(into, F.when(F.col("__n") == 0, F.col(on)).otherwise(F.col("__to"))).drop("__d", "__s", "__b", "__n", "__k", "__t", "__to")
