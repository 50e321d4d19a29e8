"""Relational basics: latest rows, the flavours of upsert as set operations, hash chains, failure runs.

Parquet tables have no MERGE; an upsert is a union with what is there and one aggregation by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_snapshot(df: DataFrame, on: str) -> DataFrame:
    """Rows of the last value of a column."""
    last = df.agg(F.max(on).alias("__last"))  # one row
    return df.join(F.broadcast(last), F.col(on) == F.col("__last"), "left_semi")


def latest_by(df: DataFrame, keys: list[str], order: list[Column], values: list[str]) -> DataFrame:
    """The last row of each key; combined before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("__v")).select(*keys, "__v.*")


def insert_new(existing: DataFrame, new: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Rows to append: keys that aren't there yet, the first of each key by order."""
    others = [c for c in new.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("__v")).select(*keys, "__v.*")
    return first.select(*new.columns).join(existing.select(*keys), keys, "left_anti")


def upsert_keep_first(existing: DataFrame, new: DataFrame, keys: list[str], updated: list[str], kept: list[str], order: list[str] | None = None) -> DataFrame:
    """All rows after an upsert that takes new values of `updated` but keeps first values of `kept`. Of rows of one key
    within a batch the last (first) by `order` is taken, whole; by itself the order is that of all other columns."""
    both = existing.withColumn("__s", F.lit(0)).unionByName(new.withColumn("__s", F.lit(1)))
    place = F.struct("__s", *(order or [*updated, *kept]))
    rows = both.groupBy(*keys).agg(F.max_by(F.struct(*updated), place).alias("__u"), F.min_by(F.struct(*kept), place).alias("__f"))
    return rows.select(*keys, "__u.*", "__f.*")


def replace_rows(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """All rows after an upsert in which the new row wins whole; of several, the last by `order`, or by all columns."""
    others = [c for c in existing.columns if c not in keys]
    both = existing.withColumn("__s", F.lit(0)).unionByName(new.withColumn("__s", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct("__s", *(order or others))).alias("__v")).select(*keys, "__v.*")


def partial_upsert(existing: DataFrame, new: DataFrame, keys: list[str], updated: list[str]) -> DataFrame:
    """All rows after an upsert of some columns; a null in the new row does overwrite."""
    n = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in updated]).withColumn("__there", F.lit(True))
    out = existing.join(n, keys, "full_outer")
    for c in updated:
        out = out.withColumn(c, F.when(F.col("__there"), F.col(f"__{c}")).otherwise(F.col(c)))
    return out.select(*existing.columns)


def consecutive_failures(log: DataFrame, source: str, at: list[Column], ok: str, n: int = 3) -> DataFrame:
    """Sources whose last n entries all failed."""
    w = Window.partitionBy(source).orderBy(*at)
    last = log.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
    return last.groupBy(source).agg(F.count("*").alias("__n"), F.bool_and(~F.col(ok)).alias("__f")).where((F.col("__n") == n) & F.col("__f")).select(source)


def chain_breaks(rows: DataFrame, chain: str, seq: str, prev: str, own: str) -> DataFrame:
    """Rows of a hash chain whose predecessor's hash or number doesn't fit."""
    w = Window.partitionBy(chain).orderBy(seq)
    told = rows.withColumn("__prev", F.coalesce(F.lag(own).over(w), F.lit("0" * 64))).withColumn("__n", F.row_number().over(w))
    return told.where((F.col("__prev") != F.col(prev)) | (F.col("__n") != F.col(seq))).drop("__prev", "__n")


def _parts(df: DataFrame, text: str, lengths: DataFrame, into: str, proper: bool = False) -> DataFrame:
    """df with a row for each distinct part of a text that has one of the lengths (one row, `lengths`)."""
    size = F.length(text)
    fits = F.filter("lengths", lambda n: n < size if proper else n <= size)
    parts = F.transform(fits, lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(F.col(text), i, n)))
    return df.join(F.broadcast(lengths)).withColumn(into, F.explode(F.array_distinct(F.flatten(parts)))).drop("lengths")


def containment_pairs(left: DataFrame, right: DataFrame, by: tuple[str, str], texts: tuple[str, str]) -> DataFrame:
    """Pairs of rows with equal `by` of which either text holds the other, by equality: a text is cut into its parts of the lengths
    that the other side has (one row of lengths), and parts meet whole texts. So a pair that doesn't fit is never formed, and
    a key with many rows isn't one task. Texts are names: their parts are some dozens."""
    (k, j), (a, b) = by, texts
    lengths = lambda df, c: df.agg(F.collect_set(F.length(c)).alias("lengths"))
    holds = _parts(left, a, lengths(right, b), "__part").join(right, (F.col(k) == F.col(j)) & (F.col("__part") == F.col(b)))
    held = _parts(right, b, lengths(left, a), "__part", proper=True).join(left, (F.col(k) == F.col(j)) & (F.col("__part") == F.col(a)))
    return holds.drop("__part").unionByName(held.drop("__part"))
