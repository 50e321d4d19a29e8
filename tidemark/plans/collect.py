"""Collecting all sources: each by itself, with what came of it as a log row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "source string, ok boolean, items long, message string"


def collect(spark: SparkSession, jobs: dict[str, Callable[[SparkSession], DataFrame]], write: Callable[[str, DataFrame], None]) -> DataFrame:
    """Run every source's job (a name for each feed) and hand its rows to `write`; one that fails doesn't stop the others.
    Returns the log: source, ok, items, message (500 characters at most), fetched_at."""
    log = []
    for name, job in jobs.items():
        try:
            rows = job(spark).persist()
            write(name, rows)
            log.append((name, True, rows.count(), ""))
            rows.unpersist()
        except Exception as e:  # whatever a source throws is its own log row
            log.append((name, False, 0, f"{type(e).__name__}: {e}"[:500]))
    return spark.createDataFrame(log, LOG).withColumn("fetched_at", F.current_timestamp())


def append_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)
