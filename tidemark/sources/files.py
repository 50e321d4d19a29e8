"""File sources: price CSVs, record logs, theme tables, past cases, aliases, the model's inbox."""

from __future__ import annotations

from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import row_json

ENVELOPE = "_seq long, _kind string, _recorded_at string, _prev_hash string, _hash string"
PRICES = "date date, open double, high double, low double, close double, volume double"
CASE_SCHEMA = "case_id string, title string, event_date date, theme_ids array<string>, time_type string, related array<struct<code: string, company_name: string, stage: int, viewpoint: string, why_related: string>>"


def read_prices(spark: SparkSession, folder: str, start: str, end: str) -> DataFrame:
    """One CSV a code to (code, date, ohlcv) in a closed range of dates; the code is the file's name."""
    raw = spark.read.schema(PRICES).option("header", True).option("pathGlobFilter", "*.csv").csv(folder)
    code = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1)
    return raw.select(code.alias("code"), "*").where(F.col("date").between(start, end))


def normalised(bars: DataFrame, start: str, end: str) -> DataFrame:
    """Bars with their six columns in any case, further ones dropped (but a code is kept): dates in a closed range, numbers as
    double. A missing column is an error that names it."""
    by = {c.lower(): c for c in bars.columns}
    wanted = [n.split()[0] for n in PRICES.split(", ")]
    if missing := [c for c in wanted if c not in by]:
        raise ValueError(f"columns {missing} are missing; there are {bars.columns}")
    date = F.to_date(bars[by["date"]])
    rows = bars.select(*([bars[by["code"]].alias("code")] if "code" in by else []), date.alias("date"), *[bars[by[c]].cast("double").alias(c) for c in wanted[1:]])
    return rows.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def price_reader(kind: str, folder: str):
    """The price source that a configuration names, as a function of (spark, start, end)."""
    known = {"csv_dir": lambda spark, start, end: read_prices(spark, folder, start, end)}
    if kind not in known:
        raise ValueError(f"no price source {kind!r}; there are {sorted(known)}")
    return known[kind]


def read_config(path: str, example: str) -> dict:
    """A YAML configuration, or the example where there is none; paths in it are relative to its folder."""
    import yaml

    own = Path(path) if Path(path).exists() else Path(example)
    config = yaml.safe_load(own.read_text(encoding="utf-8")) or {}
    return config | {"paths": {k: str((own.parent / v).resolve()) for k, v in (config.get("paths") or {}).items()}}


def read_inbox(spark: SparkSession, folder: str, pattern: str = "daily_*.json") -> DataFrame:
    """The inbox's newest document by file name, one row: name, text (without a byte-order mark), source_hash, error (null
    where the text is JSON)."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).text(folder)
    newest = files.select(F.col("_metadata.file_name").alias("name"), F.regexp_replace("value", "^\\x{FEFF}", "").alias("text")).agg(F.max_by(F.struct("name", "text"), "name").alias("d"))
    rows = newest.where("d is not null").select("d.*")
    return rows.withColumns({"source_hash": F.sha2("text", 256), "error": F.when(F.try_parse_json("text").isNull(), "not JSON")})


def read_records(spark: SparkSession, path: str, payload: str) -> DataFrame:
    """One kind of append-only JSON lines, with its envelope; order by _seq. Blank lines are skipped; a line that is no JSON
    (the tail of a write that was cut off, say) isn't mended or dropped: reading stops with the file's name and the line."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value").where(F.trim("value") != "")
    schema = T._parse_datatype_string(f"{ENVELOPE}, {payload}, __broken string")
    rows = lines.select("file", "value", F.from_json("value", schema, {"columnNameOfCorruptRecord": "__broken"}).alias("r"))
    said = F.concat(F.lit("record log "), F.col("file"), F.lit(" has a broken line: "), F.substring("value", 1, 80))
    whole = F.when(F.col("r.__broken").isNotNull(), F.raise_error(said)).otherwise(F.col("r"))
    return rows.select(whole.alias("r")).select(*[f"r.{f}" for f in schema.names if f != "__broken"])


def append_records(rows: DataFrame, path: str) -> None:
    """Append rows (with their envelope) to a log as canonical JSON lines, keys sorted, a file for each task, its lines by _seq."""
    rows.sortWithinPartitions("_seq").select(row_json(rows.schema, rows.columns).alias("value")).write.mode("append").text(path)


def read_themes(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a Markdown table whose first cell is a theme id: theme_id, name."""
    pattern = r"^\|\s*([PFMGE]\d{2})\s*\|\s*([^|]*)\|"
    rows = spark.read.text(path).where(F.col("value").rlike(pattern))
    return rows.select(F.regexp_extract("value", pattern, 1).alias("theme_id"), F.trim(F.regexp_replace(F.trim(F.regexp_extract("value", pattern, 2)), r"^\*+|\*+$", "")).alias("name"))


def read_past_cases(spark: SparkSession, folder: str) -> DataFrame:
    """YAML files of a curated library (tens of files, read by the driver) in order of their names."""
    import yaml

    rows = []
    for f in sorted(Path(folder).glob("*.yaml")):
        c = yaml.safe_load(f.read_text(encoding="utf-8"))
        related = [(str(r.get("code")), r.get("company_name"), r.get("stage"), r.get("viewpoint"), r.get("why_related")) for r in c.get("related") or []]
        rows.append((c["case_id"], c.get("title"), c.get("event_date"), c.get("theme_ids"), c.get("time_type"), related))
    return spark.createDataFrame(rows, CASE_SCHEMA)


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(alias, code) of a small YAML map."""
    import yaml

    return spark.createDataFrame([(str(k), str(v)) for k, v in (yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}).items()], "alias string, code string")


def decode_bytes(files: DataFrame, content: str = "content", into: str = "text") -> DataFrame:
    """Bytes of listings as text: UTF-8 if they are, else the Windows code page for Japanese."""
    def one(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        for code in ("utf-8", "cp932"):
            try:
                return raw.decode(code)
            except UnicodeDecodeError:
                pass
        return raw.decode("cp932", "replace")

    @F.pandas_udf("string")
    def decode(c: pd.Series) -> pd.Series:
        return c.map(one)

    return files.withColumn(into, decode(content))


def previous_watermark(packs: DataFrame, day: str) -> DataFrame:
    """One row: when the newest pack before a day was generated."""
    return packs.where(F.col("day") < day).agg(F.max_by("generated_at", "day").alias("generated_at"))
