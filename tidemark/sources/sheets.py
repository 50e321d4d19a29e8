"""Spreadsheets (.xlsx) as a Spark data source: a partition a file, its first sheet's rows as strings by header.

A workbook is a zip of XML. Of it are read the shared strings, which formats are dates, and the first sheet's cells. Values are as
a person sees them where that matters: whole numbers without a fraction, dates as yyyy-MM-dd (with the time where there is one),
truth values as TRUE and FALSE. Cells that aren't there are null, as are those of rows that end early; rows without any value
are dropped.

    spark.dataSource.register(Sheet)
    spark.read.format("sheet").load(path)      # a file, or a folder of them with one header

The columns are those of the first file's header row; a file whose header lacks one gives nulls there.
"""

from __future__ import annotations

import re
import zipfile
from datetime import datetime, timedelta
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the public format: its namespace, the built-in number formats that are dates, the first day of each calendar.
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
EPOCHS = {"0": datetime(1899, 12, 30), "1": datetime(1904, 1, 1)}


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    phonetic = {id(t) for p in root.iter(f"{_NS}rPh") for t in p.iter(f"{_NS}t")}  # readings aren't part of the text
    return ["".join(t.text or "" for t in si.iter(f"{_NS}t") if id(t) not in phonetic) for si in root.iter(f"{_NS}si")]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{_NS}numFmt")}
    shows = lambda n: n in DATE_FORMATS or re.search(r"[ymdh]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", own.get(n, "").lower())) is not None
    styles = root.find(f"{_NS}cellXfs")
    return {i for i, x in enumerate(styles if styles is not None else []) if shows(int(x.get("numFmtId", 0)))}


def _first_sheet(book: zipfile.ZipFile) -> str:
    names = [n for n in book.namelist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)]
    return min(names, key=lambda n: (int((re.findall(r"\d+", n) or [0])[-1]), n))


def rows_of(path: str) -> list[list[str | None]]:
    """All rows of a workbook's first sheet that have a value."""
    with zipfile.ZipFile(path) as book:
        strings, dates = _strings(book), _date_styles(book)
        workbook = ElementTree.fromstring(book.read("xl/workbook.xml"))
        pr = workbook.find(f"{_NS}workbookPr")
        epoch = EPOCHS["1" if pr is not None and pr.get("date1904") in ("1", "true") else "0"]
        out = []
        for row in ElementTree.fromstring(book.read(_first_sheet(book))).iter(f"{_NS}row"):
            cells: dict[int, str] = {}
            for k, c in enumerate(row.iter(f"{_NS}c")):
                value = _value(c, strings, dates, epoch)
                if value is not None and value != "":
                    cells[_column(c.get("r")) if c.get("r") else k] = value
            if cells:
                out.append([cells.get(k) for k in range(max(cells) + 1)])
        return out


def _value(c, strings: list[str], dates: set[int], epoch: datetime) -> str | None:
    kind, raw = c.get("t", "n"), c.findtext(f"{_NS}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_NS}t"))
    if raw is None:
        return None
    if kind == "s":
        return strings[int(raw)]
    if kind == "b":
        return "TRUE" if raw == "1" else "FALSE"
    if kind != "n":
        return raw
    number = float(raw)
    if int(c.get("s", 0)) in dates:
        told = epoch + timedelta(seconds=round(number * 86_400))
        return f"{told:%Y-%m-%d}" if number == int(number) else f"{told:%Y-%m-%d %H:%M:%S}"
    return str(int(number)) if number == int(number) else raw


def _files(path: str) -> list[str]:
    p = Path(path)
    return sorted(str(f) for f in p.glob("*.xlsx")) if p.is_dir() else [str(p)]


class Sheet(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sheet"

    def schema(self) -> T.StructType:
        files = _files(self.options["path"])
        rows = rows_of(files[0]) if files else []
        names = [n for n in (rows[0] if rows else []) if n]
        if len(set(names)) < len(names):
            raise ValueError(f"a header stands twice in {names}")
        return T.StructType([T.StructField(n, T.StringType()) for n in names])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema.names)


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str, names: list[str]) -> None:
        self.path, self.names = path, names

    def partitions(self) -> list[InputPartition]:
        return [_File(f) for f in _files(self.path)]

    def read(self, partition: _File):
        rows = rows_of(partition.path)
        if rows:
            at = {n: k for k, n in enumerate(rows[0]) if n}
            for row in rows[1:]:
                yield tuple(row[at[n]] if n in at and at[n] < len(row) else None for n in self.names)
