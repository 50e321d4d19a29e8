"""The crawl of paged listings over saved pages, and spreadsheets against the same rows as CSV."""

import zipfile
from datetime import date

from pyspark.sql import functions as F

from tidemark.sources import crawl, feeds, masters, sheets


def refusing(day, page, options):
    """Saved pages; one day's server is down, one fails from its second page on."""
    if day == date(2024, 1, 9):
        raise ConnectionError("refused")
    if day == date(2024, 1, 10) and page == 2:
        raise TimeoutError("late")
    return crawl.saved_pages(day, page, options)


def page(*rows):
    cells = lambda k, t: f'<tr><td class="x kjTime">{k}</td><td class="kjCode">1301{k[-1]}</td><td class="kjName">甲</td><td class="kjTitle"><a href="{t}.pdf">{t}</a></td></tr>'
    return f"<table>{''.join(cells(*r) for r in rows)}</table>".replace('class="x kjTime"', 'class="kjTime x"')


def listing(spark, folder, **options):
    spark.dataSource.register(crawl.PagedListing)
    reader = spark.read.format("paged_listing").option("folder", str(folder)).option("fetcher", "tests.test_datasources:refusing")
    for k, v in ({"start": "2024-01-04", "end": "2024-01-10"} | options).items():
        reader = reader.option(k, v)
    return reader.load()


def test_pages_of_days_until_an_empty_one(spark, tmp_path):
    saved = {
        "20240104_1": page(("9:00", "a"), ("9:10", "b")).encode(), "20240104_2": page(("9:20", "c")).encode("cp932"), "20240104_3": b"<table></table>", "20240104_4": page(("9:30", "never")).encode(),
        "20240105_1": b"<p>nothing today</p>", "20240110_1": page(("15:00", "d")).encode(), "20240110_3": page(("15:00", "never")).encode(),
    }
    for name, body in saved.items():
        (tmp_path / f"{name}.html").write_bytes(body)
    pages = listing(spark, tmp_path)
    assert pages.rdd.getNumPartitions() == 7  # a day each
    got = sorted((str(r["day"]), r["page"], r["body"] is not None, r["error"]) for r in pages.collect())
    assert got == [("2024-01-04", 1, True, None), ("2024-01-04", 2, True, None), ("2024-01-09", 1, False, "ConnectionError: refused"), ("2024-01-10", 1, True, None)]
    rows = feeds.disclosures(pages.where("body is not null"), "body", "day")
    assert sorted((str(r["day"]), r["title"], r["company_name"]) for r in rows.collect()) == [("2024-01-04", "a", "甲"), ("2024-01-04", "b", "甲"), ("2024-01-04", "c", "甲"), ("2024-01-10", "d", "甲")]
    told = sorted((str(r["day"]), r["source"], r["ok"], r["items"], r["message"]) for r in crawl.log(pages, "listing").collect())
    assert told == [("2024-01-04", "listing", True, 2, ""), ("2024-01-09", "listing", False, 0, "ConnectionError: refused"), ("2024-01-10", "listing", True, 1, "")]
    assert listing(spark, tmp_path, max_pages="1").count() == 3
    assert [r["day"] for r in listing(spark, tmp_path, start="2024-01-06", end="2024-01-08").collect()] == []  # a weekend and a holiday


NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(path, rows, shared, early=False):
    """A workbook of rows whose cells are (kind, value, style); kinds: s (shared), i (inline), n, b."""
    def cell(k, r, c):
        if c is None:
            return ""
        kind, value, style = c
        body = f"<is><t>{value}</t></is>" if kind == "i" else f"<v>{shared.index(value) if kind == 's' else value}</v>"
        return f'<c r="{chr(65 + k)}{r}" t="{ {"i": "inlineStr"}.get(kind, kind)}" s="{style}">{body}</c>'

    sheet = "".join(f'<row r="{r}">{"".join(cell(k, r, c) for k, c in enumerate(row))}</row>' for r, row in enumerate(rows, 1))
    strings = "".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r><rPh><t>よみ</t></rPh></si>" for s in shared)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS}><workbookPr date1904="{int(early)}"/></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{strings}</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><numFmts><numFmt numFmtId="170" formatCode="yyyy&quot;年&quot;m"/><numFmt numFmtId="171" formatCode="0.0&quot;day&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {NS}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {NS}><sheetData>{sheet}</sheetData></worksheet>")


def test_sheets_give_the_rows_of_the_same_csv(spark, tmp_path):
    head = ["コード", "銘柄名", "市場・商品区分", "33業種区分", "日付"]
    names = [*head, "極洋", "プライム", "水産・農林業", "130A", "ベリタス", "グロース"]
    rows = [
        [("s", h, 0) for h in head],
        [("n", "1301", 0), ("s", "極洋", 0), ("s", "プライム", 0), ("s", "水産・農林業", 0), ("n", "45296", 1)],
        [None, None, None, None, None],
        [("s", "130A", 0), ("i", "ベリタス", 0), ("s", "グロース", 0), None, ("n", "45297.5", 2)],
        [None, ("s", "極洋", 0)],
        [("n", "2.5", 3), ("b", "1", 0), ("b", "0", 0)],
    ]
    workbook(tmp_path / "a.xlsx", rows, names)
    (tmp_path / "a.csv").write_text("コード,銘柄名,市場・商品区分,33業種区分,日付\n1301,極洋,プライム,水産・農林業,2024-01-05\n130A,ベリタス,グロース,,2024-01-06 12:00:00\n,極洋,,,\n2.5,TRUE,FALSE,,\n", encoding="utf-8")
    spark.dataSource.register(sheets.Sheet)
    got, want = spark.read.format("sheet").load(str(tmp_path / "a.xlsx")), masters.read_sheet(spark, str(tmp_path / "a.csv"))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert [tuple(r) for r in masters.universe(got).orderBy("code").collect()] == [tuple(r) for r in masters.universe(want).orderBy("code").collect()]
    workbook(tmp_path / "b.xlsx", [[("s", "コード", 0), ("s", "日付", 0)], [("s", "130A", 0), ("n", "43834", 1)]], names, early=True)
    both = spark.read.format("sheet").load(str(tmp_path))
    assert both.columns == head and both.rdd.getNumPartitions() == 2 and both.count() == 5
    assert both.where(F.col("銘柄名").isNull()).first()["日付"] == "2024-01-05"


def test_earnings_from_a_sheet(spark, tmp_path):
    names = ["コード", "会社名", "発表予定日", "甲", "未定"]
    workbook(tmp_path / "e.xlsx", [[("s", n, 0) for n in names[:3]], [("n", "7203", 0), ("s", "甲", 0), ("n", "45296", 1)], [("n", "6758", 0), ("s", "甲", 0), None], [("n", "9984", 0), ("s", "甲", 0), ("s", "未定", 0)]], names)
    spark.dataSource.register(sheets.Sheet)
    got = {r["code"]: r["earnings_date"] for r in masters.earnings(spark.read.format("sheet").load(str(tmp_path / "e.xlsx"))).collect()}
    assert got == {"7203": date(2024, 1, 5), "6758": None, "9984": None}
