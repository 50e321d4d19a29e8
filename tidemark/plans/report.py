"""Renderings of the day's ranking: CSV, Markdown, and the cards of picks as one expression, so that all days are rendered in tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["rank", "code", "company_name", "tier", "confidence", "break_conditions"]


def pick_rows(ranked: DataFrame) -> DataFrame:
    """The export's rows: confidence with four digits, conditions joined."""
    return ranked.select("rank", "code", "company_name", "tier", F.format_string("%.4f", "confidence").alias("confidence"), F.array_join("break_conditions", " / ").alias("break_conditions"))


def write_csv(ranked: DataFrame, path: str) -> None:
    """One CSV file of a day's picks (tens of rows) with a byte-order mark for spreadsheets."""
    import csv

    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(COLUMNS)
        out.writerows(tuple(r) for r in pick_rows(ranked).orderBy("rank").collect())


def percent(value: float | None, signed: bool = False) -> str:
    return "―" if value is None else f"{value:+.1%}" if signed else f"{value:.1%}"


def cell(value: object) -> str:
    """A value inside a Markdown table: nothing for null, no bars or line ends of its own."""
    return "" if value is None else str(value).replace("|", "\\|").replace("\n", " ")


def shown(c: Column, signed: bool = False) -> Column:
    """A share as a whole percentage, halves to even; null is a dash."""
    whole = F.bround(F.round(c * 100, 6), 0) + F.lit(0.0)
    return F.when(c.isNull(), "―").otherwise(F.format_string("%+.0f%%" if signed else "%.0f%%", whole))


def card() -> Column:
    """A pick's card from the columns place, name, code, stars, grade, final_grade (null until it is checked), started, fresh,
    expected_days, remaining, priced, excess, median, diagnosis, prob, arrows (arrow_no, status) and against (arrow_no,
    source_tier). Parts that a pick doesn't have are left out."""
    text = lambda c: F.col(c).cast("string")
    lines = lambda c, f: F.when(F.size(c) > 0, F.array_join(F.transform(c, f), "\n"))
    grade = F.coalesce(F.concat("final_grade", F.lit("(確定)")), F.concat("grade", F.lit("(暫定。翌日に確定)")), F.lit("―"))
    fresh = F.concat(shown(F.col("fresh")), F.lit("(想定期間 "), text("expected_days"), F.lit(" 営業日・残り "), text("remaining"), F.lit(" 営業日)"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("### 本命"), text("place"), F.lit("位 "), "name", F.lit("("), text("code"), F.lit(")  自信度 "), F.repeat(F.lit("★"), F.col("stars"))),
        F.concat(F.lit("- **等級**:"), grade),
        F.concat(F.lit("- **鮮度**:"), F.when(F.col("started"), fresh).otherwise("待機中")),
        F.concat(F.lit("- **織り込み度**:"), shown(F.col("priced")), F.lit("(超過上昇 "), shown(F.col("excess"), True), F.lit(" ÷ 想定上昇幅 "), shown(F.col("median"), True), F.lit(")")),
        F.concat(F.lit("- **反応の診断**:"), "diagnosis"),
        F.concat(F.lit("- **実現確度**:"), shown(F.col("prob"))),
        F.when(F.size("arrows") > 0, "- **裏取り**:"),
        lines("arrows", lambda a: F.concat(F.lit("  - 矢印"), a["arrow_no"].cast("string"), F.lit(" ― "), a["status"])),
        lines("against", lambda a: F.concat(F.lit("- **反証**:矢印"), a["arrow_no"].cast("string"), F.lit("(信頼度"), a["source_tier"].cast("string"), F.lit(")"))),
    )


def markdown(ranked: DataFrame, day: str, most: int = 50) -> str:
    """The day's report."""
    rows = ranked.orderBy("rank").limit(most).collect()
    lines = [f"# {day}", "", "| # | code | tier | confidence | stars |", "|-|-|-|-|-|"]
    lines += [f"| {r['rank']} | {r['code']} | {r['tier']} | {percent(r['confidence'])} | {'★' * r['stars']} |" for r in rows]
    return "\n".join(lines) + "\n"


def morning(moves: DataFrame, signals: DataFrame, day: str, most: int = 50) -> str:
    """The morning's notice: codes that moved overnight (code, z) and signals (code, company_name, signals)."""
    lines = [f"# {day}", "", "## Moves overnight", ""]
    lines += [f"- {r['code']}: {r['z']:.1f}" for r in moves.orderBy(F.desc("z"), "code").limit(most).collect()] or ["- none"]
    lines += ["", "## Signals", ""]
    lines += [f"- {r['code']} {r['company_name']}: {r['signals']}" for r in signals.orderBy("code").limit(most).collect()] or ["- none"]
    return "\n".join(lines) + "\n"


def month_markdown(metrics: DataFrame) -> str:
    """The monthly table (a row for each month) of the review's rates."""
    head = ["month", "picks", "pending", "hit_rate_by_stock", "hit_rate_by_scenario", "stage1_hit_rate", "lead_rate"]
    rows = metrics.select(*head).orderBy("month").collect()
    cell = lambda n, v: str(v) if n in ("month", "picks", "pending") else percent(v)
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "-|" * len(head), *("| " + " | ".join(cell(n, r[n]) for n in head) + " |" for r in rows)]) + "\n"
