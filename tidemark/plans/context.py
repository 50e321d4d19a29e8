"""What a day's report tells beside the ranking: scenarios that are new, changed or ended, signals, sources that fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .report import cell
from .tracking import BREAKING, ENDED

# Fixed value: the reason of a scenario that an update ends.
BROKEN = "シナリオが崩れた(消滅)"


def day_context(day: str, scenarios: DataFrame, updates: DataFrame, statuses: DataFrame, signals: DataFrame, failing: DataFrame) -> DataFrame:
    """(section, subject, detail) of one day.

    scenarios (scenario_id, created, status, time_type): all; updates (scenario_id, day, type, strength_after); statuses
    (scenario_id, day, status, reason); signals (scenario_id, day, signals); failing (source): sources whose last runs all
    failed. Endings of ids that no scenario has are left out; a scenario that both a status and an update end is told twice,
    with each reason. Each table is filtered to the day where it is read, and only scenario ids meet by a join.
    """
    today = F.lit(day).cast("date")
    text = lambda *cs: F.concat_ws("|", *[F.col(c).cast("string") for c in cs])

    def part(section: str, rows: DataFrame, detail: Column, subject: str = "scenario_id") -> DataFrame:
        return rows.select(F.lit(section).alias("section"), F.col(subject).cast("string").alias("subject"), detail.alias("detail"))

    changed = updates.where(F.col("day") == today)
    ended = statuses.where((F.col("day") == today) & (F.col("status") == ENDED)).select("scenario_id", F.coalesce("reason", F.lit("")).alias("reason"))
    ended = ended.unionByName(changed.where(F.col("type") == BREAKING).select("scenario_id", F.lit(BROKEN).alias("reason")))
    parts = [
        part("new", scenarios.where(F.col("created") == today), text("status", "time_type")),
        part("update", changed, text("type", "strength_after")),
        part("ended", ended.join(scenarios.select("scenario_id"), "scenario_id", "left_semi"), F.col("reason")),
        part("signal", signals.where(F.col("day") == today), F.col("signals")),
        part("warning", failing, F.lit("failed three times in a row"), "source"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def daily(day: str, context: DataFrame, ranked: DataFrame, cards: DataFrame, most: int = 50) -> str:
    """The day's report as Markdown: conclusion, warnings, the ranking (rank, code, tier, stars, confidence, reason), the picks'
    cards (place, card), changes and signals. Counts are over all rows; of each section the first `most` lines are shown, and
    how many more there are is said."""
    n = {(r["section"], r["kind"]): r["count"] for r in context.groupBy("section", F.when(F.col("section") == "update", F.substring_index("detail", "|", 1)).otherwise("").alias("kind")).count().collect()}
    total = lambda section: sum(v for (s, _), v in n.items() if s == section)
    picked = [r["card"] for r in cards.orderBy("place").collect()]  # at most three a day
    out = [f"# {day}", "", f"本命 {len(picked)} 銘柄 / 新しいシナリオ {total('new')} 件 / 強化 {n.get(('update', '強化'), 0)} 件 / 終了 {total('ended')} 件", ""]

    def section(*names: str) -> list[str]:
        rows = context.where(F.col("section").isin(*names)).orderBy(F.array_position(F.array(*map(F.lit, names)), F.col("section")), "subject", "detail").limit(most).collect()
        rest = sum(map(total, names)) - len(rows)
        return [f"- {r['section']} {r['subject']}: {r['detail']}" for r in rows] + ([f"- {rest} more"] if rest else [])

    if total("warning"):
        out += ["## Warnings", "", *section("warning"), ""]
    out += ["## Ranking", "", "| # | code | tier | confidence | reason |", "|-|-|-|-|-|"]
    out += [f"| {r['rank']} | {cell(r['code'])} | {r['tier']} | {'★' * r['stars']} {r['confidence']:.3f} | {cell(r['reason'])} |" for r in ranked.orderBy("rank").limit(most).collect()]
    out += ["", *(picked or ["本命:該当なし"]), "", "## Changes", "", *(section("new", "update", "ended") or ["- none"]), "", "## Signals", "", *(section("signal") or ["- none"])]
    return "\n".join(out) + "\n"
