"""The day's context and report, cards, theme states, failed picks, evidence rules: on rows whose answers are known."""

from datetime import date

from pyspark.sql import functions as F

from tidemark import calendar
from tidemark.operators import evidence, prices
from tidemark.plans import context, pack, report, review

DAY, EVE = date(2024, 1, 4), date(2024, 1, 3)


def frames(spark):
    scenarios = spark.createDataFrame([("A", DAY, "待機", "単発"), ("B", EVE, "進行中", "予定日"), ("C", None, None, None)], "scenario_id string, created date, status string, time_type string")
    updates = spark.createDataFrame([("B", DAY, "強化", "Strong"), ("B", DAY, "強化", "Strong"), ("C", DAY, "消滅", None), ("B", EVE, "消滅", "Weak"), ("Z", DAY, "消滅", "Weak")], "scenario_id string, day date, type string, strength_after string")
    statuses = spark.createDataFrame([("C", DAY, "終了", None), ("B", EVE, "終了", "old"), ("A", DAY, "休眠", None), ("Z", DAY, "終了", "unknown")], "scenario_id string, day date, status string, reason string")
    signals = spark.createDataFrame([("B", DAY, "x|y"), ("B", EVE, "z")], "scenario_id string, day date, signals string")
    return scenarios, updates, statuses, signals, spark.createDataFrame([("feed",)], "source string")


def test_day_context_takes_only_the_day_and_known_scenarios(spark):
    got = sorted(tuple(r) for r in context.day_context("2024-01-04", *frames(spark)).collect())
    assert got == sorted([
        ("new", "A", "待機|単発"), ("update", "B", "強化|Strong"), ("update", "B", "強化|Strong"), ("update", "C", "消滅"), ("update", "Z", "消滅|Weak"),
        ("ended", "C", ""), ("ended", "C", context.BROKEN), ("signal", "B", "x|y"), ("warning", "feed", "failed three times in a row"),
    ])
    empty = [f.limit(0) for f in frames(spark)]
    assert context.day_context("2024-01-04", *empty).count() == 0


def test_daily_report_counts_all_and_shows_the_first(spark):
    told = context.day_context("2024-01-04", *frames(spark))
    ranked = spark.createDataFrame([(2, "7|3", "監視", 1, 0.01, "a|b"), (1, "72", "本命", 3, 0.12345, None)], "rank int, code string, tier string, stars int, confidence double, reason string")
    cards = spark.createDataFrame([(1, "### card")], "place int, card string")
    text = context.daily("2024-01-04", told, ranked, cards)
    assert "本命 1 銘柄 / 新しいシナリオ 1 件 / 強化 2 件 / 終了 2 件" in text and "- warning feed:" in text
    assert text.index("| 1 | 72 | 本命 | ★★★ 0.123 |  |") < text.index("| 2 | 7\\|3 |") < text.index("### card")
    short = context.daily("2024-01-04", told, ranked, cards.limit(0), most=2)
    assert "- 5 more" in short and "本命:該当なし" in short and "本命 0 銘柄" in short
    bare = context.daily("2024-01-04", told.limit(0), ranked.limit(0), cards.limit(0))
    assert "Warnings" not in bare and bare.count("- none") == 2


def test_card_leaves_out_what_a_pick_does_not_have(spark):
    schema = """place int, name string, code string, stars int, grade string, final_grade string, started boolean, fresh double, expected_days int, remaining int, priced double, excess double, median double,
        diagnosis string, prob double, arrows array<struct<arrow_no: int, status: string>>, against array<struct<arrow_no: int, source_tier: int>>"""
    rows = [
        (1, "N", "72", 3, "S", "A", True, 0.125, 10, 4, 0.375, -0.021, 0.2, "未発見", 0.5, [(1, "確認"), (2, "否定")], [(2, 4)]),
        (2, "M", "73", 1, None, None, False, 1.0, 10, None, 0.0, None, 0.1, "時間差あり", 0.05, None, []),
    ]
    one, two = (r["card"].split("\n") for r in spark.createDataFrame(rows, schema).select("place", report.card().alias("card")).orderBy("place").collect())
    assert one == [
        "### 本命1位 N(72)  自信度 ★★★", "- **等級**:A(確定)", "- **鮮度**:12%(想定期間 10 営業日・残り 4 営業日)", "- **織り込み度**:38%(超過上昇 -2% ÷ 想定上昇幅 +20%)", "- **反応の診断**:未発見",
        "- **実現確度**:50%", "- **裏取り**:", "  - 矢印1 ― 確認", "  - 矢印2 ― 否定", "- **反証**:矢印2(信頼度4)",
    ]
    assert two == ["### 本命2位 M(73)  自信度 ★", "- **等級**:―", "- **鮮度**:待機中", "- **織り込み度**:0%(超過上昇 ― ÷ 想定上昇幅 +10%)", "- **反応の診断**:時間差あり", "- **実現確度**:5%"]


def test_theme_states_take_the_latest_of_each(spark):
    themes = spark.createDataFrame([(1, "a"), (2, "b")], "theme_id int, name string")
    cards = spark.createDataFrame([(1, 1, "old", 5), (1, 2, "new", 9)], "theme_id int, version int, market_premise string, _seq int")
    heat = spark.createDataFrame([(1, "上昇中", date(2024, 1, 1), 2), (1, "冷却中", date(2023, 12, 30), 7)], "theme_id int, temperature string, run_date date, _seq int")
    by = lambda day, h=heat: {r["theme_id"]: (r["card"] and r["card"]["market_premise"], r["temperature"], r["due"]) for r in pack.theme_states(themes, cards, h, day).collect()}
    assert by("2024-01-07") == {1: ("new", "冷却中", False), 2: (None, None, False)}
    assert by("2024-01-08")[2][2] and by("2024-01-07", heat.limit(0)) == {1: ("new", None, True), 2: (None, None, True)}


def test_failures_are_closed_and_unmoved(spark):
    cal = calendar.dimension(spark)
    picks = spark.createDataFrame(
        [(1, "a", date(2024, 1, 4), 3, False), (2, "a", date(2024, 1, 4), 3, True), (3, "b", date(2024, 2, 1), 60, None), (4, "b", date(2024, 2, 27), 3, False)],
        "scenario_id int, code string, first_date date, expected_days int, moved boolean",
    )
    plan = spark.createDataFrame([(1, 2, "否定"), (1, 1, "確認")], "scenario_id int, arrow_no int, status string")
    got = {r["scenario_id"]: (r["month"], r["arrows"] and [tuple(a) for a in r["arrows"]]) for r in review.failures(picks, plan, F.lit("2024-02-29").cast("date"), cal).collect()}
    assert got == {1: (date(2024, 1, 1), [(1, "確認"), (2, "否定")])}
    later = review.failures(picks, plan, F.lit("2024-03-05").cast("date"), cal)  # the long one is over after the horizon of 20 days
    assert sorted(r["scenario_id"] for r in later.collect()) == [1, 3, 4]


def test_tiers_shares_and_posts(spark):
    proof = spark.createDataFrame([(1, "for", 3), (1, "against", 1), (2, "for", 2), (2, "for", 4), (3, "against", 4), (4, "for", None)], "scenario_id int, supports string, source_tier int")
    assert [r[0] for r in evidence.low_tier_only(proof).collect()] == [1]
    plan = spark.createDataFrame([(1, 1, "確認"), (1, 2, "否定"), (1, 2, "否定"), (1, 3, None)], "scenario_id int, arrow_no int, status string")
    r = evidence.plan_shares(plan.where("arrow_no < 3")).first()
    assert (round(r["verified"], 6), r["denied"]) == (0.333333, 2)
    listing = spark.createDataFrame([("a", EVE, "監理"), ("a", DAY, "通常"), ("b", DAY, "整理"), ("b", DAY, "整理"), ("c", EVE, "整理")], "code string, date date, status string")
    posts = evidence.on_post(listing, "code")
    assert [r[0] for r in posts.collect()] == ["b"]
    assert {r["code"]: r["post"] for r in evidence.flagged(listing.select("code").distinct(), posts, "post").collect()} == {"a": False, "b": True, "c": False}


def test_bars_near_an_evaluation(spark):
    bars = lambda *rows: spark.createDataFrame(list(rows), "code string, date date, close double")
    home = bars(("1301", date(2024, 1, 1), 1.0), ("1301", date(2023, 5, 9), 2.0), ("1301", date(2023, 5, 8), 3.0), ("1301", date(2024, 1, 5), 4.0), ("AAPL", EVE, 5.0), ("130A", DAY, 6.0))
    foreign = bars(("AAPL", EVE, 7.0), ("1301", EVE, 8.0), ("13012", EVE, 9.0))
    asked = spark.createDataFrame([("1301", DAY), ("1301", DAY), ("1301", date(2024, 1, 5)), ("AAPL", DAY), ("13012", DAY), ("130A", DAY), ("none", DAY), (None, DAY), ("1301", None)], "code string, eval_date date")
    got = lambda df: sorted((r["code"], r["eval_date"].day, r["close"]) for r in df.collect())
    both = got(prices.near(asked, home, foreign))
    assert both == [("1301", 4, 1.0), ("1301", 4, 2.0), ("1301", 5, 1.0), ("1301", 5, 4.0), ("13012", 4, 9.0), ("130A", 4, 6.0), ("AAPL", 4, 7.0)]
    assert ("AAPL", 4, 5.0) in got(prices.near(asked, home)) and prices.near(asked.limit(0), home).count() == 0
