"""Scoring expressions: freshness, priced-in degree, confidence, probability, diagnosis, endings, signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Names of temperatures and strengths, factors, the upper bound; the label texts of the rules below.
TEMPERATURES = {"上昇中": 1.1, "横ばい": 1.0, "冷却中": 0.9}
STRENGTHS = ["Weak", "Weak+", "Medium", "Strong"]
IGNORED = "⚠ 無視されている疑い"
MAX_PROB = 0.95


def freshness(started: Column, elapsed: Column, expected_days: Column) -> Column:
    """1 before the start, then falling to 0 at the end of the expected days; null for no positive span."""
    return F.when(~started, 1.0).when(expected_days > 0, F.greatest(F.lit(0.0), 1 - elapsed / expected_days))


def priced_in(excess: Column, median: Column) -> Column:
    return F.when(median > 0, F.greatest(F.lit(0.0), excess / median))


def remaining_room(median: Column, priced: Column) -> Column:
    return median * F.greatest(F.lit(0.0), 1 - priced)


def confidence(prob: Column, median: Column, priced: Column, fresh: Column) -> Column:
    return prob * remaining_room(median, priced) * fresh


STARS_FROM = (0.05, 0.10, 0.20)


def stars(value: Column) -> Column:
    low, mid, high = STARS_FROM
    return F.when(value >= high, 4).when(value >= mid, 3).when(value >= low, 2).otherwise(1)


def _place(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STRENGTHS)), c).cast("int")


def adjusted_probability(base: Column, verified: Column, denied: Column, clear: Column, diagnosis: Column, temperature: Column, strength: Column, initial: Column) -> Column:
    """Product of the audit factors, held between 0 and MAX_PROB."""
    p = base * (0.8 + 0.4 * verified) * F.pow(F.lit(0.7), denied)
    p = p * F.when(clear, 1.0).otherwise(0.8) * F.when(diagnosis == IGNORED, 0.5).otherwise(1.0)
    heat = F.lit(1.0)
    for name, factor in TEMPERATURES.items():
        heat = F.when(temperature == name, factor).otherwise(heat)
    known = (_place(strength) > 0) & (_place(initial) > 0)
    step = F.when(known, 1 + 0.1 * (_place(strength) - _place(initial))).otherwise(1.0)
    return F.least(F.greatest(p * heat * step, F.lit(0.0)), F.lit(MAX_PROB))


def probability_notes(base: Column, verified: Column, denied: Column, clear: Column, diagnosis: Column, temperature: Column, strength: Column, initial: Column) -> Column:
    """What changed the probability, in order: the estimate, the share of arrows confirmed, and each factor that isn't 1. Halves
    are rounded to even digits."""
    percent = lambda c: F.format_string("%.0f%%", F.bround(c * 100, 0))
    two = lambda c: F.format_string("%.2f", F.bround(c, 2))
    heat = F.lit(None).cast("string")
    for name, factor in TEMPERATURES.items():
        heat = F.when(temperature == name, F.lit(f"テーマの温度 {name} ×{factor}") if factor != 1.0 else F.lit(None)).otherwise(heat)
    steps = _place(strength) - _place(initial)
    moved = (_place(strength) > 0) & (_place(initial) > 0) & (steps != 0)
    return F.array_compact(
        F.array(
            F.concat(F.lit("LLM の推定 "), percent(base)),
            F.concat(F.lit("裏取り "), percent(verified), F.lit(" 確認 ×"), two(0.8 + 0.4 * verified)),
            F.when(denied > 0, F.concat(F.lit("否定された矢印 "), denied.cast("string"), F.lit(" 本 ×"), two(F.pow(F.lit(0.7), denied)))),
            F.when(~clear, "方向が曖昧 ×0.8"),
            F.when(diagnosis == IGNORED, "無視されている疑い ×0.5"),
            heat,
            F.when(moved, F.concat(F.lit("強さ "), initial, F.lit("→"), strength, F.lit(" ×"), two(1 + 0.1 * steps))),
        )
    )


def diagnosis(attention_high: Column, tier1_reacted: Column, reacted: Column) -> Column:
    return (
        F.when(~attention_high & reacted, "早耳の先回り")
        .when(reacted, "織り込み進行")
        .when(tier1_reacted, "時間差あり")
        .when(attention_high, IGNORED)
        .otherwise("未発見")
    )


# Yen a day on average, yen a share, and the return of the last 20 rows.
LEAST_TURNOVER, LEAST_PRICE, SURGE = 3e8, 100.0, 0.50


def exclusion(side: Column, monitored: Column, turnover: Column, price: Column, surge: Column, low_tier: Column) -> Column:
    """The first reason that keeps a candidate from being picked; null for none."""
    return (
        F.when(side == "caution", "売り方向(caution)の候補")
        .when(monitored, "監理・整理ポストの銘柄")
        .when(turnover < LEAST_TURNOVER, "流動性の下限を満たさない")
        .when(price < LEAST_PRICE, "株価100円未満")
        .when(surge > SURGE, "直近ですでに急騰している")
        .when(low_tier, "裏取りの証拠が信頼度3・4の情報源だけ")
    )


REACTION = 2.0  # sigmas from which a day counts as a reaction
LONGEST_WAIT = 60  # business days, of a start or of signals after a pick
PRICED_FULLY, PRICED_NEARLY, LAST_DAYS = 0.80, 0.70, 2


def end_reason(broken: Column, started: Column, waiting_days: Column, elapsed: Column, expected_days: Column, tier1_reacted: Column, reacted: Column, priced: Column) -> Column:
    late = elapsed > expected_days
    return (
        F.when(broken, "シナリオが崩れた")
        .when(~started & (waiting_days >= LONGEST_WAIT), "起動しなかった")
        .when(~started, F.lit(None).cast("string"))
        .when(priced >= PRICED_FULLY, "織り込みが完了した")
        .when(late & ~tier1_reacted & ~reacted, "材料が弱かった")
        .when(late & tier1_reacted & ~reacted, "連想が市場に届かなかった")
    )


def sell_signals(broken: Column, weakened: Column, priced: Column, remaining: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(broken, "崩れる条件に当たるニュースが出た"),
            F.when(weakened, "シナリオが弱体化・終了した"),
            F.when(priced >= PRICED_NEARLY, "織り込み度が70%以上(完了が近い)"),
            F.when(remaining <= LAST_DAYS, "想定期間の終わりが近い"),
        )
    )


def checked_grade(grade: Column, reacted: Column) -> Column:
    """S and A go one step down where nothing reacted."""
    return F.when(~reacted & (grade == "S"), "A").when(~reacted & (grade == "A"), "B").otherwise(grade)


def wilson(k: Column, n: Column, upper: bool, z: float = 1.96) -> Column:
    """A bound of the 95 % Wilson interval, three digits; null for n = 0."""
    p = k / F.nullif(n, F.lit(0))
    denominator = 1 + z * z / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denominator
    centre = (p + z * z / (2 * n)) / denominator
    return F.when(n > 0, F.round(centre + half if upper else centre - half, 3))
