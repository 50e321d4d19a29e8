"""Queries that score, rank, end and track candidates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import calendar
from ..functions import scoring as sc
from ..operators import evidence
from ..operators import prices as ops
from ..operators import state
from ..plans import nightly, report
from ..shared import cut
from . import base
from .base import query

# Candidates at an evaluation date up to 39 days after the pick. Reactions and the final grade come from prices, shares of
# verified arrows and tiers of evidence from lines, posts from customers; the rest (start, strengths, clearness) is what a person
# or a model tells, derived from the key.
_EVAL = """ev AS (SELECT p.*, CAST(p.first_date + CAST(p.scenario_id % 40 AS INTEGER) AS DATE) AS eval_date, p.scenario_id % 3 <> 0 AS started,
        CASE WHEN coalesce(s, 2) < 2 THEN p.scenario_id % 4 = 0 ELSE p.scenario_id % 4 < 2 END AS attention_high,
        EXISTS (SELECT 1 FROM sig g WHERE g.sigma >= 2 AND g.code = (p.code + 1) % 25 AND g.date >= p.first_date AND g.date <= CAST(p.first_date + CAST(p.scenario_id % 40 AS INTEGER) AS DATE)) AS tier1,
        EXISTS (SELECT 1 FROM sig g WHERE g.sigma >= 2 AND g.code = p.code AND g.date >= p.first_date AND g.date <= CAST(p.first_date + CAST(p.scenario_id % 40 AS INTEGER) AS DATE)) AS reacted,
        coalesce(ar.verified, 0) AS verified, coalesce(ar.denied, 0) AS denied, coalesce(ar.low_tier, false) AS low_tier, po.scenario IS NOT NULL AS post, s AS top, p.scenario_id % 8 <> 0 AS clear,
        ['上昇中', '横ばい', '冷却中', NULL][p.scenario_id % 4 + 1] AS temperature, ['Weak', 'Weak+', 'Medium', 'Strong'][p.scenario_id % 4 + 1] AS strength, ['Weak', 'Weak+', 'Medium', 'Strong'][p.scenario_id // 4 % 4 + 1] AS initial
        FROM picks p LEFT JOIN (SELECT p.scenario_id, max(sigma) AS s FROM picks p JOIN cal a ON a.d = p.first_date JOIN cal b ON b.is_bd AND b.bd_seq = a.bd_seq + 1
            JOIN sig ON sig.code = p.code AND (sig.date = p.first_date OR sig.date = b.d) GROUP BY 1) t ON t.scenario_id = p.scenario_id
        LEFT JOIN (SELECT l_orderkey, avg((l_returnflag <> 'R' AND l_linestatus = 'F')::INTEGER) AS verified, CAST(count_if(l_returnflag = 'R') AS INTEGER) AS denied,
            min(CASE WHEN l_returnflag <> 'R' THEN l_linenumber % 4 + 1 END) >= 3 AS low_tier FROM lineitem GROUP BY 1) ar ON ar.l_orderkey = p.scenario_id
        LEFT JOIN (SELECT o_orderkey AS scenario FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < -500) po ON po.scenario = p.scenario_id)"""
_SCORED = f"""{_EVAL}, spanned AS (SELECT e.*, (c1.close / c0.close - 1) - (b1.b_on / b0.b_before - 1) AS excess, b.bd_seq - a.bd_seq AS elapsed FROM ev e
        ASOF LEFT JOIN px c0 ON e.code = c0.code AND c0.date < e.first_date ASOF LEFT JOIN px c1 ON e.code = c1.code AND c1.date <= e.eval_date
        LEFT JOIN bday b0 ON b0.b_date = e.first_date LEFT JOIN bday b1 ON b1.b_date = e.eval_date LEFT JOIN cal a ON a.d = e.first_date LEFT JOIN cal b ON b.d = e.eval_date),
    scored AS (SELECT *, CASE WHEN started THEN greatest(0, 1 - elapsed / expected_days) ELSE 1 END AS fresh, CASE WHEN started THEN coalesce(greatest(0, excess / median), 0) ELSE 0 END AS priced,
        CASE WHEN NOT attention_high AND reacted THEN '早耳の先回り' WHEN reacted THEN '織り込み進行' WHEN tier1 THEN '時間差あり' WHEN attention_high THEN '⚠ 無視されている疑い' ELSE '未発見' END AS diagnosis FROM spanned),
    conf AS (SELECT *, least(greatest(prob * (0.8 + 0.4 * verified) * pow(0.7, denied) * CASE WHEN clear THEN 1 ELSE 0.8 END * CASE WHEN diagnosis = '⚠ 無視されている疑い' THEN 0.5 ELSE 1 END
            * CASE temperature WHEN '上昇中' THEN 1.1 WHEN '冷却中' THEN 0.9 ELSE 1 END * (1 + 0.1 * (list_position(['Weak', 'Weak+', 'Medium', 'Strong'], strength) - list_position(['Weak', 'Weak+', 'Medium', 'Strong'], initial))), 0), 0.95) AS p2 FROM scored),
    final AS (SELECT *, median * greatest(0, 1 - priced) AS room, p2 * median * greatest(0, 1 - priced) * fresh AS confidence FROM conf)"""
NEEDS = ("px", "idx", "cal", "bday", "feat", "sig", "picks")


def _pick(names, k):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (k + 1).cast("int"))


def arrows(spark, d):
    """(scenario_id, arrow_no, status, supports, source_tier): each line is an arrow of its order's check plan with its evidence."""
    against, no = F.col("l_returnflag") == "R", F.col("l_linenumber")
    status = F.when(against, evidence.DENIED).when(F.col("l_linestatus") == "F", evidence.CONFIRMED).otherwise(evidence.UNSEEN)
    return base.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("scenario_id"), no.alias("arrow_no"), status.alias("status"), F.when(against, "against").otherwise("for").alias("supports"), (no % 4 + 1).alias("source_tier"))


def _posts(spark, d):
    """(scenario_id) of scenarios whose customer is on a monitored post."""
    listing = base.read(spark, d, "customer").select("c_custkey", F.lit("1998-08-03").cast("date").alias("date"), F.when(F.col("c_acctbal") < -500, "監理").otherwise("通常").alias("status"))
    orders = base.read(spark, d, "orders").select(F.col("o_orderkey").alias("scenario_id"), F.col("o_custkey").alias("c_custkey"))
    return orders.join(evidence.on_post(listing, "c_custkey"), "c_custkey", "left_semi").select("scenario_id")


def evaluated(spark, d):
    """PIP3: candidates with freshness, priced-in degree, diagnosis, probability and confidence."""
    key, cal = F.col("scenario_id"), calendar.dimension(spark)
    ev = base.picks(spark, d).withColumns(
        {
            "eval_date": F.expr("date_add(first_date, cast(scenario_id % 40 as int))"), "started": key % 3 != 0, "peer": (F.col("code") + 1) % 25,
            "clear": key % 8 != 0, "temperature": _pick(["上昇中", "横ばい", "冷却中", None], key % 4),
            "strength": _pick(sc.STRENGTHS, key % 4), "initial": _pick(sc.STRENGTHS, F.floor(key / 4) % 4),
        }
    )
    by_day, prices = cut(ops.benchmark_by_day(base.benchmark(spark, d), cal)), cut(base.prices(spark, d))
    sigma = cut(ops.day_sigma(ops.daily_features(prices), by_day).select("code", "date", "sigma"))
    plan = arrows(spark, d)
    ev = ev.join(evidence.plan_shares(plan), "scenario_id", "left").withColumns({"verified": F.coalesce("verified", F.lit(0.0)), "denied": F.coalesce("denied", F.lit(0))})
    ev = evidence.flagged(evidence.flagged(ev, evidence.low_tier_only(plan), "low_tier"), _posts(spark, d), "post")
    # Reactions of the candidate and of the tier-1 company before it in the chain, each (code, pick, day) once.
    spans = ev.select("code", "peer", "first_date", "eval_date").distinct()
    spans = nightly.reacted(spans, sigma, "first_date", "eval_date", "reacted")
    spans = nightly.reacted(spans.withColumnsRenamed({"code": "own", "peer": "code"}), sigma, "first_date", "eval_date", "tier1").withColumnsRenamed({"code": "peer", "own": "code"})
    ev = ops.rejoin(ev, spans.drop("peer"), ["code", "first_date", "eval_date"], ["reacted", "tier1"])
    # Attention is high where the final grade of the pick's day is S or A.
    days = calendar.add_business_days(ev.select("code", "first_date").distinct(), "first_date", F.lit(1), "next", cal).select("code", "first_date", F.explode(F.array("first_date", "next")).alias("date"))
    top = days.join(sigma, ["code", "date"]).groupBy("code", "first_date").agg(F.max("sigma").alias("top"))
    ev = ops.rejoin(ev, top, ["code", "first_date"], ["top"])
    grade = F.substring(F.lit("SABC"), (key % 4 + 1).cast("int"), F.lit(1))
    final = sc.checked_grade(grade, F.coalesce(F.col("top") >= sc.REACTION, F.lit(True)))
    ev = ev.withColumns({"attention_high": final.isin("S", "A"), "grade": grade, "final_grade": F.when(F.col("top").isNotNull(), final)})
    ev = ops.excess_return(ev, prices, by_day, "first_date", "eval_date")
    ev = calendar.with_seq(calendar.with_seq(ev, "first_date", "a", cal), "eval_date", "b", cal).withColumn("elapsed", F.col("b") - F.col("a"))
    ev = ev.withColumn("fresh", sc.freshness(F.col("started"), F.col("elapsed"), F.col("expected_days")))
    ev = ev.withColumn("priced", F.when(F.col("started"), F.coalesce(sc.priced_in(F.col("excess"), F.col("median")), F.lit(0.0))).otherwise(0.0))
    ev = ev.withColumn("diagnosis", sc.diagnosis(F.col("attention_high"), F.col("tier1"), F.col("reacted")))
    cols = [F.col(c) for c in ("prob", "verified", "denied", "clear", "diagnosis", "temperature", "strength", "initial")]
    ev = ev.withColumn("p2", sc.adjusted_probability(*cols))
    ev = ev.withColumn("room", sc.remaining_room(F.col("median"), F.col("priced")))
    return ev.withColumn("confidence", sc.confidence(F.col("p2"), F.col("median"), F.col("priced"), F.col("fresh")))


@query(
    f"""SELECT * FROM (WITH {_SCORED} SELECT scenario_id, code, round(fresh + 1e-10, 6) AS fresh, round(priced + 1e-10, 6) AS priced, round(room + 1e-10, 6) AS room, diagnosis, round(p2 + 1e-10, 6) AS prob, round(confidence + 1e-10, 6) AS confidence,
        CASE WHEN confidence >= 0.2 THEN 4 WHEN confidence >= 0.1 THEN 3 WHEN confidence >= 0.05 THEN 2 ELSE 1 END AS stars FROM final)""",
    NEEDS,
)
def evaluate_candidates(spark, d):
    """PIP3, JN9, JN12, WIN5, SC14-19, AGG11: freshness, priced-in degree, diagnosis, probability, confidence, stars."""
    r = lambda c, n=None: F.round(F.col(c) + 1e-10, 6).alias(n or c)  # noqa: E731  # exact halves don't fall by the last bit
    return evaluated(spark, d).select("scenario_id", "code", r("fresh"), r("priced"), r("room"), "diagnosis", r("p2", "prob"), r("confidence"), sc.stars(F.col("confidence")).alias("stars"))


@query(
    f"""SELECT * FROM (WITH {_SCORED} SELECT scenario_id, code, array_to_string(list_filter([
            'LLM の推定 ' || CAST(round(prob * 100) AS INTEGER) || '%', '裏取り ' || CAST(round_even(verified * 100, 0) AS INTEGER) || '% 確認 ×' || printf('%.2f', 0.8 + 0.4 * verified),
            CASE WHEN denied > 0 THEN '否定された矢印 ' || denied || ' 本 ×' || printf('%.2f', pow(0.7, denied)) END, CASE WHEN NOT clear THEN '方向が曖昧 ×0.8' END,
            CASE WHEN diagnosis = '⚠ 無視されている疑い' THEN '無視されている疑い ×0.5' END, CASE temperature WHEN '上昇中' THEN 'テーマの温度 上昇中 ×1.1' WHEN '冷却中' THEN 'テーマの温度 冷却中 ×0.9' END,
            CASE WHEN strength <> initial THEN '強さ ' || initial || '→' || strength || ' ×' ||
                printf('%.2f', 1 + 0.1 * (list_position(['Weak', 'Weak+', 'Medium', 'Strong'], strength) - list_position(['Weak', 'Weak+', 'Medium', 'Strong'], initial))) END], lambda x: x IS NOT NULL), ' | ') AS notes FROM final)""",
    NEEDS,
)
def probability_audit(spark, d):
    """SC18: what changed each candidate's probability, in order."""
    cols = [F.col(c) for c in ("prob", "verified", "denied", "clear", "diagnosis", "temperature", "strength", "initial")]
    return evaluated(spark, d).select("scenario_id", "code", F.array_join(sc.probability_notes(*cols), " | ").alias("notes"))


_RANKED = f"""{_SCORED}, latest AS (SELECT f.*, t.turnover * 10000 AS turnover, t.close AS price, t.ret_k AS surge FROM final f ASOF LEFT JOIN feat t ON f.code = t.code AND t.date <= f.eval_date),
    excl AS (SELECT *, CASE WHEN scenario_id % 13 = 0 THEN '売り方向(caution)の候補' WHEN post THEN '監理・整理ポストの銘柄' WHEN coalesce(turnover, 0) < 3e8 THEN '流動性の下限を満たさない' WHEN coalesce(price, 0) < 100 THEN '株価100円未満'
        WHEN coalesce(surge, 0) > 0.5 THEN '直近ですでに急騰している' WHEN low_tier THEN '裏取りの証拠が信頼度3・4の情報源だけ' END AS reason FROM latest),
    placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY eval_date ORDER BY round(confidence, 9) DESC, scenario_id) AS INTEGER) AS rank FROM excl)"""


@query(
    f"""SELECT * FROM (WITH {_RANKED} SELECT scenario_id, code, rank, reason, CASE WHEN reason IS NULL AND sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY eval_date ORDER BY rank) <= 3 THEN '本命' ELSE '監視' END AS tier FROM placed)""",
    NEEDS,
)
def rank_picks_top3(spark, d):
    """FLT7, TOP1: exclusion cascade, ranks by confidence within an evaluation day, the first three without a reason."""
    return _ranked(spark, d).select("scenario_id", "code", "rank", "reason", "tier")


def _ranked(spark, d):
    ev = evaluated(spark, d).withColumn("date", F.col("eval_date"))
    f = ops.daily_features(base.prices(spark, d)).withColumn("state", F.struct("turnover", "close", "ret_k"))
    ev = ops.as_of(ev, f, ["code"], value="state", into="last")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    side = F.when(F.col("scenario_id") % 13 == 0, "caution").otherwise("long")
    reason = sc.exclusion(side, F.col("post"), zero(F.col("last.turnover") * 10000), zero(F.col("last.close")), zero(F.col("last.ret_k")), F.col("low_tier"))
    return state.rank_picks(ev.withColumns({"side": side, "reason": reason}), ["eval_date"], [F.desc(F.round("confidence", 9)), F.asc("scenario_id")])


@query(
    f"""SELECT * FROM (WITH {_RANKED}, overridden AS (SELECT *, CASE WHEN NOT started THEN '待機中(未起動)' WHEN price IS NULL THEN '株価データが無い' ELSE reason END AS reason2 FROM placed)
        SELECT scenario_id, code, rank, reason2 AS reason, CASE WHEN reason2 IS NULL AND sum(CASE WHEN reason2 IS NULL AND scenario_id % 13 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY eval_date ORDER BY rank) <= 3 AND scenario_id % 13 <> 0 THEN '本命' ELSE '監視' END AS tier FROM overridden)""",
    NEEDS,
)
def rank_overrides(spark, d):
    """TOP2, PIP4: reasons of missing prices and of waiting scenarios override the first ones, and the first three by rank
    that are long and have no reason are promoted; ranks stay."""
    out = state.override(_ranked(spark, d), ["eval_date"], F.col("last.close").isNotNull(), ~F.col("started"))
    return out.select("scenario_id", "code", "rank", "reason", "tier")


_PCT = "printf('%.0f%%', round_even(round({} * 100, 6), 0) + 0.0)".format
_SIGNED = "printf('%+.0f%%', round_even(round({} * 100, 6), 0) + 0.0)".format
_CARD = f"""chosen AS (SELECT *, row_number() OVER (PARTITION BY eval_date ORDER BY rank) AS place FROM placed WHERE reason IS NULL QUALIFY place <= 3),
    proof AS (SELECT l_orderkey, string_agg('  - 矢印' || l_linenumber || ' ― ' || status, chr(10) ORDER BY l_linenumber, status) AS plan,
            string_agg(CASE WHEN status = '否定' THEN '- **反証**:矢印' || l_linenumber || '(信頼度' || (l_linenumber % 4 + 1) || ')' END, chr(10) ORDER BY l_linenumber) AS against
        FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN '否定' WHEN l_linestatus = 'F' THEN '確認' ELSE '未確認' END AS status FROM lineitem) GROUP BY 1),
    graded AS (SELECT *, substring('SABC', CAST(scenario_id % 4 + 1 AS INTEGER), 1) AS grade FROM chosen)"""


@query(
    f"""SELECT * FROM (WITH {_RANKED}, {_CARD} SELECT eval_date, CAST(place AS INTEGER) AS place, scenario_id, concat_ws(chr(10),
        '### 本命' || place || '位 ' || n_name || '(' || code || ')  自信度 ' || repeat('★', CASE WHEN confidence >= 0.2 THEN 4 WHEN confidence >= 0.1 THEN 3 WHEN confidence >= 0.05 THEN 2 ELSE 1 END),
        '- **等級**:' || CASE WHEN top IS NULL THEN grade || '(暫定。翌日に確定)' WHEN top < 2 AND grade = 'S' THEN 'A(確定)' WHEN top < 2 AND grade = 'A' THEN 'B(確定)' ELSE grade || '(確定)' END,
        '- **鮮度**:' || CASE WHEN started THEN {_PCT("fresh")} || '(想定期間 ' || expected_days || ' 営業日・残り ' || (expected_days - elapsed) || ' 営業日)' ELSE '待機中' END,
        '- **織り込み度**:' || {_PCT("priced")} || '(超過上昇 ' || coalesce({_SIGNED("excess")}, '―') || ' ÷ 想定上昇幅 ' || {_SIGNED("median")} || ')',
        '- **反応の診断**:' || diagnosis, '- **実現確度**:' || {_PCT("p2")}, CASE WHEN plan IS NOT NULL THEN '- **裏取り**:' END, plan, against) AS card
        FROM graded JOIN nation ON n_nationkey = code LEFT JOIN proof ON l_orderkey = scenario_id)""",
    NEEDS,
)
def pick_cards(spark, d):
    """SNK11, SC26, TOP1: the card of each day's picks, as the report shows it."""
    ranked = _ranked(spark, d).where("tier = '本命'").withColumn("place", F.row_number().over(Window.partitionBy("eval_date").orderBy("rank")))  # at most three a day
    names = F.broadcast(base.read(spark, d, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name")))  # a fixed table of nations
    against = arrows(spark, d).where("supports = 'against'").groupBy("scenario_id").agg(F.sort_array(F.collect_list(F.struct("arrow_no", "source_tier"))).alias("against"))
    told = ranked.withColumns({"prob": F.col("p2"), "stars": sc.stars(F.col("confidence")), "remaining": F.col("expected_days") - F.col("elapsed")}).join(against, "scenario_id", "left").join(names, "code")
    return told.select("eval_date", "place", "scenario_id", report.card().alias("card"))


@query("SELECT scenario_id, code, row_number() OVER (PARTITION BY first_date ORDER BY prob, scenario_id) <= count(*) OVER (PARTITION BY first_date) - 15 AS dormant FROM picks", ("picks",))
def scenario_cap_dormant(spark, d):
    """TOP4: all but the 15 most probable scenarios of a day go dormant."""
    w = Window.partitionBy("first_date")
    place, n = F.row_number().over(w.orderBy("prob", "scenario_id")), F.count("*").over(w)
    return base.picks(spark, d).select("scenario_id", "code", (place <= n - state.ACTIVE).alias("dormant"))


@query(
    f"""SELECT * FROM (WITH {_SCORED} SELECT scenario_id, code, CASE WHEN scenario_id % 37 = 0 THEN 'シナリオが崩れた' WHEN NOT started AND elapsed * 4 >= 60 THEN '起動しなかった' WHEN NOT started THEN NULL WHEN priced >= 0.8 THEN '織り込みが完了した'
        WHEN elapsed > expected_days AND NOT tier1 AND NOT reacted THEN '材料が弱かった' WHEN elapsed > expected_days AND tier1 AND NOT reacted THEN '連想が市場に届かなかった' END AS end_reason,
        array_to_string(list_filter([CASE WHEN scenario_id % 41 = 0 THEN '崩れる条件に当たるニュースが出た' END, CASE WHEN scenario_id % 43 = 0 THEN 'シナリオが弱体化・終了した' END, CASE WHEN priced >= 0.7 THEN '織り込み度が70%以上(完了が近い)' END,
            CASE WHEN expected_days - elapsed <= 2 THEN '想定期間の終わりが近い' END], lambda x: x IS NOT NULL), '|') AS signals FROM final)""",
    NEEDS,
)
def end_rules_and_signals(spark, d):
    """STF5-6: ordered ending rules and the list of sell signals."""
    key, ev = F.col("scenario_id"), evaluated(spark, d)
    end = sc.end_reason(key % 37 == 0, F.col("started"), F.col("elapsed") * 4, F.col("elapsed"), F.col("expected_days"), F.col("tier1"), F.col("reacted"), F.col("priced"))
    signals = sc.sell_signals(key % 41 == 0, key % 43 == 0, F.col("priced"), F.col("expected_days") - F.col("elapsed"))
    return ev.select("scenario_id", "code", end.alias("end_reason"), F.array_join(signals, "|").alias("signals"))


_GRADE = "substring('SABC', CAST(p.scenario_id % 4 + 1 AS INTEGER), 1)"


@query(
    f"""SELECT p.scenario_id, {_GRADE} AS grade, round(max(sigma), 6) AS max_sigma, max(sigma) >= 2 AS reacted,
        CASE WHEN max(sigma) < 2 AND {_GRADE} = 'S' THEN 'A' WHEN max(sigma) < 2 AND {_GRADE} = 'A' THEN 'B' ELSE {_GRADE} END AS final_grade
    FROM picks p LEFT JOIN cal a ON a.d = p.first_date LEFT JOIN cal b ON b.is_bd AND b.bd_seq = a.bd_seq + 1
    LEFT JOIN sig s ON s.code = p.code AND (s.date = p.first_date OR s.date = b.d) GROUP BY p.scenario_id""",
    ("px", "idx", "cal", "bday", "feat", "sig", "picks"),
)
def grade_check(spark, d):
    """STF3-4, AGG12: the largest sigma of the grade's day and the next business day confirms or lowers a grade."""
    cal = calendar.dimension(spark)
    sig = ops.day_sigma(ops.daily_features(base.prices(spark, d)), ops.benchmark_by_day(base.benchmark(spark, d), cal)).select("code", "date", "sigma")
    p = calendar.add_business_days(base.picks(spark, d), "first_date", F.lit(1), "next", cal)
    days = p.select("scenario_id", "code", F.explode(F.array("first_date", "next")).alias("date"))
    top = days.join(sig, ["code", "date"], "left").groupBy("scenario_id").agg(F.max("sigma").alias("s"))
    grade = F.substring(F.lit("SABC"), (F.col("scenario_id") % 4 + 1).cast("int"), F.lit(1))
    reacted = F.col("s") >= sc.REACTION
    return top.select("scenario_id", grade.alias("grade"), F.round("s", 6).alias("max_sigma"), reacted.alias("reacted"), F.coalesce(sc.checked_grade(grade, reacted), grade).alias("final_grade"))


@query(
    f"""SELECT p.scenario_id, b.bd_seq - a.bd_seq AS days_to_earnings, b.bd_seq - a.bd_seq BETWEEN 0 AND p.expected_days AS earnings_warning,
        x.bd_seq - a.bd_seq AS days_to_ex_rights, coalesce(x.bd_seq - a.bd_seq BETWEEN 0 AND p.expected_days, false) AS ex_rights_within_period, round(f.vol, 6) AS daily_vol,
        CAST((SELECT max(w) FROM (VALUES {", ".join(f"({lo}, {w})" for lo, w in ops.LIMIT_BANDS)}) v(lower, w) WHERE f.close >= lower) AS DOUBLE) AS limit_width
    FROM picks p LEFT JOIN cal a ON a.d = p.first_date LEFT JOIN cal b ON b.d = CAST(p.first_date + CAST(p.scenario_id % 61 - 20 AS INTEGER) AS DATE)
    LEFT JOIN cal x ON p.scenario_id % 3 <> 0 AND x.d = CAST(p.first_date + CAST(p.scenario_id % 47 - 10 AS INTEGER) AS DATE)
    ASOF LEFT JOIN feat f ON f.code = p.code AND f.date <= p.first_date""",
    ("px", "cal", "feat", "picks"),
)
def trade_aids(spark, d):
    """SC21: business days to earnings and to the ex-rights day (which a third of the picks don't have), whether they fall inside
    the period, volatility, limit width."""
    cal = calendar.dimension(spark)
    p = base.picks(spark, d).withColumn("earnings", F.expr("date_add(first_date, cast(scenario_id % 61 - 20 as int))")).withColumn("date", F.col("first_date"))
    p = calendar.with_seq(calendar.with_seq(p, "first_date", "a", cal), "earnings", "b", cal).withColumn("n", F.col("b") - F.col("a"))
    ex = F.when(F.col("scenario_id") % 3 != 0, F.expr("date_add(first_date, cast(scenario_id % 47 - 10 as int))"))
    p = calendar.with_seq(p.withColumn("ex_rights", ex), "ex_rights", "x", cal).withColumn("ex", F.col("x") - F.col("a"))
    f = ops.daily_features(base.prices(spark, d)).withColumn("state", F.struct("vol", "close"))
    p = ops.as_of(p, f, ["code"], value="state", into="last")
    return p.select("scenario_id", F.col("n").alias("days_to_earnings"), F.col("n").between(0, F.col("expected_days")).alias("earnings_warning"), F.col("ex").alias("days_to_ex_rights"), F.coalesce(F.col("ex").between(0, F.col("expected_days")), F.lit(False)).alias("ex_rights_within_period"), F.round("last.vol", 6).alias("daily_vol"), ops.price_limit(F.col("last.close")).alias("limit_width"))


@query(
    """SELECT n_name, CAST(count(*) AS BIGINT) AS n, CAST(count_if(status = 'F') AS BIGINT) AS k,
    round(((k::DOUBLE / n + 1.96 * 1.96 / (2 * n)) - 1.96 * sqrt(k::DOUBLE / n * (1 - k::DOUBLE / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 3) AS low,
    round(((k::DOUBLE / n + 1.96 * 1.96 / (2 * n)) + 1.96 * sqrt(k::DOUBLE / n * (1 - k::DOUBLE / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 3) AS high
    FROM picks JOIN nation ON code = n_nationkey GROUP BY n_name""",
    ("picks",),
)
def wilson_interval(spark, d):
    """AGG15: 95 % interval of a rate by group."""
    n = F.broadcast(base.read(spark, d, "nation").select("n_nationkey", "n_name"))  # a fixed table of nations
    g = base.picks(spark, d).join(n, F.col("code") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "F").alias("k"))
    return g.select("n_name", "n", "k", sc.wilson(F.col("k"), F.col("n"), False).alias("low"), sc.wilson(F.col("k"), F.col("n"), True).alias("high"))
