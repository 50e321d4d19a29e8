"""Queries over whole flows: the commit, the nightly transition, ranking overrides, the monthly review."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import calendar
from ..functions import scoring
from ..operators import prices as ops
from ..operators import state
from ..plans import commit as commits
from ..plans import nightly, tracking
from ..shared import cut
from . import base
from .base import query

# The commit: a customer's orders of a month are one night's document, orders its scenarios, lines its candidates and evidence.
_DOCS = """sc AS (SELECT o_custkey * 12 + month(o_orderdate) - 1 AS doc, o_orderkey AS ref, ['単発', '局面展開', '予定日'][o_orderkey % 3 + 1] AS time_type, CAST(o_orderkey % 62 + CASE WHEN o_orderkey % 997 = 0 THEN 0 ELSE 1 END AS INTEGER) AS expected_days,
        o_orderkey % 7 AS low, o_orderkey % 5 AS median, o_orderkey % 3 AS high, o_orderstatus = 'F' AS started FROM orders),
    docs AS (SELECT DISTINCT doc FROM sc),
    ca AS (SELECT o_custkey * 12 + month(o_orderdate) - 1 AS doc, o_orderkey AS ref, l_linenumber AS no, l_suppkey AS code, l_suppkey IN (SELECT s_suppkey FROM supplier) AS known, l_linenumber % 4 <> 0 AND l_suppkey IN (SELECT s_suppkey FROM supplier) AS named FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    ev AS (SELECT o_custkey * 12 + month(o_orderdate) - 1 AS doc, o_orderkey AS ref, l_linenumber AS arrow_no, l_returnflag <> 'R' AS supports, l_linenumber % 4 + 1 AS tier FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    broken AS (SELECT doc, 'expected_days' AS error FROM sc WHERE NOT expected_days BETWEEN 1 AND 60 UNION SELECT doc, 'n_candidates' FROM sc LEFT JOIN ca USING (doc, ref) GROUP BY doc, ref HAVING NOT count(no) BETWEEN 1 AND 5),
    errors AS (SELECT doc, string_agg(error, ',' ORDER BY error) AS error FROM broken GROUP BY doc),
    refused AS (SELECT doc, error FROM errors UNION SELECT doc, 'committed before' FROM docs WHERE doc % 13 = 0 AND doc NOT IN (SELECT doc FROM errors)),
    ids AS (SELECT doc, ref, 'SC' || lpad(CAST(n AS VARCHAR), CAST(greatest(4, length(CAST(n AS VARCHAR))) AS INTEGER), '0') AS id FROM (
        SELECT doc, ref, row_number() OVER (ORDER BY doc, ref) + 40 AS n FROM sc WHERE doc NOT IN (SELECT doc FROM refused)))"""


def _committed(spark, d):
    """What the commit of all documents writes."""
    o, li = base.read(spark, d, "orders"), base.read(spark, d, "lineitem")
    k, no = F.col("o_orderkey"), F.col("l_linenumber")
    doc = (F.col("o_custkey") * 12 + F.month("o_orderdate") - 1).alias("doc")
    lines = li.join(o.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == k)
    span = (k % 62 + F.when(k % 997 == 0, 0).otherwise(1)).cast("int")
    scenarios = o.select(
        doc, k.alias("ref"), F.element_at(F.array(*map(F.lit, ["単発", "局面展開", "予定日"])), (k % 3 + 1).cast("int")).alias("time_type"), span.alias("expected_days"),
        (k % 7).alias("low"), (k % 5).alias("median"), (k % 3).alias("high"), (F.col("o_orderstatus") == "F").alias("started"),
    )
    digits = lambda c: F.lpad(F.col(c).cast("string"), 19, "0")  # noqa: E731  # whole keys, in the order of their numbers
    code = digits("l_suppkey")
    s = base.read(spark, d, "supplier").select(digits("s_suppkey").alias("code"), F.col("s_name").alias("master_name"))
    candidates = lines.join(s.select(F.col("code").alias("__c"), "master_name"), F.col("__c") == code, "left").select(
        doc, k.alias("ref"), no.alias("no"), code.alias("code"), F.coalesce(F.when(no % 4 != 0, F.concat(F.lit("株式会社 "), "master_name")), F.lit("other")).alias("company_name"),
        F.lit(0.5).alias("realization_prob"), F.lit(1).alias("stage"), F.lit("long").alias("side"),
    )
    name = k.cast("string").alias("scenario")
    evidence = lines.select(doc, name, no.alias("arrow_no"), F.when(F.col("l_returnflag") != "R", "for").otherwise("against").alias("supports"), (no % 4 + 1).alias("source_tier"))
    statuses = lines.select(doc, name, no.alias("arrow_no"), F.lit("確認").alias("status"))
    updates = o.select(doc, F.format_string("SC%04d", k % 50).alias("scenario_id"), k.cast("string").alias("change"))
    documents = scenarios.select("doc").distinct()
    known = commits.Known(documents.where("doc % 13 = 0"), spark.range(1, 41).select(F.format_string("SC%04d", "id").alias("scenario_id")), spark.createDataFrame([], "scenario_id string, arrow_no int"))
    aliases = spark.createDataFrame([], "alias string, code string")
    grade = F.element_at(F.array(*map(F.lit, ["S", "A", "B", "C"])), (k % 4 + 1).cast("int"))
    more = {"grade": o.select(doc, k.alias("event_id"), grade.alias("provisional_grade")), "theme_temperature": o.where("o_orderkey % 9 = 0").select(doc, (k % 20).alias("theme_id"), F.lit("上昇中").alias("temperature"))}
    return commits.commit(documents, scenarios, candidates, evidence, statuses, updates, known, s, aliases, 40, more=more, code_form="^[0-9]{19}$", shown_code=F.lpad(F.col("code").cast("long").cast("string"), 4, "0"))


@query(
    f"""WITH {_DOCS}
    SELECT 'commit_rejection' AS kind, CAST(doc AS VARCHAR) AS name, error AS detail FROM refused
    UNION ALL SELECT 'scenario', id, CAST(CASE WHEN time_type = '単発' THEN least(greatest(expected_days, 5), 20) ELSE expected_days END AS VARCHAR) || '|' || list_sort([low, median, high])[1] || '|' || list_sort([low, median, high])[2] || '|' ||
        list_sort([low, median, high])[3] || '|' || CASE WHEN started THEN '進行中' ELSE '待機' END FROM sc JOIN ids USING (doc, ref)
    UNION ALL SELECT 'candidate', id || '-' || row_number() OVER (PARTITION BY id ORDER BY no, code), CAST(code AS VARCHAR) FROM ca JOIN ids USING (doc, ref) WHERE named
    UNION ALL SELECT 'rejected_candidate', id, CAST(code AS VARCHAR) || CASE WHEN known THEN '|name differs' ELSE '|unknown code' END FROM ca JOIN ids USING (doc, ref) WHERE NOT named
    UNION ALL SELECT 'evidence', id, CAST(arrow_no AS VARCHAR) || '|' || tier FROM ev JOIN ids USING (doc, ref)
    UNION ALL SELECT 'check_plan', id, CAST(arrow_no AS VARCHAR) || '|' || CASE WHEN bool_or(supports AND tier <= 2) OVER (PARTITION BY id, arrow_no) THEN '確認' ELSE '未確認' END FROM ev JOIN ids USING (doc, ref)
    UNION ALL SELECT 'grade', CAST(o_orderkey AS VARCHAR), ['S', 'A', 'B', 'C'][o_orderkey % 4 + 1] FROM orders WHERE o_custkey * 12 + month(o_orderdate) - 1 NOT IN (SELECT doc FROM refused)
    UNION ALL SELECT 'theme_temperature', CAST(o_orderkey % 20 AS VARCHAR), '上昇中' FROM orders WHERE o_orderkey % 9 = 0 AND o_custkey * 12 + month(o_orderdate) - 1 NOT IN (SELECT doc FROM refused)
    UNION ALL SELECT 'scenario_update', 'SC' || lpad(CAST(o_orderkey % 50 AS VARCHAR), 4, '0'), CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_custkey * 12 + month(o_orderdate) - 1 NOT IN (SELECT doc FROM refused) AND o_orderkey % 50 BETWEEN 1 AND 40"""
)
def commit_kinds(spark, d):
    """VAL1-2, STF10, FLT10, SC22-23, JN22: rows of each record kind that the commit of all documents writes."""
    out = _committed(spark, d)
    join = lambda *cs: F.concat_ws("|", *[F.col(c).cast("string") for c in cs])
    shape = {
        "commit_rejection": ("doc", F.array_join("errors", ",")), "scenario": ("scenario_id", join("expected_days", "low", "median", "high", "status")),
        "candidate": ("candidate_id", F.col("code").cast("long").cast("string")), "rejected_candidate": ("scenario_id", F.concat_ws("|", F.col("code").cast("long"), "reason")),
        "evidence": ("scenario_id", join("arrow_no", "source_tier")), "check_plan": ("scenario_id", join("arrow_no", "status")), "scenario_update": ("scenario_id", F.col("change")),
        "grade": ("event_id", F.col("provisional_grade")), "theme_temperature": ("theme_id", F.col("temperature")),
    }
    rows = [out[kind].select(F.lit(kind).alias("kind"), F.col(n).cast("string").alias("name"), detail.alias("detail")) for kind, (n, detail) in shape.items()]
    whole = rows[0]
    for r in rows[1:]:
        whole = whole.unionByName(r)
    return whole


@query(
    f"""WITH {_DOCS}
    SELECT doc, id || ': 想定上昇幅の下限・中央・上限の順序が不正のため、並べ替えて記録' AS text FROM sc JOIN ids USING (doc, ref) WHERE NOT (low <= median AND median <= high)
    UNION ALL SELECT doc, id || ': 単発型の想定期間 ' || expected_days || ' を ' || least(greatest(expected_days, 5), 20) || ' 営業日に補正' FROM sc JOIN ids USING (doc, ref) WHERE time_type = '単発' AND expected_days NOT BETWEEN 5 AND 20
    UNION ALL SELECT doc, id || ': 候補 ' || lpad(CAST(code AS VARCHAR), 4, '0') || ' ' || CASE WHEN known AND no % 4 <> 0 THEN '株式会社 ' || s_name ELSE 'other' END || ' を確定しない(' || CASE WHEN known THEN 'name differs' ELSE 'unknown code' END || ')'
        FROM ca JOIN ids USING (doc, ref) LEFT JOIN supplier ON s_suppkey = code WHERE NOT named
    UNION ALL SELECT doc, id || ': 確定できる候補が無いため、候補なしのシナリオとして記録' FROM ids WHERE NOT EXISTS (SELECT 1 FROM ca WHERE ca.doc = ids.doc AND ca.ref = ids.ref AND named)
    UNION ALL SELECT o_custkey * 12 + month(o_orderdate) - 1, '更新先のシナリオ SC' || lpad(CAST(o_orderkey % 50 AS VARCHAR), 4, '0') || ' が存在しないため、記録しない' FROM orders
        WHERE o_custkey * 12 + month(o_orderdate) - 1 NOT IN (SELECT doc FROM refused) AND NOT o_orderkey % 50 BETWEEN 1 AND 40
    UNION ALL SELECT doc, id || ' 矢印' || arrow_no || ': 信頼度1・2の証拠が無いため「未確認」に修正' FROM (
        SELECT *, bool_or(supports AND tier <= 2) OVER (PARTITION BY id, arrow_no) AS strong FROM ev JOIN ids USING (doc, ref)) WHERE NOT strong"""
)
def commit_warnings(spark, d):
    """VAL2: what the commit mended in the documents it took or left out of them, and why."""
    return _committed(spark, d)["warning"]


# The nightly transition on one day: all picks up to it, each a scenario of one candidate.
DAY = "1998-03-03"
for _name in ("px", "idx"):
    base.CTE[f"{_name}_day"] = base.CTE[_name].replace(f"{_name} AS (", f"{_name} AS (SELECT * FROM (", 1) + f" WHERE date <= DATE '{DAY}')"

_NIGHT = f"""night AS (SELECT p.*, s.bd_seq AS s0, n.bd_seq AS s1, x.d AS next_day, CAST(p.scenario_id % 3 + 1 AS INTEGER) AS stage, p.scenario_id % 7 <> 0 AS started,
        substring('SABC', CAST(p.scenario_id % 4 + 1 AS INTEGER), 1) AS grade, p.scenario_id % 10 = 0 AS unchecked
        FROM picks p JOIN cal s ON s.d = first_date JOIN cal n ON n.d = DATE '{DAY}' JOIN cal x ON x.is_bd AND x.bd_seq = s.bd_seq + 1 WHERE first_date <= DATE '{DAY}'),
    asof_night AS (SELECT n.*, n.s1 - n.s0 AS elapsed, (c1.close / c0.close - 1) - (b1.b_on / b0.b_before - 1) AS excess
        FROM night n ASOF LEFT JOIN px c0 ON n.code = c0.code AND c0.date < n.first_date LEFT JOIN (SELECT code, arg_max(close, date) AS close FROM px GROUP BY code) c1 ON c1.code = n.code
        LEFT JOIN bday b0 ON b0.b_date = n.first_date LEFT JOIN bday b1 ON b1.b_date = DATE '{DAY}'),
    told AS (SELECT a.*, EXISTS (SELECT 1 FROM sig WHERE sig.code = a.code AND sigma >= 2 AND date >= a.first_date) AS hit, CASE WHEN started THEN coalesce(greatest(0, excess / median), 0) ELSE 0 END AS priced FROM asof_night a),
    ends AS (SELECT *, CASE WHEN NOT started AND elapsed >= 60 THEN '起動しなかった' WHEN NOT started THEN NULL WHEN priced >= 0.8 THEN '織り込みが完了した'
        WHEN elapsed > expected_days AND NOT hit THEN '材料が弱かった' WHEN elapsed > expected_days AND hit AND stage < 2 THEN '連想が市場に届かなかった' END AS end_reason,
        prob * median * greatest(0, 1 - priced) * CASE WHEN started THEN greatest(0, 1 - elapsed / expected_days) ELSE 1 END AS confidence FROM told),
    capped AS (SELECT *, end_reason IS NULL AND row_number() OVER (PARTITION BY end_reason IS NULL ORDER BY round(confidence, 9), scenario_id) <= count(*) OVER (PARTITION BY end_reason IS NULL) - 15 AS dormant FROM ends),
    signed AS (SELECT c.*, array_to_string(list_filter([CASE WHEN end_reason IN ('材料が弱かった', '連想が市場に届かなかった') OR end_reason IS NOT NULL AND priced < 0.7 THEN 'シナリオが弱体化・終了した' END,
        CASE WHEN priced >= 0.7 THEN '織り込み度が70%以上(完了が近い)' END, CASE WHEN started AND end_reason IS NULL AND NOT dormant AND expected_days - elapsed <= 2 THEN '想定期間の終わりが近い' END], lambda x: x IS NOT NULL), '|') AS signals FROM capped c),
    last_px AS (SELECT code, max(date) AS last FROM px GROUP BY code),
    sigmas AS (SELECT n.scenario_id, max(sigma) AS s FROM night n JOIN sig ON sig.code = n.code AND sig.date IN (n.first_date, n.next_day) GROUP BY 1),
    graded AS (SELECT n.scenario_id, CASE WHEN NOT unchecked AND last IS NOT NULL AND least(last, (SELECT max(date) FROM idx)) < next_day THEN 'waiting' WHEN unchecked OR last IS NULL OR s IS NULL THEN grade || '|unchecked'
        WHEN s < 2 AND grade = 'S' THEN 'A|lowered' WHEN s < 2 AND grade = 'A' THEN 'B|lowered' WHEN s >= 2 AND grade IN ('B', 'C') THEN grade || '|overlooked' ELSE grade || '|kept' END AS verdict
        FROM night n LEFT JOIN last_px USING (code) LEFT JOIN sigmas USING (scenario_id) WHERE first_date < DATE '{DAY}' AND next_day <= DATE '{DAY}'),
    night_rows AS (SELECT 'grade_final' AS kind, scenario_id, verdict AS detail FROM graded
        UNION ALL SELECT 'ended', scenario_id, end_reason FROM ends WHERE end_reason IS NOT NULL
        UNION ALL SELECT 'dormant', scenario_id, 'over the cap' FROM capped WHERE dormant
        UNION ALL SELECT 'moved', m.scenario_id, strftime(moved_at, '%Y-%m-%d') FROM moves m JOIN night n USING (scenario_id) WHERE m.moved AND n.first_date < DATE '{DAY}'
        UNION ALL SELECT 'sell_signal', scenario_id, signals FROM signed WHERE signals <> '' AND s1 - s0 <= 60)"""
NIGHT = ("px_day", "idx_day", "cal", "bday", "feat", "sig", "picks", "moved")


def _night(spark, d):
    cal = calendar.dimension(spark)
    before = F.col("date") <= F.lit(DAY).cast("date")
    prices, index = cut(base.prices(spark, d).where(before)), cut(base.benchmark(spark, d).where(before))
    by_day = cut(ops.benchmark_by_day(index, cal))
    sigma = cut(ops.day_sigma(ops.daily_features(prices), by_day).select("code", "date", "sigma"))
    k = F.col("scenario_id")
    night = base.picks(spark, d).where(F.col("first_date") <= F.lit(DAY).cast("date")).withColumns(
        {"stage": (k % 3 + 1).cast("int"), "started": k % 7 != 0, "grade": F.substring(F.lit("SABC"), (k % 4 + 1).cast("int"), F.lit(1)), "unchecked": k % 10 == 0, "day": F.lit(DAY).cast("date")}
    )
    return nightly.transition(night, prices, index, sigma, by_day, cal)


@query(f"SELECT * FROM (WITH {_NIGHT} SELECT kind, scenario_id, detail FROM night_rows)", NIGHT)
def nextday_transition(spark, d):
    """PIP5, STF3-4, TOP4, JN15, JN24: what one night writes, in order: final grades (or waiting), endings,
    scenarios beyond the cap, moves, sell signals."""
    return _night(spark, d)


@query(f"SELECT * FROM (WITH {_NIGHT} SELECT CASE WHEN detail = 'waiting' THEN 'grade_waiting' ELSE kind END AS counter, count(*) AS n FROM night_rows GROUP BY 1)", NIGHT)
def nextday_counts(spark, d):
    """AGG24: the night's counters."""
    kind = F.when(F.col("detail") == "waiting", "grade_waiting").otherwise(F.col("kind"))
    return _night(spark, d).groupBy(kind.alias("counter")).agg(F.count("*").alias("n"))


_NEWS = f"SELECT l_orderkey AS scenario_id, CASE l_returnflag WHEN 'N' THEN '強化' WHEN 'A' THEN '弱体化' ELSE '消滅' END AS type, ['Weak', 'Weak+', 'Medium', 'Strong'][l_linenumber % 4 + 1] AS strength_after FROM lineitem WHERE CAST(l_shipdate AS DATE) = DATE '{DAY}'"


@query(
    f"""SELECT * FROM (WITH {_NIGHT}, news AS ({_NEWS})
    SELECT 'new' AS section, CAST(o_orderkey AS VARCHAR) AS subject, CASE WHEN o_orderstatus = 'F' THEN '進行中' ELSE '待機' END || '|' || ['単発', '局面展開', '予定日'][o_orderkey % 3 + 1] AS detail FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '{DAY}'
    UNION ALL SELECT 'update', CAST(scenario_id AS VARCHAR), type || '|' || strength_after FROM news
    UNION ALL SELECT 'ended', CAST(scenario_id AS VARCHAR), detail FROM night_rows WHERE kind = 'ended'
    UNION ALL SELECT 'ended', CAST(scenario_id AS VARCHAR), 'シナリオが崩れた(消滅)' FROM news JOIN orders ON o_orderkey = scenario_id WHERE type = '消滅'
    UNION ALL SELECT 'signal', CAST(scenario_id AS VARCHAR), detail FROM night_rows WHERE kind = 'sell_signal'
    UNION ALL SELECT 'warning', CAST(user_id AS VARCHAR), 'failed three times in a row' FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
        WHERE r <= 3 GROUP BY user_id HAVING count(*) = 3 AND bool_and(value < 60))""",
    NIGHT,
)
def day_context(spark, d):
    """PIP6: what the day's report tells: new scenarios, updates, endings and signals of the night, sources that fail."""
    from ..plans import context
    from .records import consecutive_failures

    k, no, today = F.col("o_orderkey"), F.col("l_linenumber"), F.lit(DAY).cast("date").alias("day")
    night = cut(_night(spark, d).where("kind in ('ended', 'sell_signal')"))
    kind = F.element_at(F.array(*map(F.lit, ["単発", "局面展開", "予定日"])), (k % 3 + 1).cast("int"))
    scenarios = base.read(spark, d, "orders").select(k.alias("scenario_id"), F.to_date("o_orderdate").alias("created"), F.when(F.col("o_orderstatus") == "F", "進行中").otherwise("待機").alias("status"), kind.alias("time_type"))
    change = F.when(F.col("l_returnflag") == "N", "強化").when(F.col("l_returnflag") == "A", tracking.WEAKENING).otherwise(tracking.BREAKING)
    strength = F.element_at(F.array(*map(F.lit, scoring.STRENGTHS)), no % 4 + 1)
    updates = base.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("scenario_id"), F.to_date("l_shipdate").alias("day"), change.alias("type"), strength.alias("strength_after"))
    statuses = night.where("kind = 'ended'").select("scenario_id", today, F.lit(tracking.ENDED).alias("status"), F.col("detail").alias("reason"))
    signals = night.where("kind = 'sell_signal'").select("scenario_id", today, F.col("detail").alias("signals"))
    return context.day_context(DAY, scenarios, updates, statuses, signals, consecutive_failures(spark, d).withColumnRenamed("user_id", "source"))


# Two nights in a row; on the second the feed of some codes gives nothing.
NIGHTS = ("1998-03-03", "1998-03-04")
for _name in ("px", "idx"):
    base.CTE[f"{_name}_last"] = base.CTE[_name].replace(f"{_name} AS (", f"{_name} AS (SELECT * FROM (", 1) + f" WHERE date <= DATE '{NIGHTS[1]}')"


def _night_sql(n: int) -> str:
    """A night's tables after those of the night before (n - 1)."""
    b = n - 1
    return f"""fed{n} AS (SELECT * FROM px WHERE date <= DATE '{NIGHTS[b]}' AND NOT ({n} = 2 AND code % 6 = 1)),
    ev{n} AS (SELECT p.scenario_id, p.code, p.first_date, p.expected_days, p.median, p.prob, CAST(p.scenario_id % 3 + 1 AS INTEGER) AS stage, p.scenario_id % 7 <> 0 AS started, t.bd_seq - s.bd_seq AS elapsed,
        (c1.close / c0.close - 1) - (b1.b_on / b0.b_before - 1) AS excess, o.status AS old_status, o.reason AS old_reason, l.priced AS last_priced, coalesce(w.weakened, false) AS weakened, coalesce(w.broken, false) AS broken,
        EXISTS (SELECT 1 FROM sig g WHERE g.code = p.code AND sigma >= 2 AND g.date BETWEEN p.first_date AND DATE '{NIGHTS[b]}' AND NOT ({n} = 2 AND p.code % 6 = 1)) AS hit
        FROM picks p JOIN cal s ON s.d = p.first_date JOIN cal t ON t.d = DATE '{NIGHTS[b]}'
        ASOF LEFT JOIN fed{n} c0 ON p.code = c0.code AND c0.date < p.first_date LEFT JOIN (SELECT code, arg_max(close, date) AS close FROM fed{n} GROUP BY code) c1 ON c1.code = p.code
        LEFT JOIN bday b0 ON b0.b_date = p.first_date LEFT JOIN bday b1 ON b1.b_date = DATE '{NIGHTS[b]}' LEFT JOIN status{b} o USING (scenario_id) LEFT JOIN snap{b} l USING (scenario_id)
        LEFT JOIN (SELECT scenario_id, bool_or(type IN ('弱体化', '消滅')) AS weakened, bool_or(type = '消滅') AS broken FROM upd WHERE night <= {n} GROUP BY 1) w USING (scenario_id)
        WHERE p.first_date <= DATE '{NIGHTS[b]}'),
    told{n} AS (SELECT *, NOT started OR excess IS NOT NULL AS seen, CASE WHEN NOT started THEN 0 WHEN excess IS NOT NULL THEN greatest(0, excess / median) ELSE coalesce(last_priced, 0) END AS priced FROM ev{n}),
    ends{n} AS (SELECT *, CASE WHEN broken THEN 'シナリオが崩れた' WHEN NOT started AND elapsed >= 60 THEN '起動しなかった' WHEN NOT started THEN NULL WHEN priced >= 0.8 THEN '織り込みが完了した'
        WHEN elapsed > expected_days AND NOT hit THEN '材料が弱かった' WHEN elapsed > expected_days AND hit AND stage < 2 THEN '連想が市場に届かなかった' END AS end_reason,
        round(prob * median * greatest(0, 1 - priced) * CASE WHEN started THEN greatest(0, 1 - elapsed / expected_days) ELSE 1 END, 9) AS confidence FROM told{n} WHERE old_status IS NULL),
    open{n} AS (SELECT *, row_number() OVER (ORDER BY confidence, scenario_id) <= count(*) OVER () - 15 AS dormant FROM ends{n} WHERE end_reason IS NULL),
    new_status{n} AS (SELECT scenario_id, '終了' AS status, end_reason AS reason FROM ends{n} WHERE end_reason IS NOT NULL UNION ALL SELECT scenario_id, '休眠', NULL FROM open{n} WHERE dormant),
    status{n} AS (SELECT * FROM new_status{n} UNION ALL SELECT * FROM status{b}),
    new_snap{n} AS (SELECT scenario_id, priced FROM open{n} WHERE NOT dormant AND seen),
    snap{n} AS (SELECT * FROM new_snap{n} UNION ALL SELECT * FROM snap{b} ANTI JOIN new_snap{n} USING (scenario_id)),
    sg{n} AS (SELECT scenario_id, elapsed, array_to_string(list_filter([
            CASE WHEN weakened OR coalesce(reason IN ('材料が弱かった', '連想が市場に届かなかった', 'シナリオが崩れた'), false) OR reason IS NOT NULL AND priced < 0.7 THEN 'シナリオが弱体化・終了した' END,
            CASE WHEN priced >= 0.7 THEN '織り込み度が70%以上(完了が近い)' END, CASE WHEN active AND seen AND started AND expected_days - elapsed <= 2 THEN '想定期間の終わりが近い' END], lambda x: x IS NOT NULL), '|') AS signals
        FROM (SELECT t.*, coalesce(e.end_reason, CASE WHEN t.old_status = '終了' THEN t.old_reason END) AS reason, coalesce(NOT q.dormant, false) AS active
            FROM told{n} t LEFT JOIN ends{n} e USING (scenario_id) LEFT JOIN open{n} q USING (scenario_id))),
    new_sig{n} AS (SELECT scenario_id, signals FROM sg{n} LEFT JOIN (SELECT scenario_id, signals AS before FROM signal{b}) USING (scenario_id) WHERE signals <> '' AND elapsed <= 60 AND signals IS DISTINCT FROM before),
    signal{n} AS (SELECT * FROM new_sig{n} UNION ALL SELECT * FROM signal{b} ANTI JOIN new_sig{n} USING (scenario_id)),
    new_move{n} AS (SELECT h.scenario_id, min(CASE WHEN excess >= 0.05 THEN day END) AS moved_at FROM hits h JOIN picks p USING (scenario_id)
        WHERE day <= DATE '{NIGHTS[b]}' AND p.first_date < DATE '{NIGHTS[b]}' AND NOT ({n} = 2 AND h.code % 6 = 1) AND h.scenario_id NOT IN (SELECT scenario_id FROM move{b}) GROUP BY 1 HAVING bool_or(excess >= 0.10)),
    move{n} AS (SELECT scenario_id FROM new_move{n} UNION ALL SELECT scenario_id FROM move{b}),
    rows{n} AS (SELECT '{NIGHTS[b]}' AS night, status AS kind, scenario_id, coalesce(reason, '') AS detail FROM new_status{n}
        UNION ALL SELECT '{NIGHTS[b]}', 'snapshot', scenario_id, CAST(CAST(round(priced * 1000000) AS BIGINT) AS VARCHAR) FROM new_snap{n} UNION ALL SELECT '{NIGHTS[b]}', 'sell_signal', scenario_id, signals FROM new_sig{n}
        UNION ALL SELECT '{NIGHTS[b]}', 'moved', scenario_id, strftime(moved_at, '%Y-%m-%d') FROM new_move{n}
        UNION ALL SELECT '{NIGHTS[b]}', 'picked', scenario_id, strftime(first_date, '%Y-%m-%d') FROM picks WHERE first_date <= DATE '{NIGHTS[b]}' AND first_date >= DATE '{NIGHTS[0]}' AND ({n} = 1 OR first_date > DATE '{NIGHTS[0]}'))"""


_TWO = f"""upd AS (SELECT scenario_id, scenario_id % 4 + 1 AS night, CASE WHEN priority = '5-LOW' THEN '弱体化' WHEN priority = '4-NOT SPECIFIED' THEN '消滅' ELSE '強化' END AS type FROM picks),
    status0 AS (SELECT scenario_id, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS reason FROM picks WHERE false), signal0 AS (SELECT scenario_id, '' AS signals FROM picks WHERE false),
    move0 AS (SELECT scenario_id FROM picks WHERE false), snap0 AS (SELECT scenario_id, scenario_id % 100 / 100.0::DOUBLE AS priced FROM picks WHERE scenario_id % 2 = 0 AND first_date < DATE '{NIGHTS[0]}'),
    {_night_sql(1)}, {_night_sql(2)}"""


@query(f"SELECT * FROM (WITH {_TWO} SELECT * FROM rows1 UNION ALL SELECT * FROM rows2)", ("px_last", "idx_last", "cal", "bday", "feat", "sig", "picks", "moved"))
def two_nights(spark, d):
    """STF7-9, PIP4-5, JN17: what two nights in a row write to the tables of snapshots, tracking and statuses. Before the first,
    all earlier picks are tracked and half of them have a snapshot. The second night ends only what the first left open, repeats
    no signal, move or pick, and takes the last snapshot for codes whose feed gives nothing."""
    cal, k = calendar.dimension(spark), F.col("scenario_id")
    first, second = (F.lit(n).cast("date") for n in NIGHTS)
    prices = cut(base.prices(spark, d).where(F.col("date") <= second))
    by_day = cut(ops.benchmark_by_day(base.benchmark(spark, d).where(F.col("date") <= second), cal))
    sigma = cut(ops.day_sigma(ops.daily_features(prices), by_day).select("code", "date", "sigma"))
    picks = cut(base.picks(spark, d).where(F.col("first_date") <= second).withColumns({"stage": (k % 3 + 1).cast("int"), "started": k % 7 != 0}))
    kind = F.when(F.col("priority") == "5-LOW", tracking.WEAKENING).when(F.col("priority") == "4-NOT SPECIFIED", tracking.BREAKING).otherwise("強化")
    updates = picks.select("scenario_id", (k % 4 + 1).alias("n"), kind.alias("type"))
    past, earlier = F.date_sub(first, 1).alias("night"), picks.where(F.col("first_date") < first)
    kept = tracking.Kept(
        earlier.where(k % 2 == 0).select(past, "scenario_id", "code", (k % 100 / F.lit(100.0)).alias("priced")),
        earlier.select(past, "scenario_id", "code", F.lit("picked").alias("event"), F.date_format("first_date", "yyyy-MM-dd").alias("detail")),
        earlier.where(F.lit(False)).select(past, "scenario_id", F.lit("").alias("status"), F.lit("").alias("reason")),
    )
    new = []
    for n, (day, fed) in enumerate(zip(NIGHTS, (F.lit(True), F.col("code") % 6 != 1), strict=True), 1):
        up_to = lambda c, day=day: F.col(c) <= F.lit(day).cast("date")
        new.append(tracking.night(day, picks.where(up_to("first_date")), updates.where(F.col("n") <= n), prices.where(up_to("date") & fed), sigma.where(up_to("date") & fed), by_day, cal, kept))
        kept = kept.plus(new[-1])
    row = lambda t, kind, detail: t.select(F.date_format("night", "yyyy-MM-dd").alias("night"), kind.alias("kind"), "scenario_id", detail.alias("detail"))
    parts = []
    for t in new:
        parts += [
            row(t.statuses, F.col("status"), F.coalesce("reason", F.lit(""))), row(t.tracking, F.col("event"), F.col("detail")),
            row(t.snapshots, F.lit("snapshot"), F.round(F.col("priced") * 1000000).cast("long").cast("string")),
        ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    """SELECT s.scenario_id, s.code, coalesce(max(g.date) >= s.first_date, false) AS reacted FROM picks s
    LEFT JOIN sig g ON g.code = s.code AND g.sigma >= 2 AND g.date <= CAST(s.first_date + s.expected_days AS DATE) GROUP BY s.scenario_id, s.code, s.first_date""",
    ("px", "idx", "cal", "bday", "feat", "sig", "picks"),
)
def reacted_since(spark, d):
    """WIN5: whether a candidate's code reacted on any day from the pick to the end of its expected days."""
    by_day = ops.benchmark_by_day(base.benchmark(spark, d), calendar.dimension(spark))
    sigma = ops.day_sigma(ops.daily_features(base.prices(spark, d)), by_day)
    p = base.picks(spark, d).withColumn("until", F.expr("date_add(first_date, expected_days)"))
    return nightly.reacted(p, sigma, "first_date", "until", "reacted").select("scenario_id", "code", "reacted")


# The monthly review. Four orders are one scenario; stages, decisions and the excess at the pick come with each pick.
TODAY = "1998-08-03"
_REVIEW = f"""judged AS (SELECT m.*, date_trunc('month', m.first_date)::DATE AS month, m.scenario_id // 4 AS scenario, m.scenario_id % 3 + 1 AS stage, x.excess AS at_pick, ['買う', '監視', '見送り', NULL][m.scenario_id % 4 + 1] AS action,
        m.moved OR t.bd_seq - f.bd_seq > least(m.expected_days, 20) AS closed
        FROM moves m LEFT JOIN (SELECT s.scenario_id, (c1.close / c0.close - 1) - (b1.b_on / b0.b_before - 1) AS excess FROM (SELECT *, CAST(first_date - 10 AS DATE) AS before FROM picks) s
            ASOF LEFT JOIN px c0 ON s.code = c0.code AND c0.date < s.before ASOF LEFT JOIN px c1 ON s.code = c1.code AND c1.date <= s.first_date
            LEFT JOIN bday b0 ON b0.b_date = s.before LEFT JOIN bday b1 ON b1.b_date = s.first_date) x USING (scenario_id)
        LEFT JOIN cal f ON f.d = m.first_date LEFT JOIN cal t ON t.d = DATE '{TODAY}'),
    by_scenario AS (SELECT month, scenario, bool_or(moved) AS hit FROM judged WHERE closed GROUP BY 1, 2),
    scenarios AS (SELECT month, count(*) AS n, count_if(hit) AS k FROM by_scenario GROUP BY 1),
    stocks AS (SELECT month, CAST(count_if(coalesce(closed, false)) AS BIGINT) AS picks, CAST(count_if(NOT coalesce(closed, false)) AS BIGINT) AS pending, round(avg(moved::INT) FILTER (WHERE closed), 3) AS hit_rate_by_stock,
        round(avg(moved::INT) FILTER (WHERE closed AND stage = 1), 3) AS stage1_hit_rate, round(avg((at_pick < 0.05)::INT) FILTER (WHERE closed AND moved AND at_pick IS NOT NULL), 3) AS lead_rate,
        count(*) FILTER (WHERE closed AND action = '買う') AS bought, round(avg(moved::INT) FILTER (WHERE closed AND action = '買う'), 3) AS bought_hit_rate,
        count(*) FILTER (WHERE closed AND action IN ('監視', '見送り')) AS passed, round(avg(moved::INT) FILTER (WHERE closed AND action IN ('監視', '見送り')), 3) AS passed_hit_rate FROM judged GROUP BY 1)"""


@query(
    f"""SELECT * FROM (WITH {_REVIEW} SELECT st.*, sc.n AS scenarios, round(sc.k / sc.n, 3) AS hit_rate_by_scenario,
        round(((k::DOUBLE / n + 1.96 * 1.96 / (2 * n)) - 1.96 * sqrt(k::DOUBLE / n * (1 - k::DOUBLE / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 3) AS low,
        round(((k::DOUBLE / n + 1.96 * 1.96 / (2 * n)) + 1.96 * sqrt(k::DOUBLE / n * (1 - k::DOUBLE / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 3) AS high
        FROM stocks st LEFT JOIN scenarios sc USING (month))""",
    ("px", "idx", "cal", "bday", "picks", "moved"),
)
def monthly_review(spark, d):
    """AGG14-15, JN16, SC25, SNK13: rates of judged picks by month: by stock, by scenario with its interval, first stage,
    lead, bought and passed; picks whose window is still open are pending."""
    from ..plans import review

    cal = calendar.dimension(spark)
    prices, by_day, k = cut(base.prices(spark, d)), cut(ops.benchmark_by_day(base.benchmark(spark, d), cal)), F.col("scenario_id")
    picks = base.picks(spark, d).select("scenario_id", "code", "first_date", "expected_days")
    moved = ops.moved(picks, prices, by_day, cal)
    moved = ops.excess_return(moved.withColumn("before", F.date_sub("first_date", 10)), prices, by_day, "before", "first_date").withColumnRenamed("excess", "at_pick")
    action = F.element_at(F.array(F.lit("買う"), F.lit("監視"), F.lit("見送り"), F.lit(None)), (k % 4 + 1).cast("int"))
    log = picks.select("scenario_id", "code", F.lit("見送り").alias("action"), F.lit(1).alias("_seq")).unionByName(picks.select("scenario_id", "code", action.alias("action"), F.lit(2).alias("_seq")))
    told = moved.withColumns({"scenario": F.floor(k / 4), "stage": k % 3 + 1})
    return review.metrics(told, log, F.lit(TODAY).cast("date"), cal)


@query(
    f"""SELECT date_trunc('month', m.first_date)::DATE AS month, m.scenario_id, m.code, coalesce(plan, '') AS plan FROM moves m JOIN cal f ON f.d = m.first_date JOIN cal t ON t.d = DATE '{TODAY}'
    LEFT JOIN (SELECT l_orderkey, string_agg(l_linenumber || ':' || CASE WHEN l_returnflag = 'R' THEN '否定' WHEN l_linestatus = 'F' THEN '確認' ELSE '未確認' END, ','
        ORDER BY l_linenumber, CASE WHEN l_returnflag = 'R' THEN '否定' WHEN l_linestatus = 'F' THEN '確認' ELSE '未確認' END) AS plan FROM lineitem GROUP BY 1) ON l_orderkey = m.scenario_id
    WHERE NOT m.moved AND t.bd_seq - f.bd_seq > least(m.expected_days, 20)""",
    ("px", "idx", "cal", "bday", "picks", "moved"),
)
def failed_picks(spark, d):
    """FLT13: first picks of each month whose window is over without a move, with the arrows of their check plans."""
    from ..plans import review
    from .scoring import arrows

    cal = calendar.dimension(spark)
    prices, by_day = cut(base.prices(spark, d)), cut(ops.benchmark_by_day(base.benchmark(spark, d), cal))
    moved = ops.moved(base.picks(spark, d).select("scenario_id", "code", "first_date", "expected_days"), prices, by_day, cal)
    out = review.failures(moved, arrows(spark, d), F.lit(TODAY).cast("date"), cal)
    return out.select("month", "scenario_id", "code", F.coalesce(F.array_join(F.transform("arrows", lambda a: F.concat(a["arrow_no"].cast("string"), F.lit(":"), a["status"])), ","), F.lit("")).alias("plan"))


@query(
    """SELECT o_custkey AS event_id, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS codes FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"""
)
def event_candidates(spark, d):
    """JN25: the union of candidates over the scenarios of one event."""
    o = base.read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("event_id"))
    pairs = base.read(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").cast("string").alias("code")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("event_id", "code").distinct()
    return pairs.groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_list("code")), ",").alias("codes"))  # one event's candidates


@query(
    """SELECT o_orderkey, n_nationkey AS code, arg_min(s_name, (l_linenumber, s_name)) AS company_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey
    JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2"""
)
def pick_names(spark, d):
    """JN26: the name of a code from the first candidate of the same scenario that has it."""
    s = base.read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("code"), "s_name")
    li = base.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_linenumber").join(s, "l_suppkey")
    return li.groupBy("o_orderkey", "code").agg(F.min_by("s_name", F.struct("l_linenumber", "s_name")).alias("company_name"))


@query("SELECT l_orderkey AS scenario_id, l_linenumber AS arrow_no, o_orderstatus AS status FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE CAST(l_shipdate AS DATE) = DATE '1997-06-02'")
def releases_due(spark, d):
    """FLT11, PIP6: plan rows whose next release is the day's, with their scenario's status."""
    due = base.read(spark, d, "lineitem").where(F.to_date("l_shipdate") == F.lit("1997-06-02").cast("date")).select(F.col("l_orderkey").alias("scenario_id"), F.col("l_linenumber").alias("arrow_no"))
    return due.join(base.read(spark, d, "orders").select(F.col("o_orderkey").alias("scenario_id"), F.col("o_orderstatus").alias("status")), "scenario_id")


@query("SELECT user_id, CAST(ts AS DATE) AS day, round(date_diff('microsecond', min(ts), max(ts)) / 60000000.0, 1) AS minutes FROM events GROUP BY 1, 2")
def session_minutes(spark, d):
    """STF11: minutes between a session's first and last marker."""
    e = base.read(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return e.select("user_id", "day", F.round((micros("b") - micros("a")) / 60000000.0, 1).alias("minutes"))


@query(
    """SELECT count(*) AS picks, CAST(count_if(status = 'O') AS BIGINT) AS active, CAST(count_if(status = 'F') AS BIGINT) AS ended, count(DISTINCT first_date) AS executed_days, round(avg((status = 'F')::INT), 3) AS hit_rate FROM picks""",
    ("picks",),
)
def kpi_counts(spark, d):
    """AGG23: headline counts."""
    p, status = base.picks(spark, d), F.col("status")
    return p.agg(F.count("*").alias("picks"), F.count_if(status == "O").alias("active"), F.count_if(status == "F").alias("ended"), F.count_distinct("first_date").alias("executed_days"), F.round(F.avg((status == "F").cast("int")), 3).alias("hit_rate"))
