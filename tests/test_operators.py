"""Operators against brute force on small random inputs, and boundary values of the rules."""

import random
import time
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import calendar
from tidemark.functions import scoring as sc
from tidemark.functions import text as tx
from tidemark.operators import events, records, state, tables
from tidemark.operators import prices as px
from tidemark.plans import nightly


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# Business days


def test_business_days_equal_counting(spark):
    cal, rng = calendar.dimension(spark), random.Random(1)
    first = date(2023, 12, 20)
    rows = [(first + timedelta(days=rng.randrange(60)), rng.randrange(-9, 10)) for _ in range(200)]
    out = calendar.add_business_days(spark.createDataFrame(rows, "d0 date, n int"), "d0", F.col("n"), "to", cal)
    for r in out.collect():
        d, left = r["d0"], abs(r["n"])
        while left:
            d += timedelta(days=1 if r["n"] > 0 else -1)
            left -= calendar.is_business_day(d)
        assert d == r["to"]


@pytest.mark.parametrize("day", ["2024-01-08", "2024-02-12", "2024-04-29", "2024-05-06", "2024-09-23", "2019-05-02", "2020-07-23", "2021-08-09", "2026-09-22", "1999-10-11", "2024-12-31"])
def test_days_off(day):
    assert not calendar.is_business_day(date.fromisoformat(day))


def test_work_days():
    for day in ("2020-10-12", "2021-10-11", "2024-01-04", "2024-12-30", "2019-12-23"):
        assert calendar.is_business_day(date.fromisoformat(day))


# Prices


def series(rng, codes=4, n=60):
    rows = []
    for c in range(codes):
        d, p = date(2024, 1, 1), 100.0
        for _ in range(n):
            d += timedelta(days=rng.randint(1, 4))
            p *= 1 + rng.gauss(0, 0.03)
            rows.append((c, d, round(p, 4), float(rng.randint(1, 99))))
    return rows


@pytest.mark.parametrize("inclusive", [True, False])
def test_as_of_equals_scan(spark, inclusive):
    rng = random.Random(4)
    rows = series(rng)
    probes = [(c, date(2023, 12, 25) + timedelta(days=rng.randrange(250))) for c in range(5) for _ in range(30)]
    df = spark.createDataFrame(rows, "code int, date date, close double, volume double")
    out = px.as_of(spark.createDataFrame(probes, "code int, date date"), df, ["code"], inclusive=inclusive).collect()
    assert len(out) == len(probes)
    for r in out:
        seen = [x[2] for x in rows if x[0] == r["code"] and (x[1] <= r["date"] if inclusive else x[1] < r["date"])]
        assert r["close"] == (seen[-1] if seen else None)


def test_sigma_equals_brute_force(spark):
    rng = random.Random(6)
    rows, bench = series(rng), [(d, c) for _, d, c, _ in series(rng, 1, 90)]
    df = spark.createDataFrame(rows, "code int, date date, close double, volume double")
    by_day = px.benchmark_by_day(spark.createDataFrame(bench, "date date, close double"), calendar.dimension(spark))
    out = px.day_sigma(px.daily_features(df, 20), by_day).collect()
    for r in out:
        mine = [x for x in rows if x[0] == r["code"] and x[1] <= r["date"]]
        on, before = [c for d, c in bench if d <= r["date"]], [c for d, c in bench if d < r["date"]]
        closes = [x[2] for x in mine[:-1]][-21:]
        if len(closes) < 3 or not before:
            assert r["sigma"] is None
            continue
        vol = np.std([b / a - 1 for a, b in zip(closes, closes[1:], strict=False)], ddof=1)
        excess = (mine[-1][2] / mine[-2][2] - 1) - (on[-1] / before[-1] - 1)
        assert r["sigma"] == pytest.approx(excess / vol, rel=1e-9)


def test_flat_prices_make_any_excess_infinite(spark):
    df = spark.createDataFrame([(1, date(2024, 1, k), 100.0 if k < 9 else 99.0, 1.0) for k in range(1, 10)], "code int, date date, close double, volume double")
    bench = spark.createDataFrame([(date(2024, 1, k), 10.0) for k in range(1, 10)], "date date, close double")
    out = px.day_sigma(px.daily_features(df), px.benchmark_by_day(bench, calendar.dimension(spark))).orderBy("date").collect()
    assert [r["sigma"] for r in out] == [None] * 3 + [0.0] * 5 + [float("inf")]


@pytest.mark.parametrize(("price", "width"), [(0, 30), (99.9, 30), (100, 50), (699, 100), (700, 150), (999, 150), (1000, 300), (49_999_999, 7_000_000), (50_000_000, 10_000_000), (-1, None)])
def test_price_bands(spark, price, width):
    assert one(spark, px.price_limit(F.lit(float(price))).alias("w"))["w"] == width


# Rules


@pytest.mark.parametrize(("value", "stars"), [(0.0499, 1), (0.05, 2), (0.10, 3), (0.1999, 3), (0.20, 4)])
def test_stars(spark, value, stars):
    assert one(spark, sc.stars(F.lit(value)).alias("s"))["s"] == stars


@pytest.mark.parametrize(
    ("broken", "started", "waited", "elapsed", "tier1", "reacted", "priced", "reason"),
    [
        (True, False, 0, 0, False, False, 0.0, "シナリオが崩れた"), (False, False, 60, 0, False, False, 0.0, "起動しなかった"), (False, False, 59, 99, False, False, 0.9, None),
        (False, True, 0, 0, False, False, 0.80, "織り込みが完了した"), (False, True, 0, 10, False, False, 0.79, None), (False, True, 0, 11, False, False, 0.79, "材料が弱かった"),
        (False, True, 0, 11, True, False, 0.0, "連想が市場に届かなかった"), (False, True, 0, 11, True, True, 0.0, None),
    ],
)
def test_end_rules(spark, broken, started, waited, elapsed, tier1, reacted, priced, reason):
    c = sc.end_reason(F.lit(broken), F.lit(started), F.lit(waited), F.lit(elapsed), F.lit(10), F.lit(tier1), F.lit(reacted), F.lit(priced))
    assert one(spark, c.alias("r"))["r"] == reason


@pytest.mark.parametrize(
    ("side", "monitored", "turnover", "price", "surge", "low", "reason"),
    [
        ("long", False, 3e8, 100.0, 0.5, False, None), ("caution", True, 0.0, 0.0, 1.0, True, "売り方向(caution)の候補"), ("long", True, 0.0, 0.0, 1.0, True, "監理・整理ポストの銘柄"),
        ("long", False, 3e8 - 1, 0.0, 1.0, True, "流動性の下限を満たさない"), ("long", False, 3e8, 99.9, 1.0, True, "株価100円未満"), ("long", False, 3e8, 100.0, 0.51, True, "直近ですでに急騰している"),
        ("long", False, 3e8, 100.0, 0.5, True, "裏取りの証拠が信頼度3・4の情報源だけ"),
    ],
)
def test_exclusions(spark, side, monitored, turnover, price, surge, low, reason):
    c = sc.exclusion(*map(F.lit, (side, monitored, turnover, price, surge, low)))
    assert one(spark, c.alias("r"))["r"] == reason


def test_freshness_and_signals(spark):
    r = one(spark, sc.freshness(F.lit(False), F.lit(9), F.lit(10)).alias("a"), sc.freshness(F.lit(True), F.lit(4), F.lit(10)).alias("b"), sc.freshness(F.lit(True), F.lit(12), F.lit(10)).alias("c"), sc.sell_signals(F.lit(True), F.lit(False), F.lit(0.7), F.lit(2)).alias("s"))
    assert (r["a"], r["b"], r["c"], len(r["s"])) == (1.0, 0.6, 0.0, 3)


# Text and events


def test_text(spark):
    r = one(spark, tx.normal_space(F.lit(" a　 b\n")).alias("a"), tx.bigrams(F.lit("ab、c a b")).alias("b"), tx.bigrams(F.lit("x")).alias("c"), tx.bigrams(F.lit("")).alias("d"), tx.entities(F.lit("東京電力がアメリカで発表")).alias("e"), tx.security_code(F.lit("12340")).alias("f"), tx.title_media(F.lit("A - b - Reuters")).alias("g"), tx.jaccard(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b"))).alias("h"))
    assert (r["a"], r["b"], r["c"], r["d"], r["e"], r["f"], r["g"], r["h"]) == ("a b", ["ab", "bc", "ca"], ["x"], [], ["東京電力", "アメリカ", "発表"], "1234", "Reuters", 0.5)


def brute_clusters(titles, entity=tx.ENTITY):
    import re

    clusters, label = [], []
    for t in titles:
        s = re.sub(tx.NOISE, "", t)
        g = {s[i : i + 2] for i in range(len(s) - 1)} if len(s) > 1 else ({s} if s else set())
        e = set(re.findall(entity, t))
        sims = [max(len(a & x) / len(a | x) if a | x else 0.0 for a, x in ((g, c[0]), (e, c[1]))) for c in clusters]
        best = max(range(len(sims)), key=lambda i: (sims[i], -i), default=None)
        if best is None or sims[best] < 0.5 or sims[best] == 0:
            clusters.append([set(g), set(e)])
            best = len(clusters) - 1
        else:
            clusters[best][0] |= g
            clusters[best][1] |= e
        label.append(best)
    return label


def test_greedy_clusters_equal_scan(spark):
    rng = random.Random(11)
    parts = ["東京電力", "アメリカ", "発表", "x", "の", "株価", "上昇", "ab", "、", ""]
    titles = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for _ in range(120)]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(titles)], "day int, id int, title string")
    got = {r["id"]: r["cluster_no"] for r in events.cluster(df, ["day"], ["id"]).collect()}
    assert [got[i] for i in range(120)] == brute_clusters(titles)


def test_clusters_of_a_long_day_take_time_near_its_items(spark):
    """20,000 headlines of one day: a loop over all clusters would compare some 10^8 pairs."""
    rng = random.Random(3)
    chars = [chr(0x4E00 + k) for k in range(3000)]
    heads = ["".join(rng.choice(chars) for _ in range(24)) for _ in range(9000)]
    titles = [h if rng.random() < 0.5 else h[:20] + "".join(rng.choice(chars) for _ in range(4)) for h in (rng.choice(heads) for _ in range(20_000))]

    def took(n):
        df = spark.createDataFrame([(1, i, t) for i, t in enumerate(titles[:n])], "day int, id int, title string").coalesce(1)
        began = time.perf_counter()
        found = [r["cluster_no"] for r in events.cluster(df, ["day"], ["id"]).orderBy("id").collect()]
        took = time.perf_counter() - began
        assert found[:100] == brute_clusters(titles[:100]) and len(set(found)) > len(found) / 4
        return took

    took(100)
    assert took(20_000) < 14 * took(2_000) + 5


def test_percentile_ranks(spark):
    values, history = spark.createDataFrame([(1, 0.0), (1, 5.0), (1, 9.0), (2, 1.0)], "k int, v double"), spark.createDataFrame([(1, 0.0), (1, 5.0), (1, 5.0), (1, 7.0)], "k int, v double")
    got = sorted(tuple(r) for r in events.percentile_rank(values, history, "v", ["k"], "p").collect())
    assert got == [(1, 0.0, 0.0), (1, 5.0, 0.25), (1, 9.0, 1.0), (2, 1.0, 0.0)]
    again = values.unionByName(values)
    assert sorted(r["p"] for r in events.percentile_rank(again, history.drop("k"), "v", [], "p").collect()) == [0.0, 0.0, 0.25, 0.25, 0.25, 0.25, 1.0, 1.0]


def test_ranks_in_a_sliding_history_equal_a_count_over_all_rows(spark):
    rng = random.Random(4)
    rows = [(date(2024, 1, 1) + timedelta(days=rng.randrange(0, 70)), float(rng.randrange(6)), float(rng.choice([0, 0, -1, 3]))) for _ in range(400)] + [(date(2024, 9, 1), 1.0, 1.0)]
    got = {(r["name"], r["day"], r["value"]): (r["rank"], r["n"], r["any"]) for r in events.sliding_ranks(spark.createDataFrame(rows, "day date, a double, b double"), "day", ["a", "b"], 13).collect()}
    want = {}
    for k, name in ((1, "a"), (2, "b")):
        for r in rows:
            past = [x[k] for x in rows if 1 <= (r[0] - x[0]).days <= 13]
            want[name, r[0], r[k]] = (sum(v < r[k] for v in past) / len(past) if past else 0.0, len(past), any(v > 0 for v in past))
    assert got == want


def test_blocks_of_days_are_the_days(spark):
    for low in range(-9, 9):
        for size in range(100):
            days = [t for level, number in events._blocks(low, low + size - 1) for t in range(number << level, (number + 1) << level)]
            assert days == list(range(low, low + size)) and len(events._blocks(low, low + size - 1)) <= 2 * size.bit_length()


def test_gate_order_and_cap(spark):
    rows = [(i, 1, f"t{i}", 1.0, float(i), 0.0, 0.0, "", i == 0, i == 1, i) for i in range(7)] + [(9, 1, "TOB", 0.0, 0.0, 0.0, 0.0, "", False, False, 9), (10, 1, "x", 0.5, 1.0, 0.0, 0.0, "", False, False, 10)]
    df = spark.createDataFrame(rows, "id int, day int, title string, score double, media_count double, growth double, growth_percentile double, disclosure_type string, seen boolean, forced boolean, pos int")
    df = df.withColumn("strong", events.strong_kind(F.col("title"), F.col("disclosure_type")))
    out = {r["id"]: (r["passed"], r["forced_in"], r["reason"]) for r in events.gate(df, F.lit(False), F.lit(False)).collect()}
    assert [i for i in out if out[i][0]] and {i for i in out if out[i][0]} == {1, 4, 5, 6}
    assert out[0][2] == "新規性なし(既知の事実)" and out[1] == (True, True, "注目度が上位5%(進行中シナリオの別枠)") and out[9][2] == "強い種類の開示(上限 3 件を超過)" and not out[10][0]


# State and records


def brute_fold(log):
    s = None
    for k, _, day, change, status, strength, reason, rise in sorted(log, key=lambda r: r[:2]):
        if k == 0:
            on = day if status == "進行中" else None
            s = dict(status=status, strength=strength, started=on, clock=on, reason=None, n=0, rise=rise, version=1)
        elif s is None:
            return None
        elif k == 3:
            s["n"] += 1
            s["strength"] = strength or s["strength"]
            if rise is not None:
                s["rise"], s["version"] = rise, s["version"] + 1
            if change == "強化" and s["status"] == "進行中":
                s["clock"] = day
            elif change == "起動" and s["status"] == "待機":
                s.update(status="進行中", started=day, clock=day)
            elif change == "消滅":
                s.update(status="終了", reason="シナリオが崩れた")
        elif k == 4:
            s["status"], s["reason"] = status, reason or s["reason"]
            if status == "進行中" and s["started"] is None:
                s.update(started=day, clock=day)
    return tuple(s.values()) if s else None


def test_fold_equals_loop(spark):
    rng, rows = random.Random(2), []
    for key in range(60):
        first = 1 if key % 10 else 0  # every tenth scenario is unknown, others have up to two rows of their own
        for s in range(1, first * rng.randint(1, 2) + 1):
            rows.append((key, 0, s, date(2024, 1, 1), None, rng.choice(["待機", "進行中"]), "Weak", None, 0.1))
        for s in range(3, rng.randint(4, 12)):
            k = rng.choice([3, 3, 3, 4])
            rows.append((key, k, s, date(2024, 1, 1) + timedelta(days=s), rng.choice(["強化", "弱体化", "起動", "消滅"]) if k == 3 else None, rng.choice(["進行中", "休眠", "終了"]) if k == 4 else None, rng.choice(["Medium", None]), rng.choice(["r", None]) if k == 4 else None, rng.choice([0.2, None])))
    df = spark.createDataFrame(rows, "key int, k int, s int, day date, change string, status string, strength string, reason string, rise double")
    out = {r["key"]: tuple(r)[1:] for r in state.fold(df, "key", *[F.col(c) for c in ("k", "s", "day", "change", "status", "strength", "reason", "rise")]).collect()}
    assert out == {k: f for k in range(60) if (f := brute_fold([x[1:] for x in rows if x[0] == k]))}
    assert set(range(60)) - set(out) == set(range(0, 60, 10))


def test_upserts_take_one_whole_row_of_a_batch(spark):
    old = spark.createDataFrame([(1, "a", 1, 1)], "k int, x string, y int, seen int")
    new = spark.createDataFrame([(1, "b", 9, 2), (1, "c", 3, 3), (2, "d", 1, 5), (2, "d", 2, 4)], "k int, x string, y int, seen int")
    assert sorted(map(tuple, tables.upsert_keep_first(old, new, ["k"], ["x", "y"], ["seen"], ["seen"]).collect())) == [(1, "c", 3, 1), (2, "d", 1, 4)]
    assert sorted(map(tuple, tables.replace_rows(old, new, ["k"]).collect())) == [(1, "c", 3, 3), (2, "d", 2, 4)]


def test_clusters_cross_sources(spark):
    rows = [(1, 1, "NHK reports a new rule", "news", "a", 1, None), (1, 2, "NHK reports a new rule", "news", "b", 2, None), (1, 3, "NHK reports a new rule.", "disclosure", "c", 3, "7203"), (1, 4, "Something else altogether", "news", "a", 4, None)]
    df = spark.createDataFrame(rows, "day int, id int, title string, kind string, source string, ts int, code string")
    out = sorted(events.to_events(events.cluster(df, ["day"], ["ts", "id"]), ["day"]).collect(), key=lambda r: r["cluster_no"])
    assert [(r["media_count"], r["n_items"], r["codes"], r["news_ids"], r["disclosure_ids"]) for r in out] == [(3, 3, ["7203"], [1, 2], [3]), (1, 1, [], [4], [])]


def test_company_names(spark):
    names = ["㈱Ａ_Ｂ‐Ｃ", "株式会社 a b c", "A・B,C", "(有)x", "有限会社ーx."]
    out = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", tx.company_name(F.col("n")).alias("v")).collect()
    assert {r["i"]: r["v"] for r in out} == {0: "abc", 1: "abc", 2: "ab,c", 3: "(有)x", 4: "x"}


def test_no_excess_gives_no_sigma(spark):
    df = spark.createDataFrame([(date(2024, 1, 4), 0.0, 0.0, None, None), (date(2024, 1, 4), 0.0, 0.0, 1.0, 1.0)], "date date, ret double, prior_vol double, b0 double, b1 double").withColumn("row", F.monotonically_increasing_id())
    for r in df.collect():
        day = spark.createDataFrame([(date(2024, 1, 4), r["b0"], r["b1"])], "b_date date, b_before double, b_on double")
        assert px.day_sigma(df.where(F.col("row") == r["row"]), day).first()["sigma"] == (None if r["b0"] is None else 0.0)


def test_bigrams_take_time_in_proportion(spark):
    import time

    def took(n):
        df = spark.createDataFrame([("".join(chr(97 + (i * i) % 26) for i in range(n)),)], "t string")
        began = time.perf_counter()
        assert df.select(F.size(tx.bigrams(F.col("t")))).first()[0] > 10
        return time.perf_counter() - began

    took(100)
    assert took(200_000) < 12 * took(20_000) + 2
    assert one(spark, tx.bigrams(F.lit("日本 語")), tx.bigrams(F.lit("x")), tx.bigrams(F.lit(None).cast("string"))) == (["日本", "本語"], ["x"], [])


def test_chain_is_sound_and_changes_are_seen(spark):
    df = records.chain(spark.createDataFrame([(3, "c"), (1, "a"), (2, None)], "n int, v string"), "grade", "n")
    rows = sorted(map(tuple, df.select("_seq", "n", "v", "_prev_hash", "_hash").collect()))
    assert [r[1] for r in rows] == [1, 2, 3] and rows[0][3] == records.GENESIS and rows[2][3] == rows[1][4]
    good = spark.createDataFrame([("g", *r) for r in rows], "kind string, seq long, n int, v string, prev string, own string")
    assert tables.chain_breaks(good, "kind", "seq", "prev", "own").count() == 0
    bad = good.withColumn("own", F.when(F.col("seq") == 2, "x").otherwise(F.col("own")))
    assert [r["seq"] for r in tables.chain_breaks(bad, "kind", "seq", "prev", "own").collect()] == [3]


def test_checks_and_downgrade(spark):
    c = spark.createDataFrame([("1234", 0.5, 1, "long"), ("12", None, 4, "x")], "code string, realization_prob double, stage int, side string")
    assert [r["v"] for r in c.select(records.violations(records.candidate_checks()).alias("v")).collect()] == [[], ["code", "realization_prob", "side", "stage"]]
    told = spark.createDataFrame([("s", 1, "確認"), ("s", 2, "確認"), ("s", 3, "否定")], "scenario_id string, arrow_no int, status string")
    evidence = spark.createDataFrame([("s", 1, "for", 2), ("s", 2, "for", 3), ("s", 2, "against", 1)], "scenario_id string, arrow_no int, supports string, source_tier int")
    assert {r["arrow_no"]: r["status"] for r in records.downgrade(told, evidence).collect()} == {1: "確認", 2: "未確認", 3: "否定"}


def test_nightly_steps(spark):
    active = spark.createDataFrame([(i,) for i in range(20)], "scenario_id int")
    conf = spark.createDataFrame([(i, i / 100.0) for i in range(3, 20)], "scenario_id int, confidence double")
    assert sorted(r["scenario_id"] for r in nightly.dormant(active, conf).collect()) == [0, 1, 2, 3, 4]
    now = spark.createDataFrame([(1, "a", 5, ["x"]), (2, "a", 5, []), (3, "a", 61, ["x"]), (4, "a", 5, ["x"])], "scenario_id int, code string, days_since_pick int, signals array<string>")
    before = spark.createDataFrame([(4, "a", 1, ["y"]), (4, "a", 2, ["x"])], "scenario_id int, code string, _seq int, signals array<string>")
    assert [r["scenario_id"] for r in nightly.new_signals(now, before).collect()] == [1]
    ev = spark.createDataFrame([(1, False, True, 0, 11, 10, False, True, 1, 0.1), (1, False, True, 0, 11, 10, False, False, 2, 0.2)], "scenario_id int, broken boolean, started boolean, waiting_days int, elapsed int, expected_days int, tier1_reacted boolean, reacted boolean, stage int, priced double")
    assert nightly.endings(ev).first()["end_reason"] == "材料が弱かった"
