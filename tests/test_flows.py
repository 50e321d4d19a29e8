"""Plans and sources around the queries: windows, the inbox, collection, reports, the state stream."""

import json
from datetime import date, datetime, timedelta, timezone

import pytest

from tests.test_operators import brute_fold
from tidemark.plans import collect, pack, report, review
from tidemark.sources import files, masters
from tidemark.streaming import state as stream


def test_pack_windows():
    day, utc = date(2024, 1, 4), timezone.utc
    first = datetime(2024, 1, 3, 15, tzinfo=utc)
    assert pack.pack_window(day, first + timedelta(hours=5)) == (first, first + timedelta(hours=5))
    assert pack.pack_window(day, first + timedelta(days=3), first - timedelta(hours=2)) == (first - timedelta(hours=2), first + timedelta(days=1))
    assert pack.pack_window(day, first - timedelta(days=3)) == (first, first + timedelta(days=1))


def test_inbox_takes_the_newest(spark, tmp_path):
    (tmp_path / "daily_20240101.json").write_text("{}")
    (tmp_path / "daily_20240103.json").write_bytes(b"\xef\xbb\xbf" + json.dumps({"run": 1}).encode())
    (tmp_path / "other.json").write_text("x")
    r = files.read_inbox(spark, str(tmp_path)).first()
    assert (r["name"], json.loads(r["text"]), r["error"]) == ("daily_20240103.json", {"run": 1}, None)
    (tmp_path / "daily_20240104.json").write_text("{broken")
    assert files.read_inbox(spark, str(tmp_path)).first()["error"] == "not JSON"
    assert files.read_inbox(spark, str(tmp_path), "none_*.json").count() == 0


def test_configuration_and_price_source(tmp_path):
    (tmp_path / "example.yaml").write_text("paths: {prices: data/prices}\ncap: 3\n")
    config = files.read_config(str(tmp_path / "own.yaml"), str(tmp_path / "example.yaml"))
    assert config == {"cap": 3, "paths": {"prices": str(tmp_path / "data" / "prices")}}
    assert callable(files.price_reader("csv_dir", config["paths"]["prices"]))
    with pytest.raises(ValueError):
        files.price_reader("other", "x")


def test_sheets_need_their_columns(spark, tmp_path):
    (tmp_path / "list.csv").write_text("コード,銘柄名,市場・商品区分,33業種区分\n1301, A ,P,x\n ,B,P,y\nnan,C,P,z\n", encoding="utf-8")
    assert [tuple(r) for r in masters.universe(masters.read_sheet(spark, str(tmp_path / "list.csv"))).collect()] == [("1301", "A", "P", "x", "通常")]
    with pytest.raises(ValueError):
        masters.earnings(masters.read_sheet(spark, str(tmp_path / "list.csv")).drop("コード"))


def test_one_source_that_fails_does_not_stop_the_others(spark, tmp_path):
    def broken(s):
        raise RuntimeError("x" * 900)

    written = {}
    log = collect.collect(spark, {"a": broken, "b": lambda s: s.range(3)}, lambda name, df: written.update({name: df.count()}))
    collect.append_log(log, str(tmp_path / "log"))
    collect.append_log(log, str(tmp_path / "log"))
    rows = spark.read.parquet(str(tmp_path / "log")).collect()
    assert written == {"b": 3} and len(rows) == 4
    assert {(r["source"], r["ok"], r["items"], len(r["message"])) for r in rows} == {("a", False, 0, 500), ("b", True, 3, 0)}


def test_reports(spark):
    moves = spark.createDataFrame([("1301", 3.2), ("7203", 5.0)], "code string, z double")
    signals = spark.createDataFrame([], "code string, company_name string, signals string")
    text = report.morning(moves, signals, "2024-01-04")
    assert text.index("7203") < text.index("1301") and text.endswith("- none\n")
    month = spark.createDataFrame([(date(2024, 1, 1), 3, 1, 0.333, 0.5, None, 1.0)], "month date, picks long, pending long, hit_rate_by_stock double, hit_rate_by_scenario double, stage1_hit_rate double, lead_rate double")
    assert report.month_markdown(month).splitlines()[2] == "| 2024-01-01 | 3 | 1 | 33.3% | 50.0% | ― | 100.0% |"
    related = spark.createDataFrame([(date(2024, 1, 1), True), (date(2024, 1, 1), False)], "month date, moved boolean")
    assert json.loads(review.monthly_input(month, related).first()["input"])["related_movers"] == 1


def test_state_stream_equals_the_fold(spark, tmp_path):
    day = date(2024, 1, 1)
    first = [("a", 0, 1, day, None, "待機", "Weak", None, 0.1), ("a", 3, 2, day, "起動", None, "Medium", None, None), ("b", 3, 1, day, "消滅", None, None, None, None)]
    second = [("a", 3, 3, day + timedelta(days=2), "強化", None, None, None, 0.3), ("a", 4, 4, day, None, "休眠", None, "r", None), ("b", 0, 2, day, None, "進行中", "Strong", None, None)]
    schema = "scenario_id string, k int, s int, day date, change string, status string, strength string, reason string, rise double"
    source, out = tmp_path / "in", []
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        records = spark.readStream.schema(schema).parquet(str(source))
        keep = lambda df, _: out.append({r["scenario_id"]: tuple(r)[1:] for r in df.collect()})  # noqa: E731, B023
        stream.fold(records).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    want = {k: brute_fold([x[1:] for x in (*first, *second) if x[0] == k]) for k in "ab"}
    got = {k: v for batch in out for k, v in batch.items()}
    assert got["a"] == want["a"] and got["b"] == ("進行中", "Strong", day, day, None, 0, None, 1)
