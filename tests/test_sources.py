from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.plans import pack, report
from tidemark.sources import feeds, files
from tidemark.streaming import items


def test_rss(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        """<rss><channel><item><title>One  title - Outlet</title><link> http://x/1 </link><description>d</description><pubDate>Mon, 01 Jan 2024 09:00:00 +0900</pubDate></item>
        <item><title>Two</title><link>http://x/2</link><pubDate>Tue, 02 Jan 2024 01:02:03 GMT</pubDate><source url="http://o">Outlet</source></item><item><title>none</title></item></channel></rss>"""
    )
    rows = feeds.read_rss(spark, str(tmp_path), "feed", 2).orderBy("url").collect()
    assert [(r["title"], r["summary"], r["url"], r["published_at"]) for r in rows] == [("One title - Outlet", "d", "http://x/1", datetime(2024, 1, 1)), ("Two", "", "http://x/2", datetime(2024, 1, 2, 1, 2, 3))]
    assert [r["media"] for r in rows] == ["Outlet", "Outlet"] and len({r["news_id"] for r in rows}) == 2


def test_payloads(spark):
    t = spark.createDataFrame([('{"timeline":[{"series":"s","data":[{"date":"20240101T000000Z","value":1},{"date":"20240101120000","value":3},{"date":"20240102","value":"x"}]}]}',)], "j string")
    assert [(r["date"], r["value"]) for r in feeds.timeline(t, "j").collect()] == [(date(2024, 1, 1), 1.0), (date(2024, 1, 1), 3.0)]
    p = spark.createDataFrame([('{"items":[{"project":"ja.wikipedia","article":"A","timestamp":"2024010300","views":7},{"project":"en.wikipedia","timestamp":"2024010300","views":null}]}',)], "j string")
    assert [tuple(r) for r in feeds.pageviews(p, "j").collect()] == [("wiki_ja", "A", date(2024, 1, 3), 7.0)]
    f = spark.createDataFrame([('{"results":[{"docID":"S1","secCode":"12340","docTypeCode":"350","submitDateTime":"2024-01-01 09:00"},{"docID":"S2","docTypeCode":"120"},{"docTypeCode":"360"}]}',)], "j string")
    (r,) = feeds.filings(f, "j").collect()
    assert (r["doc_id"], r["code"], r["title"], r["published_at"]) == ("S1", "1234", "大量保有報告書", datetime(2024, 1, 1))


def test_files(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "1306.csv").write_text("date,open,high,low,close,volume\n2024-01-01,1,1,1,2,3\n2024-02-01,1,1,1,4,3\n")
    rows = files.read_prices(spark, str(tmp_path / "p"), "2024-01-01", "2024-01-31").collect()
    assert [(r["code"], r["close"]) for r in rows] == [("1306", 2.0)]
    (tmp_path / "t.md").write_text("# x\n| P01 | **Power** | y |\n| --- | --- | --- |\n| Z01 | no | y |\n")
    assert [tuple(r) for r in files.read_themes(spark, str(tmp_path / "t.md")).collect()] == [("P01", "Power")]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.yaml").write_text("case_id: C1\ntitle: t\nevent_date: 2024-01-01\ntheme_ids: [P01]\ntime_type: x\nrelated:\n  - {code: '1234', company_name: n, stage: 1}\n", encoding="utf-8")
    (r,) = files.read_past_cases(spark, str(tmp_path / "c")).collect()
    assert (r["case_id"], r["related"][0]["code"]) == ("C1", "1234")
    raw = spark.createDataFrame([("日本".encode(),), ("日本".encode("cp932"),), (None,)], "content binary")
    assert [r["text"] for r in files.decode_bytes(raw).collect()] == ["日本", "日本", None]
    packs = spark.createDataFrame([("2024-01-01", "a"), ("2024-01-03", "b")], "day string, generated_at string")
    assert files.previous_watermark(packs, "2024-01-03").first()["generated_at"] == "a"


def test_packs_stay_and_reports_render(spark, tmp_path):
    gated = spark.createDataFrame([(1, date(2024, 1, 1), "t", "r", 3.0, 0.9, True), (2, date(2024, 1, 1), "u", "r", 3.0, 0.99, True), (3, date(2024, 1, 1), "v", "r", 3.0, 1.0, False)], "id long, day date, title string, reason string, media_count double, score double, passed boolean")
    packs = pack.day_packs(gated, spark.createDataFrame([(1, "b"), (1, "a")], "id long, url string"))
    (r,) = packs.collect()
    assert r["n_passed"] == 2 and r["pack"].index('"event_id":2') < r["pack"].index('"event_id":1') and '["a","b"]' in r["pack"]
    for p in (packs, packs.withColumn("pack", F.lit("changed"))):
        pack.write_pack(p, str(tmp_path / "packs"))
    assert spark.read.json(str(tmp_path / "packs")).first()["pack"] == r["pack"]
    ranked = spark.createDataFrame([(1, "1234", "n", "本命", 0.12345, ["a", "b"], 3)], "rank int, code string, company_name string, tier string, confidence double, break_conditions array<string>, stars int")
    report.write_csv(ranked, str(tmp_path / "o.csv"))
    assert (tmp_path / "o.csv").read_bytes().startswith(b"\xef\xbb\xbfrank") and "0.1235,a / b" in (tmp_path / "o.csv").read_text("utf-8-sig")
    assert "★★★" in report.markdown(ranked, "2024-01-01") and report.percent(None) == "―"


def test_stream_counts_and_repeats(spark, tmp_path):
    schema, src = "news_id string, source string, first_observed_at timestamp", tmp_path / "in"
    at = [("a", "s", datetime(2024, 1, 1, 14, 59)), ("b", "s", datetime(2024, 1, 1, 15, 0)), ("a", "s", datetime(2024, 1, 1, 15, 1))]
    spark.createDataFrame(at, schema).coalesce(1).write.json(str(src))
    stream = spark.readStream.schema(schema).json(str(src))
    items.run_once(items.first_seen(stream), str(tmp_path / "seen"), str(tmp_path / "c1"))
    assert sorted(r["news_id"] for r in spark.read.parquet(str(tmp_path / "seen")).collect()) == ["a", "b"]
    q = items.daily_counts(stream).writeStream.format("memory").queryName("days").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((str(r["day"]), r["n"]) for r in spark.table("days").collect()) == [("2024-01-01", 1), ("2024-01-02", 2)]


def test_atom_entries_are_news_rows(spark, tmp_path):
    feed = """<feed xmlns="http://www.w3.org/2005/Atom"><title>feed</title>
    <entry><title>First  entry</title><link rel="self" href="https://x.test/self"/><link rel="alternate" href=" https://x.test/1 "/><summary>A  summary</summary><published>2024-01-05T09:00:00+09:00</published></entry>
    <entry><title type="html">Second - Outlet</title><link href="https://x.test/2"/><content type="text">body</content><updated>2024-01-05T01:30:00Z</updated></entry>
    <entry><title>No link</title></entry><entry><title> </title><link href="https://x.test/3"/></entry></feed>"""
    (tmp_path / "a.xml").write_text(feed, encoding="utf-8")
    got = {r["url"]: r for r in feeds.read_atom(spark, str(tmp_path / "a.xml"), "src", 1).collect()}
    assert set(got) == {"https://x.test/1", "https://x.test/2"}
    one, two = got["https://x.test/1"], got["https://x.test/2"]
    assert (one["title"], one["summary"], one["source_tier"], str(one["published_at"])) == ("First entry", "A summary", 1, "2024-01-05 00:00:00")
    assert (two["summary"], two["media"], str(two["published_at"])) == ("body", "Outlet", "2024-01-05 01:30:00")


def test_article_counts_of_a_japanese_day(spark):
    rows = [("2024-01-04 15:00:00", "a"), ("2024-01-05 14:59:59", "b"), ("2024-01-05 15:00:00", "c"), ("2024-01-04 14:59:59", "d"), (None, "a"), (None, "")]
    df = spark.createDataFrame(rows, "t string, media string").selectExpr("cast(t as timestamp) published_at", "media")
    got = {r["source"]: (r["key"], str(r["date"]), r["value"]) for r in feeds.article_counts(df, "word", "2024-01-05").collect()}
    assert got == {"google_news_media": ("word", "2024-01-05", 2.0), "google_news_articles": ("word", "2024-01-05", 4.0)}


def test_bars_are_normalised(spark):
    df = spark.createDataFrame([("2024-01-04", 1, 2, 3, 4, 5, "x"), ("2024-01-05", 1, 2, 3, 4, 5, "x"), ("2024-01-09", 1, 2, 3, 4, 5, "x")], "DATE string, Open int, high int, LOW int, Close int, volume int, other string")
    got = files.normalised(df, "2024-01-04", "2024-01-05")
    assert got.columns == ["date", "open", "high", "low", "close", "volume"] and got.count() == 2 and got.schema["close"].dataType.simpleString() == "double"
    with pytest.raises(ValueError, match="volume"):
        files.normalised(df.drop("volume"), "2024-01-04", "2024-01-05")
