"""All sources as jobs of one collection, over saved payloads."""

import json
from urllib.parse import quote

import pytest

from tidemark.plans import collect, jobs

ITEM = "<rss><channel><item><title>{t}</title><link>{u}</link><pubDate>Thu, 04 Jan 2024 00:00:00 GMT</pubDate>{s}</item></channel></rss>"
ROW = '<table><tr><td class="kjTime">15:00</td><td class="kjCode">72030</td><td class="kjName">N</td><td class="kjTitle"><a href="a{n}.pdf">T{n}</a></td></tr></table>'


@pytest.fixture
def config(tmp_path):
    def put(name, text):
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_text(text, encoding="utf-8")

    put("rss/a.xml", ITEM.format(t="One", u="http://x/1", s=""))
    put("rss/b.xml", '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Two</title><link href="http://x/2"/><updated>2024-01-04T00:00:00Z</updated></entry><entry><title>One</title><link href="http://x/1"/></entry></feed>')
    put(f"news/{quote('半導体')}.xml", ITEM.format(t="Three - Outlet", u="http://x/3", s="<source url='http://o'>Outlet</source>"))
    put("edinet/d.json", json.dumps({"results": [{"docID": "S1", "secCode": "72030", "filerName": "N", "docTypeCode": "350", "submitDateTime": "2024-01-04 15:00", "docDescription": None}]}))
    put(f"gdelt/{quote('電池 a')}.json", json.dumps({"timeline": [{"series": "v", "data": [{"date": "20240104T000000Z", "value": 1.0}, {"date": "20240104T120000Z", "value": 2.0}]}]}))
    put("wiki/p.json", json.dumps({"items": [{"project": "ja.wikipedia", "article": "A", "timestamp": "2024010400", "views": 5}]}))
    put("tdnet/20240104_1.html", ROW.format(n=1) + ROW.format(n=2))
    put("list.csv", "コード,銘柄名,市場・商品区分,33業種区分\n1301,A,P,x\n")
    return {
        "rss": {"feeds": [{"path": f"{tmp_path}/rss/a.xml", "name": "a", "tier": 2}, {"path": f"{tmp_path}/rss/b.xml", "name": "b", "tier": 3, "format": "atom"}]},
        "google_news": {"path": f"{tmp_path}/news"}, "edinet": {"path": f"{tmp_path}/edinet"}, "gdelt": {"path": f"{tmp_path}/gdelt"}, "wikipedia": {"path": f"{tmp_path}/wiki"},
        "tdnet": {"start": "2024-01-04", "end": "2024-01-05", "fetcher": "tidemark.sources.crawl:saved_pages", "folder": f"{tmp_path}/tdnet"},
        "universe": {"path": f"{tmp_path}/list.csv"}, "calendar": {"path": f"{tmp_path}/none.csv"},
    }


def test_each_source_gives_rows_and_a_log_row(spark, config):
    rows = {}
    log = collect.collect(spark, jobs.jobs(config), lambda name, df: rows.update({name: [r.asDict() for r in df.collect()]}))
    told = {r["source"]: (r["ok"], r["items"]) for r in log.collect()}
    assert told == {"rss": (True, 2), "google_news": (True, 1), "tdnet": (True, 2), "edinet": (True, 1), "gdelt": (True, 1), "wikipedia": (True, 1), "jpx_universe": (True, 1), "earnings_schedule": (False, 0)}
    assert {r["title"] for r in rows["rss"]} == {"One", "Two"}
    assert [(r["source"], r["title"], r["summary"]) for r in rows["google_news"]] == [("google_news:半導体", "Three", "Outlet")]
    assert [(r["key"], r["value"]) for r in rows["gdelt"]] == [("電池 a", 1.5)] and rows["wikipedia"][0]["value"] == 5.0
    assert sorted(r["title"] for r in rows["tdnet"]) == ["T1", "T2"]
    assert rows["edinet"][0]["title"] == "大量保有報告書" and rows["jpx_universe"][0]["code"] == "1301"


def test_only_what_is_asked_for_in_order(config):
    assert list(jobs.jobs(config, ["universe", "rss", "tdnet"])) == ["rss", "tdnet", "jpx_universe"]
    assert jobs.jobs({}) == {}
    with pytest.raises(ValueError):
        jobs.jobs(config, ["other"])
