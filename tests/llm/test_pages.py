import base64
import hashlib
import re
import time

from tidemark.llm import html_extract, warc
from tidemark.llm.queries import QUERIES


def pages(spark):
    rows = [(1, "http://a", "same", 1), (2, "http://b", "same", 2), (3, None, None, 3), (None, "a b\n", "same", 4), (4, "x", "", 5), (5, "y", "<p>" + "z" * 300_000, 6), (2, "http://b", "same", 7)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, path long")


def test_archives_give_back_every_page_at_any_split(spark):
    df = pages(spark)
    manifest = warc.write_warc(df)
    for split in (61, 1000, 64 << 20):
        rows = warc.read_warc(manifest, split_bytes=split).collect()
        assert len(rows) == df.count()
        by = {(r["page_id"], r["url"]): r for r in rows}
        assert by[1, "http://a"]["record_type"] == "revisit" and by[1, "http://a"]["refers_to"] == 2
        assert [r["record_type"] for r in rows if r["page_id"] == 2] == ["response"] * 2
        assert by[None, "a%20b%0A"]["refers_to"] == 2
        assert by[3, None]["refers_to"] == 4 and by[4, "x"]["payload_bytes"] == 0
        assert bytes(by[5, "y"]["payload"]) == b"<p>" + b"z" * 300_000
        assert by[1, "http://a"]["payload_digest"] == base64.b32encode(hashlib.sha1(b"same").digest()).decode() and by[1, "http://a"]["payload_bytes"] == 4
    assert warc.read_warc(warc.write_warc(df.limit(0))).count() == 0


def test_damage_and_false_magic_are_passed_over(tmp_path):
    records = [warc.member("response", i, "u", hashlib.sha1(b"x" * i).hexdigest(), i, b"x" * i, None, "d") for i in range(1, 6)]
    data = records[0] + records[1][:40] + b"\x1f\x8b\x08junk" + records[2] + records[3] + records[4]

    class File:
        def read_at(self, n, at):
            return data[at : at + n]

    for cut in range(1, len(data), 7):
        got = [f["warc-record-id"] for a, b in ((0, cut), (cut, len(data))) for _, f, _ in warc.scan_range(File(), len(data), a, b)]
        assert got == [f"<urn:page:{i}>" for i in (1, 3, 4, 5)]


def test_small_payloads_are_all_responses(spark):
    rows = warc.read_warc(warc.write_warc(pages(spark), min_revisit_bytes=5)).collect()
    assert {r["record_type"] for r in rows} == {"response"}


def test_main_text_of_common_layouts():
    model = html_extract.default_model()
    page = """<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/x>News</a></li></ul></nav>
      <div class="cookie-notice">We use cookies, as everyone does.</div>
      <article><h1>A &amp; B</h1><p>First paragraph of the story, with a <a href=/y>link</a> inside.<p>Second   one,\nnever closed.
      <div class="ad">Buy this now.</div><p>Third one ends it all, quite long enough.</p></article>
      <section id="comments"><div class="comment"><p>I liked this article a lot, thanks.</p></div></section>
      <form><p>Subscribe to us.</p></form><footer>&copy; 2024 Somebody</footer></body></html>"""
    text = "A & B First paragraph of the story, with a link inside. Second one, never closed. Third one ends it all, quite long enough."
    assert html_extract.main_texts([page], model) == [text]
    assert html_extract.main_texts([None, "", "<p cla", "<div" * 3], model) == [""] * 4


def test_marginals_are_exact_on_small_trees():
    import itertools

    import numpy as np

    w, pair = html_extract.default_model()
    f = html_extract.Forest([html_extract.Page(h) for h in html_extract.labelled_pages(3, seed=5)] + [html_extract.Page("<div><p>a</p><ul><li>b<li>c</ul></div>")])
    at = int(f.start[-2])
    n, got = len(f.parent) - at, f.marginals(w, pair)[at:]
    total, content = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        s = sum(f.x[at + i] @ w * y[i] + (pair[f.kind[at + i], y[f.parent[at + i] - at], y[i]] if f.parent[at + i] >= 0 else 0) for i in range(n))
        total += np.exp(s)
        content += np.exp(s) * np.array(y)
    assert np.allclose(got, content / total)


def test_held_out_labelled_pages():
    model = html_extract.default_model()
    f = html_extract.Forest([html_extract.Page(h) for h in html_extract.labelled_pages(60, seed=77)])
    assert ((f.marginals(*model) >= 0.5) == f.gold).mean() > 0.98


def test_short_and_bare_pages_keep_their_text():
    """Pages of little more than their article: no text is lost for want of surroundings, and what isn't the article still goes."""
    told = {
        "<article><p>One two three four five six seven eight nine ten eleven twelve.</p></article>": "One two three four five six seven eight nine ten eleven twelve.",
        "<article>Hello<div class='ad'>Buy now</div>world</article>": "Hello world",
        "<main>Plain line<br>another line<br>third line</main>": "Plain line another line third line",
        "<html><body><p>A first plain paragraph of some words.</p><p>And a second one that follows it.</p></body></html>": "A first plain paragraph of some words. And a second one that follows it.",
        "<article><p>Some text of the page here.</p></article><div role=contentinfo>(c) 2024</div>": "Some text of the page here.",
        "<html><body><nav><a href=/>Home</a> <a href=/b>News</a></nav><footer>(c) 2020</footer></body></html>": "",
        "<body><div class=menu><a href=/>a</a></div><div class='ad'>Buy</div></body>": "",
        "<body><h1>Title of it</h1><p>One paragraph.</p></body>": "Title of it One paragraph.",
    }
    assert html_extract.main_texts(list(told), html_extract.default_model()) == list(told.values())


def test_extract_keeps_rows_and_columns(spark):
    out = html_extract.extract(pages(spark))
    assert out.columns == ["page_id", "url", "path", "text"] and out.count() == 7
    assert html_extract.extract(pages(spark).limit(0)).count() == 0


def test_stray_quotes_do_not_leak_markup():
    model = html_extract.default_model()
    page = """<body><nav><a href="/">Home</a></nav><article><h1>Title here</h1><p title="5" tall">Hello there, this is the first paragraph of it.</p>
      <p class='a' b'>And a second one, which is long enough too.</p><p data-x=a"b>Third of them, no less of a sentence.</p><p title="a > b">Fourth and last one of all.</p></article></body>"""
    text = "Title here Hello there, this is the first paragraph of it. And a second one, which is long enough too. Third of them, no less of a sentence. Fourth and last one of all."
    assert html_extract.main_texts([page], model) == [text]


def test_deep_and_long_pages_take_time_in_proportion():
    model = html_extract.default_model()

    def took(n):
        page = "<article>" + "<div>" * n + "<p>Some words of a text." + "</div>" * n + "<p>More words, of a text.</p>" * n + "</article>"
        began = time.perf_counter()
        assert len(html_extract.main_texts([page], model)[0]) > 20 * n
        return time.perf_counter() - began

    took(100)
    assert took(20_000) < 14 * took(2_000) + 2


def test_query_gives_the_article_without_what_stands_around_it(spark, sf_dir):
    """The query over all pages, against a plain cut of the shared pages' own article element."""
    from html import unescape

    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in QUERIES["op8_html_extract"](spark, sf_dir).collect()}
    assert set(got) == set(html)
    alike = 0
    for i, h in html.items():
        inner = re.search(r"(?s)<(article|main)\b[^>]*>(.*)</\1>", h)
        want = " ".join(unescape(re.sub(r"<[^>]+>", " ", inner[2])).split()) if inner else None
        alike += want is not None and re.sub(r"\s", "", got[i]["text"]) == re.sub(r"\s", "", want)
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert alike >= 0.9 * sum("<article" in h or "<main" in h for h in html.values())
