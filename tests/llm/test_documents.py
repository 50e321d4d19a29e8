import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontam, line_dedup, license_scan, ngram_join, quality
from tidemark.llm.queries import QUERIES


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


# Quality


def test_quality_ranks_held_out_documents(spark, sf_dir):
    rows = QUERIES["op2_quality_ranking"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 10
    assert np.mean([(r["score"] >= 0.7) == (r["quality"] == 1) for r in rows]) > 0.9
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_quality_pairs_and_quantile():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, quality.N_FEATURES))
    y = (x[:, 3] + 0.1 * rng.normal(size=400) > -0.8).astype(int)
    model = quality.fit(x, y)
    scores = quality.apply_model(model, x)
    assert abs((scores < quality.CUT).mean() - (y == 0).mean()) < 0.02
    assert scores[y == 1].mean() > scores[y == 0].mean()
    flat = quality.fit(x, np.ones(400, int))
    assert (quality.apply_model(flat, x) == 1).all()


def test_quality_edge_rows(docs, no_docs, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (5, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    scored = quality.score(docs, model)
    assert scored.columns == ["doc_id", "text", "lang", "ids", "th", "score"] and scored.count() == docs.count()
    assert scored.where("score is null or score < 0 or score > 1").count() == 0
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.keep_good(no_docs, quality.train(no_docs, labels.limit(0))).count() == 0


def test_query_scores_equal_a_plain_fit(spark, sf_dir):
    """The query over all documents: features, pairs, fit and cut again without Spark."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    told = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    ids = sorted(set(told) & set(docs))
    x, y = np.array([quality.features(docs[i]) for i in ids]), np.array([told[i] for i in ids])
    model = quality.fit(x, y)
    got = {r["doc_id"]: r for r in QUERIES["op2_quality_ranking"](spark, sf_dir).collect()}
    assert set(got) == set(docs)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in docs)
    want = {i: quality.apply_model(model, quality.features(t)[None])[0] for i, t in docs.items()}
    # Both cuts are the same quantile, one interpolated, one between two ranks of a grid.
    assert np.mean([(want[i] >= quality.CUT) == (got[i]["predicted"] == 1) for i in docs]) > 0.95
    order = sorted(docs, key=lambda i: want[i])
    scores = [got[i]["score"] for i in order]
    assert all(b >= a - 1e-9 for a, b in zip(scores, scores[1:], strict=False))


# Lines


def test_recurring_templates_go_and_other_lines_stay(spark):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        body = [words(rng, 12) for _ in range(4)]
        rows.append((i, "\n".join([body[0], f"Posted on day {i} by the editors of this site", *body[1:], "short one"])))
    rows += [(100 + i, f"Only line number {i} of a text of nothing else") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone", F.lit("x"))
    out = {r["doc_id"]: r for r in line_dedup.drop_recurring(df, count="n").collect()}
    assert all("Posted" not in out[i]["text"] and "short one" not in out[i]["text"] and out[i]["n"] == 2 and len(out[i]["text"].split("\n")) == 4 for i in range(40))
    assert all(out[100 + i]["text"] == rows[40 + i][1] for i in range(20))  # near copies, which count as one
    assert out[0]["gone"] == "x"


def test_copies_of_a_text_do_not_make_its_lines_recur(spark):
    df = spark.createDataFrame([(i, "One line of five words\nanother line of five words") for i in range(30)], "doc_id long, text string")
    assert line_dedup.drop_recurring(df).select("text").distinct().count() == 1
    assert line_dedup.recurring_lines(df).count() == 0


def test_a_recurring_line_goes_where_it_is_most_of_a_text(spark):
    rng = random.Random(4)
    notice, body = words(rng, 60), [words(rng, 12) for _ in range(8)]
    rows = [(i, f"{words(rng, 3)}\n{words(rng, 3)}\n{notice}") for i in range(12)]  # short pages
    near = ["\n".join([*body[: i % 8], words(rng, 12), *body[i % 8 + 1 :], notice]) for i in range(16)]  # near copies
    rows += [(100 + i, t) for i, t in enumerate(near)] + [(200, notice)]
    out = {r["doc_id"]: r["text"] for r in line_dedup.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i] == t.removesuffix(notice).rstrip("\n") for i, t in rows)


@pytest.mark.parametrize("body", [1, 3, 6, 40])
def test_pages_lose_header_and_footer_however_short_their_bodies(spark, body):
    rng = random.Random(body)
    header, footer = words(rng, 13), words(rng, 13)
    rows = [(i, f"{header}\n{words(rng, body)}\n{footer}") for i in range(60)]
    copies = [(100 + i, "\n".join(["Near copies of one text", *(words(random.Random(j), 14) for j in range(9) if j != i % 9), words(rng, 14)])) for i in range(40)]
    out = {r["doc_id"]: r["text"] for r in line_dedup.drop_recurring(spark.createDataFrame(rows + copies, "doc_id long, text string")).collect()}
    assert all(out[i] == t.split("\n")[1] for i, t in rows)
    assert all(out[i] == t for i, t in copies)


def test_any_run_of_white_space_separates_tokens(spark):
    rng = random.Random(6)
    forms = ["Home\tNews\tSports\tWeather\tContact", "Home News  Sports Weather Contact", "  Home News Sports Weather Contact", "Home News Sports Weather Contact ", "Home News Sports Weather Contact\r"]
    rows = [(i, "\n".join([words(rng, 9), forms[i % 5], words(rng, 8) + "  x"])) for i in range(15)]
    out = {r["doc_id"]: r["text"] for r in line_dedup.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i].split("\n") == t.split("\n")[::2] for i, t in rows)


def test_a_long_line_recurs_from_two_texts_on_unless_they_are_near_copies(spark):
    rng = random.Random(8)
    passage, short = words(rng, 50), words(rng, 6)
    apart = [[words(rng, 60), passage, short, words(rng, 60)] for _ in range(2)]
    body = [words(rng, 15) for _ in range(9)]
    near = [[*body[:k], words(rng, 15), *body[k + 1 :]] for k in range(3)]
    rows = list(enumerate(map("\n".join, apart + near)))
    out = {r["doc_id"]: r["text"] for r in line_dedup.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i] == "\n".join(x for x in t.split("\n") if x != passage) for i, t in rows)


def test_dropping_lines_takes_time_in_proportion(spark):
    def took(n):
        text = "\n".join(f"line {'x' * (k % 7)} of many" for k in range(n))
        df = spark.createDataFrame([(k, text + f"\nlast {'yz' * k} one") for k in range(12)], "doc_id long, text string")
        drops = spark.createDataFrame([(1,)], "x int")
        gone = F.sequence(F.lit(0), F.lit(n - 1), F.lit(2))
        real, line_dedup.recurring_lines = line_dedup.recurring_lines, lambda d, m: df.select(F.unhex(F.md5("text")).alias("th")).crossJoin(drops).select("th", F.explode(gone).alias("pos"))
        try:
            began = time.perf_counter()
            assert line_dedup.drop_recurring(df).agg(F.max(F.length("text"))).first()[0] < 0.7 * len(text) + 100
            return time.perf_counter() - began
        finally:
            line_dedup.recurring_lines = real

    took(1000)
    assert took(40_000) < 12 * took(10_000) + 2


def test_names_of_columns_do_not_clash(spark):
    rows = [(i, f"Some words {'ab' * i} here\nAll rights reserved by us\nmore {'cd' * i} text", "a", "b", "c") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, gone string, th string")
    out = line_dedup.drop_recurring(df)
    assert out.columns == df.columns and all("reserved" not in r["text"] and (r["key"], r["gone"], r["th"]) == ("a", "b", "c") for r in out.collect())


def test_line_edge_rows(docs, no_docs):
    out = line_dedup.drop_recurring(docs, min_docs=2)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert sorted(map(str, out.select("doc_id", "text").collect())) == sorted(map(str, docs.select("doc_id", "text").collect()))
    assert line_dedup.drop_recurring(no_docs).count() == 0


# Similar documents


def brute_classes(rows):
    sets = [frozenset(ngram_join.shingles(t).tolist()) for _, t in rows]
    up = list(range(len(rows)))

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    links = Counter()
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                up[max(top(a), top(b))] = min(top(a), top(b))
    least = defaultdict(lambda: 10**9)
    for a, (i, _) in enumerate(rows):
        least[top(a)] = min(least[top(a)], i)
    return {i: (least[top(a)], links[a]) for a, (i, _) in enumerate(rows)}


def test_links_and_classes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)  # several blocks in a bucket
    rng, rows = random.Random(5), []
    for g in range(12):
        base = words(rng, rng.randint(3, 120)).split()
        for _ in range(rng.choice([1, 2, 5, 40])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = words(rng, 1)
            rows.append((len(rows) * 3 + g, " ".join(w)))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_pruning_bound_is_a_binomial_tail():
    for n in (16, 48, 96):
        m = ngram_join.least_matches(n)
        draws = np.random.default_rng(0).binomial(n, 0.8, 200_000)
        assert (draws < m).mean() < 1e-4 and 0 < m < n


def test_similar_edge_rows(docs, no_docs):
    got = ngram_join.similar_classes(docs).collect()
    assert sorted((r["class_id"], r["n_links"]) for r in got if r["doc_id"] in (1, 2)) == [(1, 2)] * 3
    assert all(r["class_id"] == r["doc_id"] and r["n_links"] == 0 for r in got if r["doc_id"] not in (1, 2))
    kept = ngram_join.distinct_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == ["1", "3", "4", "5", "6", "None"]
    assert ngram_join.similar_classes(no_docs).count() == 0 and ngram_join.distinct_documents(no_docs).count() == 0


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long")
    assert {r["node"]: r["label"] for r in ngram_join.components(edges).collect()} == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


# Benchmark


def edit_distance(a, b):
    p = list(range(len(b) + 1))
    for i, c in enumerate(a):
        q = [i + 1]
        for j, e in enumerate(b):
            q.append(min(p[j] + (c != e), p[j + 1] + 1, q[j] + 1))
        p = q
    return p[-1]


def test_edited_items_are_found_with_their_distance():
    rng = random.Random(8)
    items = [(i, words(rng, 30)) for i in range(30)]
    index = [decontam.Index(items)]
    for _ in range(150):
        i, text = rng.choice(items)
        s = list(text)
        for _ in range(rng.randint(0, int(len(text) * 0.05))):
            at = rng.randrange(len(s))
            s[at] = rng.choice("xyz")
        doc = decontam.normal(words(rng, 40) + " " + "".join(s) + " " + words(rng, 30))
        (found,) = [p for p in decontam.places(index, doc) if p[0] == i]
        assert edit_distance(doc[found[2] : found[3]], text) == found[1] <= edit_distance("".join(s), text)
    assert not decontam.places(index, words(rng, 5000))


def test_matches_do_not_depend_on_chunks_or_slices(spark, monkeypatch):
    rng = random.Random(9)
    items = [(i, words(rng, 25)) for i in range(20)] + [(50, None), (51, "short"), (52, items_copy := words(rng, 25)), (53, items_copy)]
    docs = [(k, words(rng, 300) + " " + items[k % 20][1].upper() + "  \n" + words(rng, 300)) for k in range(30)] + [(90, items_copy), (91, None), (92, "")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, decontam.find(d, b).collect()))
    assert {(i, t) for i, t, *_ in want} == {(k, k % 20) for k in range(30)} | {(90, 52)}
    monkeypatch.setattr(decontam, "SLICE", 400)
    monkeypatch.setattr(decontam, "SLICES_A_PASS", 2)
    monkeypatch.setattr(decontam, "CHUNK", 500)
    assert sorted(map(tuple, decontam.find(d, b).collect())) == want
    kept = decontam.drop_contaminated(d.withColumn("x", F.lit(1)), b)
    assert kept.columns == ["doc_id", "text", "x"] and sorted(r["doc_id"] for r in kept.collect()) == [91, 92]
    assert decontam.find(d, b.limit(0)).count() == 0 and decontam.find(d.limit(0), b).count() == 0


def test_indexes_of_two_benchmarks_are_told_apart():
    """Both have the same first and last item and the same number of items; one worker meets both."""
    rng = random.Random(10)
    first, last, a, b = (words(rng, 20) for _ in range(4))

    class Sent:
        def __init__(self, items):
            self.value = items

    one, two = [(1, first), (2, a), (3, last)], [(1, first), (2, b), (3, last)]
    digest = lambda items: decontam.hashlib.sha256(repr(items).encode()).hexdigest()
    doc = "some text before " + b + " and after"
    assert decontam.places(decontam._of([(digest(one), Sent(one))]), doc) == []
    assert [p[0] for p in decontam.places(decontam._of([(digest(two), Sent(two))]), doc)] == [2]


def test_short_items_are_whole_words(spark):
    d = spark.createDataFrame([(1, "It says Rule 42, twice: rule 42."), (2, "rule 421"), (3, "overrule 42"), (None, "RULE-42"), (4, "x"), (5, "no such thing")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "rule 42"), (8, "X!"), (9, " ?! "), (10, "")], "item_id long, text string")
    got = sorted(map(tuple, decontam.find(d.withColumn("item_id", F.lit(1)), b).collect()), key=str)
    assert got == sorted([(1, 7, 0, 8, 15), (None, 7, 0, 0, 7), (4, 8, 0, 0, 1)], key=str)
    kept = decontam.drop_contaminated(d.withColumn("item_id", F.lit(1)), b)
    assert kept.columns == ["doc_id", "text", "item_id"] and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 5]


def test_query_finds_what_a_full_search_finds(spark, sf_dir):
    """The query over all documents, against a search of every item in every document without filters."""
    docs = {r["doc_id"]: decontam.normal(r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {}
    for r in sorted(spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect(), key=lambda r: r["item_id"]):
        items.setdefault(decontam.normal(r["text"]), r["item_id"])
    rows = QUERIES["op7_decontamination"](spark, sf_dir).collect()
    whole = {(i, item) for i, t in docs.items() for x, item in items.items() if x in t}
    assert whole == {(r["doc_id"], r["item_id"]) for r in rows if r["n_edits"] == 0}
    text = {item: x for x, item in items.items()}
    for r in rows:
        assert edit_distance(docs[r["doc_id"]][r["start_at"] : r["end_at"]], text[r["item_id"]]) == r["n_edits"] <= decontam.EDITS * len(text[r["item_id"]])
    # Edited places: a scan with the plain recurrence over every diagonal of the documents that share a long word run.
    found = {(r["doc_id"], r["item_id"]) for r in rows}
    for i, t in docs.items():
        c = decontam.codes(t)
        for x, item in items.items():
            w = x.split(" ")
            runs = {" ".join(w[k : k + 4]) for k in range(0, len(w) - 3, 4)}
            if (i, item) not in found and sum(run in t for run in runs) >= max(2, len(runs) // 2) and len(x) <= 2000:
                edits, _ = decontam._distance(decontam.codes(x), c, -len(x), len(c))
                assert edits > len(x) // 20  # 5 %


@pytest.mark.parametrize("length", range(12, 64))
def test_every_edit_that_five_percent_allow_is_found(length):
    """One letter changed, left out or put in, at every place of an item, for each edit that 5 % of its length allow."""
    rng = random.Random(length)
    item = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(length))
    indexes = decontam.indexes_of([(1, item), (2, "quite another item of more than twenty letters")])
    for at in range(length):
        text = list(item)
        for k in range(length // 20):
            p = (at + 20 * k) % length
            text[p] = {0: "0", 1: "", 2: text[p] + "7"}[(at + k) % 3]
        found = decontam.places(indexes, "some words before " + "".join(text) + " and after")
        assert [p[0] for p in found] == [1] and found[0][1] <= length // 20, (at, "".join(text))


def test_items_equal_in_normal_form_are_one_whatever_the_slices(spark, monkeypatch):
    rows = [(3, "What is the capital of France, they asked?"), (1, "what is the capital  of france they asked"), (2, "Another question altogether, of some length")]
    b = spark.createDataFrame(rows, "item_id long, text string")
    d = spark.createDataFrame([(1, "x what is THE capital of france they asked y")], "doc_id long, text string")
    for size in (1_000_000, 10):
        monkeypatch.setattr(decontam, "SLICE", size)
        assert [(r["doc_id"], r["item_id"]) for r in decontam.find(d, b).collect()] == [(1, 1)]


# Licences


def test_base_places_and_rare_token_matches(spark):
    texts = [
        (1, "Licensed under the Apache License, Version 2.0.\nAll rights reserved; all RIGHTS reserved"),
        (2, "cc by cc-by CC  BY, ccby c cby"),
        (3, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
        (4, "apache version 2 0 license the licensed under"),
        (5, None), (6, ""), (1, "Licensed under the Apache License, Version 2.0.\nAll rights reserved; all RIGHTS reserved"),
        (None, "GNU General Public License"), (7, "x " * 100_000 + "general public license"),
    ]
    out = license_scan.scan(spark.createDataFrame(texts, "doc_id long, text string").withColumn("h", F.lit(1))).collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert len(out) == len(texts)
    for r in out:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (dict(texts)[r["doc_id"]] or "").translate(low))
        places = [(i, label) for p, label in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
    by = {r["doc_id"]: r["labels"] for r in out}
    assert by[1] == "apache-2.0,reserved" and by[3] == "mit" and by[4] == "" and by[2] == "cc-by"
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_key_phrase_alone_is_no_licence(spark):
    bsl = next(t for label, t, _ in license_scan.TEMPLATES if label == "bsl-1.0")
    rng = random.Random(2)
    texts = ["Permission is hereby granted, free of charge, to visit the park", "we do not use the mit license here", bsl, "Released under the MIT License.", "licensed under CC BY-NC 4.0"]
    rows = list(enumerate(texts)) + [(10 + i, words(rng, 30) + " and the licensed under a person to any of this") for i in range(60)]
    out = {r["doc_id"]: r["labels"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[i] for i in range(5)] == ["", "", "bsl-1.0", "mit", "cc-by,cc-by-nc"] and not any(out[10 + i] for i in range(60))


def test_license_words_weigh_and_time_is_in_proportion(spark):
    rng = random.Random(12)
    mit = next(t for label, t, _ in license_scan.TEMPLATES if label == "mit")
    half = mit.split()[: len(mit.split()) // 2]
    rows = [(1, words(rng, 30) + " " + mit.upper() + "."), (2, " ".join(half)), (3, mit.replace("permission", "license", 1))] + [(10 + i, words(rng, 20)) for i in range(20)]
    out = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == ("mit", 1.0) and out[2][0] == "mit" and 0.2 < out[2][1] < 0.8 and out[3] == ("", 0.0)
    assert all(out[10 + i] == ("", 0.0) for i in range(20))

    def took(n):
        df = spark.createDataFrame([(1, "license by 1 general " * (n // 4))], "doc_id long, text string")
        began = time.perf_counter()
        assert license_scan.scan(df).first()["n_words"] == n
        return time.perf_counter() - began

    took(400)
    assert took(200_000) < 14 * took(20_000) + 3


def test_names_of_the_join_do_not_clash(spark):
    rows = [(1, "one two three four five six seven", "a", "b", "c"), (2, "one two three four five six seven", "d", "e", "f"), (None, "else " * 9, "g", "h", "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, own_known string, own_doc_id string, own_th string")
    kept = ngram_join.distinct_documents(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[2]], key=str)


def test_bands_miss_no_pair_of_the_shared_documents(spark, sf_dir):
    """Recall of the candidate search over all documents: every pair at the threshold shares a band."""
    sets = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        s = ngram_join.shingles(r["text"])
        if len(s):
            sets[s.tobytes()] = s
    sets = list(sets.values())
    keys = [ngram_join.band_keys(ngram_join.signature(s)) for s in sets]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if 5 * (n := len(np.intersect1d(sets[a], sets[b], assume_unique=True))) >= 4 * (len(sets[a]) + len(sets[b]) - n)]
    assert pairs and all((keys[a] == keys[b]).any() for a, b in pairs)


def test_query_gives_the_classes_and_links_of_a_full_comparison(spark):
    from tidemark.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in QUERIES["op5_ngram_jaccard"](spark, folder).collect()}
    assert len(got) == len(rows) and got == brute_classes(rows)
    assert sum(n > 0 for _, n in got.values()) > 20  # there is something to find
