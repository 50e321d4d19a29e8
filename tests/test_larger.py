"""Queries with SQL on tables as larger copies have them: long keys, many copies."""

import duckdb
import pytest

from tests.test_queries import rows
from tidemark.queries import ORACLE_SQL, QUERIES


def compared(name, spark, sf_dir, folder, **changed):
    """The query's rows equal those of its SQL where tables have other rows: SQL by the table's name."""
    con = duckdb.connect()
    for t in "customer supplier orders lineitem events documents pages benchmark".split():
        con.execute(f"COPY ({changed.get(t, '{t}').format(t=f'FROM read_parquet({sf_dir!r} || {f"/{t}.parquet"!r})')}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, want = QUERIES[name](spark, str(folder)).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(want) > 0
    assert rows(got) == rows(want)
    return got


@pytest.mark.parametrize("name", ["commit_kinds", "commit_warnings"])
def test_the_commit_keeps_codes_of_five_digits_apart(name, spark, sf_dir, tmp_path):
    """Keys on both sides of 10,000, some of which share their first four digits; the order of a scenario's candidates is by number."""
    code = "9990 + {k} * 7 % 40"
    lines = f"SELECT * REPLACE ({code.format(k='l_suppkey')} AS l_suppkey, 1 + l_linenumber % 3 AS l_linenumber) {{t}}"
    compared(name, spark, sf_dir, tmp_path, supplier=f"SELECT * REPLACE ({code.format(k='s_suppkey')} AS s_suppkey) {{t}} QUALIFY row_number() OVER (PARTITION BY s_suppkey * 7 % 40) = 1", lineitem=lines)


@pytest.mark.parametrize("name", ["gate_decisions", "daily_pack"])
def test_the_gate_asks_for_one_strong_kind(name, spark, sf_dir, tmp_path):
    """Texts that hold another strong kind by chance, as "TOB" in capitals, aren't strong."""
    text = "CASE WHEN doc_id % 5 = 0 THEN 'THE TOBLE' || text ELSE text END"
    got = compared(name, spark, sf_dir, tmp_path, documents=f"SELECT * REPLACE ({text} AS text, doc_id * 20 AS doc_id) {{t}}")  # on many days
    assert len(got) > 0


def test_name_pairs_form_no_pair_that_does_not_fit(spark, sf_dir, tmp_path):
    """All names in one nation: texts meet by equal parts, not as every customer with every supplier. Names of other forms too."""
    one = "SELECT * REPLACE ({n} AS {c}name, 7 AS {c}nationkey) {{t}}".format
    customer = one(c="c_", n="CASE WHEN c_custkey % 9 = 0 THEN 'Größe ' || c_custkey WHEN c_custkey % 9 = 1 THEN '' WHEN c_custkey % 9 = 2 THEN 'aaaa' ELSE c_name END")
    supplier = one(c="s_", n="CASE WHEN s_suppkey % 3 = 0 THEN 'öße' WHEN s_suppkey % 3 = 1 THEN 'aaaaaa' || s_suppkey ELSE '1' || s_suppkey END")
    got = compared("name_match_containment", spark, sf_dir, tmp_path, customer=customer, supplier=supplier)
    assert len(got) == len(got.drop_duplicates())
    plan = QUERIES["name_match_containment"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" not in plan and "contains" not in plan


def test_items_meet_those_before_across_blocks_and_gaps(spark):
    """Ids on both sides of a block's end, negative ones, gaps and odd white space; equal to the plain expressions."""
    from pyspark.sql import functions as F

    from tidemark.functions import text as tx
    from tidemark.operators import events as ops

    texts = ["", None, "a", "Großer Händler heute", "Großer Händler\x85gestern", "Groß\x1cer Händler", "、。", "heute heute Händler"]
    ids = [i for i in range(-3, 520) if i % 50 != 7]
    items = spark.createDataFrame([(i, texts[(i * 5 + i // 7) % len(texts)]) for i in ids], "id long, title string")
    told = {(r["id"], r["before"]): r["similarity"] for r in ops.to_previous(items, "[A-Za-zÀ-ÿ]{5,}").collect()}
    i = items.select("id", tx.bigrams(F.col("title")).alias("g"), tx.entities(F.col("title"), "[A-Za-zÀ-ÿ]{5,}").alias("n"))
    p = i.select((F.col("id") + 1).alias("id"), F.col("id").alias("before"), F.col("g").alias("pg"), F.col("n").alias("pn"))
    want = i.join(p, "id").select("id", "before", F.greatest(tx.jaccard(F.col("g"), F.col("pg")), tx.jaccard(F.col("n"), F.col("pn"))).alias("s"))
    assert told == {(r["id"], r["before"]): r["s"] for r in want.collect()} and len(told) > 400


def test_a_cluster_meets_a_long_text_at_the_cost_of_its_tokens():
    """Masks of long texts are built in time near their tokens."""
    import time

    from tidemark.operators.events import Clusters

    k = Clusters(0.5)
    tokens = k.tokens({f"word{i}" for i in range(60_000)})
    k.start()
    at = time.process_time()
    k.add(0, tokens, k.mask(tokens))
    assert time.process_time() - at < 1.0 and k.sizes == [60_000] and k.masks == [(1 << 60_000) - 1]
    assert k.near(tokens) == {0} and k.similarity(k.mask(tokens), 60_000, 0) == 1.0


def test_events_are_told_where_their_items_are_clustered(spark, sf_dir):
    """Equal to the clusters and to the aggregation apart, with odd white space and characters; a day's texts are dealt out once."""
    from pyspark.sql import functions as F

    from tests.test_operators import brute_clusters
    from tidemark.functions import text as tx
    from tidemark.operators import events as ops
    from tidemark.queries.events import clustered_events

    entity = "[A-Za-zÀ-ÿ]{5,}|[ァ-ヶー]{2,}"
    texts = ["", None, "a", " a\t", "Großer Händler heute", "Großer Händler\x85heute!", "Groß\x1cer Händler", "、。", "heute\u3000heute Händler", "😀😀a", "😀a", "東京電力、アメリカ", "東京電力アメリカ - NHK", "ab", "ba"]
    rows = [(i % 3, i, texts[i * 7 % len(texts)], "disclosure" if i % 4 == 0 else "news", f"s{i % 5}" if i % 6 else None, i // 2, str(i % 9) if i % 4 == 0 else None) for i in range(90)]
    items = spark.createDataFrame(rows, "day int, id long, title string, kind string, source string, ts int, code string")
    clustered = ops.cluster(items, ["day"], ["ts", "id"], entity=entity)
    for day in range(3):
        own = [r["cluster_no"] for r in clustered.where(F.col("day") == day).orderBy("ts", "id").collect()]
        assert own == brute_clusters([r[2] or "" for r in rows if r[0] == day], entity)
    want = ops.to_events(clustered, ["day"], entity).withColumn("novelty", tx.novelty_hash(F.col("title"), tx.entities(F.col("title"), entity)))
    for entities in (True, False):
        got = ops.group_events(items, ["day"], ["ts", "id"], entity=entity, entities=entities)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect())) and len(got.columns) == 11 + entities
    events = clustered_events(spark, sf_dir)
    assert events._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_the_index_of_clusters_misses_none():
    """More clusters than are compared without it: short and long texts against a plain scan."""
    import random

    from tests.test_operators import brute_clusters
    from tidemark.operators.events import FEW, _labels

    rng = random.Random(5)
    heads = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzあいうえお") for _ in range(rng.choice([1, 2, 5, 9, 24]))) for _ in range(500)]
    titles = [h + rng.choice(["", "", "x", "yz"]) for h in (rng.choice(heads) for _ in range(1200))]
    found = _labels(titles, [set() for _ in titles], 0.5)
    assert found == brute_clusters(titles, "(?!)") and len(set(found)) > FEW + 50
