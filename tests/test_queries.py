"""Every query with SQL is compared with DuckDB on the smallest shared tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if hasattr(v, "year"):
        return str(pd.Timestamp(v))
    if isinstance(v, (bool, np.bool_, str)):
        return str(v)
    return repr(float(v))


def rows(df):
    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, sf_dir):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in ORACLE_SQL:
        assert len(got) > 0
        return
    want = duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_outcomes_and_returns_cover_every_pick(spark, sf_dir):
    from tidemark.queries import base

    picks = base.picks(spark, sf_dir).select("scenario_id", "code", "first_date").toPandas()
    first = base.prices(spark, sf_dir).groupBy("code").agg({"date": "min"}).toDF("code", "first").toPandas().set_index("code")["first"].to_dict()
    cases = [i for i, c, day in picks.itertuples(index=False) if c in first and first[c] <= day]
    assert sorted(QUERIES["excess_return_window"](spark, sf_dir).toPandas()["scenario_id"]) == sorted(picks["scenario_id"])
    assert sorted(QUERIES["past_case_outcomes"](spark, sf_dir).toPandas()["scenario_id"]) == sorted(cases)


def test_event_clusters_equal_a_loop(spark, sf_dir):
    """The query itself, over all documents, against a plain scan of all clusters."""
    import hashlib
    import re

    from tests.test_operators import brute_clusters
    from tidemark.functions import text as tx
    from tidemark.queries import base
    from tidemark.queries.events import NAMES

    items = sorted((r["ts"].date(), r["ts"], r["id"], r["title"], r["source"], r["kind"], r["code"]) for r in base.items(spark, sf_dir).collect())
    want = {}
    for day in {i[0] for i in items}:
        own = [i for i in items if i[0] == day]
        for i, label in zip(own, brute_clusters([i[3] for i in own], NAMES), strict=True):
            want.setdefault((str(day), label), []).append(i)
    got = {(str(r["day"]), r["cluster_no"]): r for r in QUERIES["greedy_event_clusters"](spark, sf_dir).collect()}
    assert set(got) == set(want)
    for key, rows_ in want.items():
        r = got[key]
        assert (r["n_items"], r["media_count"]) == (len(rows_), len({i[4] for i in rows_}))
        first, ids = min(i[1] for i in rows_), {k: ",".join(str(i[2]) for i in sorted(rows_, key=lambda i: i[2]) if (i[5] == "disclosure") == (k == "disclosure_ids")) for k in ("news_ids", "disclosure_ids")}
        assert (r["first_observed_at"], r["news_ids"], r["disclosure_ids"]) == (first, ids["news_ids"], ids["disclosure_ids"])
        assert r["codes"] == ",".join(sorted({i[6] for i in rows_ if i[6]})) and r["has_disclosure"] == any(i[5] == "disclosure" for i in rows_)
        noise = re.compile(tx.NOISE)
        names = sorted(set(re.findall(NAMES, r["title"])))[:3]
        novelty = hashlib.sha256(f"{'|'.join(names)}::{noise.sub('', ' '.join(r['title'].split()))}".encode()).hexdigest()
        assert r["event_id"] == hashlib.sha256(f"{key[0]}::{novelty}".encode()).hexdigest()
        assert r["title"] == min(rows_, key=lambda i: (-len(i[3]), i[1], i[2]))[3]
        assert r["entities"] == ",".join(sorted({e for i in rows_ for e in re.findall(NAMES, i[3])}))
    assert tx.NOISE and any(len(v) > 1 for v in want.values())


def test_event_gate_equals_the_gate_over_clusters_of_a_loop(spark, duck, sf_dir):
    """Clusters by a loop in Python, their verdicts by the SQL of the gate."""
    import re

    from tests.test_operators import brute_clusters
    from tidemark.queries import base
    from tidemark.queries.events import _GATE, NAMES

    items = sorted((r["ts"].date(), r["ts"], r["id"], r["title"], r["source"], r["code"]) for r in base.items(spark, sf_dir).collect())
    told = []
    for day in sorted({i[0] for i in items}):
        own = [i for i in items if i[0] == day]
        groups = {}
        for i, label in zip(own, brute_clusters([i[3] for i in own], NAMES), strict=True):
            groups.setdefault(label, []).append(i)
        for g in groups.values():
            title = min(g, key=lambda i: (-len(i[3]), i[1], i[2]))[3]
            told.append((min(i[2] for i in g), title, pd.Timestamp(day), len({i[4] for i in g}), sorted({i[5] for i in g if i[5]})))
    events = pd.DataFrame(told, columns=["id", "title", "ts", "media_count", "codes"])
    duck.register("event_rows", events)
    sql = _GATE.replace("SELECT day, grp, count(DISTINCT source) AS media_count FROM hashed GROUP BY 1, 2", "SELECT day, grp, media_count FROM hashed")
    sql = sql.replace("list_sort(names)[1] AS grp", "CAST(id AS VARCHAR) AS grp").replace("coalesce(list_contains(codes, h.code), false)", "list_has_any(active.codes, h.codes)")
    sql = sql.replace("CASE WHEN h.id % 17 = 0 THEN '上方修正' || h.title ELSE h.title END", "h.title").replace("CAST(media_count AS DOUBLE)", "CAST(m.media_count AS DOUBLE)")
    sql = re.sub(r"\bFROM items\b", "FROM event_rows", sql)
    want = duck.sql(f"WITH {base.CTE['attn']}, {sql} SELECT id, round(score, 6) AS score, inn AND NOT over_cap AS passed, inn AND forced AS forced_in FROM lim").df()
    got = QUERIES["event_gate"](spark, sf_dir).toPandas()
    columns = ["id", "score", "passed", "forced_in"]
    assert rows(got[columns]) == rows(want[columns]) and got["passed"].any() and got["event_id"].is_unique


def test_entry_has_every_query():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
