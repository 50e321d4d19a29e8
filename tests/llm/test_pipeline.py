import zlib

import corpus_pipeline
import numpy as np
import pytest

from tidemark.llm import decontam, ngram_join, quality


@pytest.fixture(scope="module")
def staged(spark, sf_dir):
    from tidemark.llm.common import materialise

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        out.append(docs)
    return out


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_every_stage_but_the_last_returns_the_columns_of_documents(staged):
    for df in staged[:-1]:
        assert df.columns == staged[0].columns


def test_quality_stage_drops_bad_and_keeps_good(spark, sf_dir, staged):
    kept = rows(staged[1])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(i in kept) == (labels[i] == 1) for i in held]) > 0.9
    model = quality.train(staged[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = {i for i, t in rows(staged[0]).items() if quality.apply_model(model, quality.features(t)[None])[0] >= quality.CUT}
    assert set(kept) == want


def test_line_stage_only_takes_lines_away(staged):
    before, after = rows(staged[1]), rows(staged[2])
    assert set(before) == set(after)
    for i, t in after.items():
        lines = iter(before[i].split("\n"))
        assert all(x in lines for x in t.split("\n"))


def test_near_duplicate_stage_keeps_one_of_each_class(staged):
    before, after = rows(staged[2]), rows(staged[3])
    sets = {i: frozenset(ngram_join.shingles(t).tolist()) for i, t in before.items()}
    ids, up = sorted(before), {i: i for i in before}
    for a in ids:
        for b in ids:
            if b < a and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = a, b
                while up[x] != x:
                    x = up[x]
                while up[y] != y:
                    y = up[y]
                up[max(x, y)] = min(x, y)
    assert set(after) == {i for i in ids if up[i] == i}


def test_benchmark_stage_drops_documents_with_an_item(spark, sf_dir, staged):
    items = [decontam.normal(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before, after = rows(staged[3]), rows(staged[4])
    holds = {i for i, t in before.items() if any(x in decontam.normal(t) for x in items)}
    assert holds and not holds & set(after)
    assert len(set(before) - set(after) - holds) <= 0.01 * len(before)


def test_last_stage_encodes_what_is_left(staged):
    assert staged[5].count() == staged[4].count() and {"doc_id", "ids", "n_tokens"} <= set(staged[5].columns)


@pytest.mark.parametrize("name", ["docs", "no_docs"])
def test_every_stage_takes_odd_rows(name, request, spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, an empty table, and columns with clashing names."""
    docs = request.getfixturevalue(name)
    docs = docs.withColumnsRenamed({"ids": "key"}).withColumn("n_chars", docs["doc_id"])
    spark.createDataFrame([(1, 1, 0), (3, 0, 0), (5, 1, 0), (None, 1, 0), (6, 0, None), (99, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a benchmark item that no document here has in it"), (None, "x y"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    n = docs.count()
    for stage, run in corpus_pipeline.STAGES:
        out = run(spark, docs, str(tmp_path))
        assert out.count() <= n
        if stage == corpus_pipeline.STAGES[-1][0]:
            assert {"doc_id", "ids", "n_tokens"} <= set(out.columns) and out.count() == n
            assert all(len(r["ids"]) == r["n_tokens"] for r in out.collect())
        else:
            assert out.columns == docs.columns
