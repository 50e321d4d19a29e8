import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import centroid_walk, hamming, whitening


@pytest.mark.parametrize("dims", [16, 64, 100])
def test_top_k_equals_brute_force(spark, dims):
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(400, dims))
    x[100:250] = x[0]  # many equal codes
    x[250:300] = x[1] * np.where(rng.random((50, dims)) < 0.1, -1, 1)
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    extra = [(1000, None), (1020, []), (None, x[5].tolist()), (0, x[0].tolist())]
    df = spark.createDataFrame(rows + extra, "vec_id long, embedding array<double>").withColumn("code", F.lit("x"))
    got = sorted(map(tuple, hamming.top_k(df, F.col("vec_id") % 20 == 0, k=7, block=64, queries=5).collect()))
    bits = x > 0
    want = []
    for q in range(0, 400, 20):
        d = (bits != bits[q]).sum(1)
        want += [(q, r + 1, int(i), int(d[i])) for r, i in enumerate(np.lexsort((np.arange(400), d))[:7])]
    assert got == want


def test_short_null_and_few(spark):
    df = spark.createDataFrame([(20, [1.0, None, -1.0]), (40, [1.0]), (7, [float("nan"), 2.0, 3.0])], "vec_id long, embedding array<double>")
    got = hamming.top_k(df, F.col("vec_id") % 20 == 0, k=10).collect()
    assert sorted((r["query_id"], r["neighbor_id"], r["distance"]) for r in got) == [(20, 7, 3), (20, 20, 0), (20, 40, 0), (40, 7, 3), (40, 20, 0), (40, 40, 0)]
    assert hamming.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


ODD = [(None, [0.5] * 8), (7, None), (8, [0.1] * 7 + [None]), (9, [0.1] * 7 + [float("nan")]), (10, [0.1] * 7 + [float("inf")]), (11, [0.25] * 3), (12, []), (13, [1e30] * 8), (0, [0.5] * 8)]


def test_other_columns_do_not_clash(spark):
    rows = [(i, [float((i * 7 + j * j) % 5 - 2) for j in range(16)]) for i in range(60)] + [(3, None), (None, [1.0] * 16), (20, [-2.0] * 16), (20, [-2.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    wide = df
    for name in ("code", "rank", "ids", "a", "b", "asked", "distance", "neighbor_id", "query_id"):
        wide = wide.withColumn(name, F.lit("x"))
    asked = F.col("vec_id") % 20 == 0
    plain = hamming.top_k(df, asked, k=5)
    got = hamming.top_k(wide, asked, k=5)
    assert got.columns == plain.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def odd_vectors(spark, n, dims=8, seed=1):
    """n vectors, a third of them equal, and rows that have no place; columns with clashing names."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)).round(3)
    x[: n // 3] = x[0]
    rows = [(i, v) for i, v in enumerate(x.tolist())] + ODD
    return spark.createDataFrame([(*r, 5, "c", 1.0) for r in rows], "vec_id long, embedding array<double>, label int, x string, row double")


def full_search(x, ids, k, rounds, seed):
    order = sorted(range(len(x)), key=lambda i: (ids[i] is None, hashlib.sha256(f"{seed}:{ids[i]}".encode()).hexdigest(), x[i].tolist()))
    c = x[order[:k]].copy()
    for r in range(rounds + 1):
        d = np.square(x[:, None] - c[None]).sum(2)
        at = d.argmin(1)
        if r < rounds:
            for j in range(len(c)):
                if (at == j).any():
                    c[j] = x[at == j].sum(0) // (at == j).sum()
    d = d.min(1)
    return [(ids[i], int(at[i]), int(d[i]), int(d[at == at[i]].sum()), int(d.sum()), c[at[i]].tolist()) for i in range(len(x))]


@pytest.mark.parametrize(("n", "k"), [(300, 8), (5, 8), (60, 25)])
def test_centroids_equal_full_search(spark, n, k):
    df = odd_vectors(spark, n)
    whole = centroid_walk.whole_vectors(df, dims=8, scale=1024)
    kept = whole.collect()
    ids, x = [r["vec_id"] for r in kept], np.array([r["x"] for r in kept])
    assert len(ids) == n + 2  # the null id and the repeated one
    assert np.array_equal(x[:n], np.floor(1024 * np.array([r["embedding"] for r in df.limit(n).collect()])).astype(int))
    start = F.asc_nulls_last(F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")).cast("binary"), 256))
    got = centroid_walk.cluster(whole, start, k, rounds=4).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, full_search(x, ids, k, 4, "3")))


def test_walk_takes_the_smaller_number_of_equal_distances():
    walk = centroid_walk.Walk(np.array([[4, 0], [0, 0], [0, 0], [4, 4]]))
    number, distance = walk.nearest(np.array([[2, 0], [0, 1], [2, 2], [9, 9]]))
    assert number.tolist() == [0, 1, 0, 3] and distance.tolist() == [4, 1, 8, 50]


def test_no_centroids(spark):
    assert centroid_walk.cluster(centroid_walk.whole_vectors(odd_vectors(spark, 3).limit(0), 8, 1024), F.asc("vec_id"), 8, 2).count() == 0


@pytest.mark.parametrize("elements", [1 << 18, 24])
def test_whitening_equals_numpy(spark, elements):
    df = odd_vectors(spark, 200)
    whole = whitening.whole_vectors(df, scale=64, shift=1_000_000)
    got = whitening.whiten(whole, components=5, elements=elements).collect()
    kept = [r for r in whole.collect() if len(r["x"]) == 8]
    x = np.array([r["x"] for r in kept])
    n, s = len(x), x.sum(0)
    c = x - s / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1], axes[:, ::-1]
    y = c @ axes[:, :5] / np.sqrt(values[:5])
    y *= np.sign(y[1]) * np.sign([r["whitened"] for r in sorted(got, key=lambda r: r["component"]) if r["vec_id"] == 1])
    want = sorted((str(r["vec_id"]), i + 1, int(np.square(n * x[a] - s).sum()), y[a, i]) for a, r in enumerate(kept) for i in range(5))
    have = sorted((str(r["vec_id"]), r["component"], r["deviation"], r["whitened"]) for r in got)
    assert len(kept) == 202 and [w[:3] for w in want] == [h[:3] for h in have]
    assert np.allclose([w[3] for w in want], [h[3] for h in have], atol=1e-9)
    assert {r["n"] for r in got} == {202} and max(r["identity_error"] for r in got) < 1e-9
    assert np.allclose([r["explained"] for r in got], [values[r["component"] - 1] / values.sum() for r in got], rtol=1e-9)


def test_whitening_without_variance(spark):
    df = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], "vec_id long, embedding array<float>")
    got = whitening.whiten(whitening.whole_vectors(df, 64, 1_000_000), 32).collect()
    assert sorted((r["vec_id"], r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got) == [(v, c, 0, 0.0, 0.0, 1.0) for v in (1, 2) for c in (1, 2)]
    assert whitening.whiten(whitening.whole_vectors(df.limit(0), 64, 1_000_000), 32).count() == 0


def test_deviation_beyond_a_long_is_null(spark):
    df = spark.createDataFrame([(1, [1e9]), (2, [-1e9]), (3, [0.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(whitening.whole_vectors(df, 64, 0), 1).collect()
    assert {r["vec_id"]: r["deviation"] for r in got} == {1: None, 2: None, 3: 0}
