"""Exact top-k search among binary codes by incremental multi-index hashing.

Vectors become sign codes. A code is cut into 16-bit segments, and each segment has a table from value to
codes. Two codes within distance m(s + 1) - 1, m the number of segments, agree in some segment up to s bits;
so a query looks up values at segment radius 0, 1, 2, ... and stops as soon as its k-th verified distance is
within what the radius reached provably covers. Results are exact, ties go to the smaller id.

Equal codes count once: a code stands with its k smallest ids (a windowed limit that is applied before the
shuffle too), which is all that any query can need, and equal queries are searched once. The query set meets all
rows in blocks: distinct codes are dealt into blocks of BLOCK expected codes, queries into blocks of QUERIES; a task
indexes one block of codes and grows the radii of one block of queries, and the k best of each block are merged. A
code is sent once for each block of queries, so for a fixed number of queries what is shuffled grows with the
rows. (Radii as rounds of joins on segment values would send a probe for each value in a radius, some 10,000 a query
at the distances of random codes, which is more than the rows of a block.)

Defined cases: rows with a null id or a null or empty vector have no code and take no part; null elements
and missing ones at a vector's end count as not positive; repeated rows of one id count once; fewer than k
rows give fewer than k neighbours; a query finds itself, at distance 0. Extra columns aren't read.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 17
QUERIES = 1 << 14


def sign_codes(vectors: DataFrame, dims: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, code): one bit for each dimension, set where the element is positive."""
    wide = (dims + 63) // 64 * 8

    def run(batches):
        import pyarrow as pa

        for b in batches:
            lists = b.column(1)
            ends = lists.offsets.to_numpy()
            x = np.nan_to_num(lists.values.to_numpy(zero_copy_only=False).astype(np.float64), nan=0.0) > 0
            size = np.diff(ends)
            bits = np.zeros((len(size), wide * 8), bool)
            row = np.repeat(np.arange(len(size)), size)
            bits[row, np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], size)] = x[ends[0] : ends[-1]]
            packed = np.packbits(bits, axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in packed], pa.binary())], names=["vec_id", "code"])

    some = vectors.where(F.col(id_col).isNotNull() & (F.size(vector) > 0)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>"))
    return some.mapInArrow(run, "vec_id long, code binary")


@cache
def _masks(s: int) -> np.ndarray:
    every = np.arange(1 << 16, dtype=np.uint16)
    return every[np.bitwise_count(every) == s]


class Tables:
    """The segment tables of one block of distinct codes."""

    def __init__(self, codes: list[bytes], least: list[int]) -> None:
        self.words = np.frombuffer(b"".join(codes), np.uint64).reshape(len(codes), -1)
        self.least = np.array(least, np.int64)
        segments = self.words.view(np.uint16)
        self.m = segments.shape[1]
        self.order = [np.argsort(segments[:, j], kind="stable") for j in range(self.m)]
        self.start = [np.searchsorted(segments[o, j], np.arange((1 << 16) + 1)) for j, o in enumerate(self.order)]
        self.seen = np.zeros(len(codes), bool)

    def nearest(self, code: bytes, k: int) -> list[tuple[int, int]]:
        """(distance, place) of the k nearest codes, by distance and least id."""
        q = np.frombuffer(code, np.uint64)
        parts = q.view(np.uint16)
        found, dist, s = [], [], 0
        n, total = len(self.least), 0
        while True:
            for j in range(self.m):
                v = (parts[j] ^ _masks(s)).astype(np.int64)
                low, high = self.start[j][v], self.start[j][v + 1]
                some = high > low
                low, count = low[some], (high - low)[some]
                if not len(count):
                    continue
                at = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                got = self.order[j][at]
                got = got[~self.seen[got]]
                self.seen[got] = True
                found.append(got)
                dist.append(np.bitwise_count(self.words[got] ^ q).sum(1, dtype=np.int64))
                total += len(got)
            if total >= min(k, n):
                d = np.concatenate(dist)
                kth = int(np.partition(d, min(k, n) - 1)[min(k, n) - 1])
                if kth <= self.m * (s + 1) - 1 or total == n:
                    break
            s += 1
        places = np.concatenate(found)
        self.seen[places] = False
        close = d <= kth
        places, d = places[close], d[close]
        best = np.lexsort((self.least[places], d))[:k]
        return list(zip(d[best].tolist(), places[best].tolist(), strict=True))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """Every query against all rows: query_id, rank (1 to k), neighbor_id, distance."""
    from .common import cut

    dims = vectors.agg(F.max(F.size("embedding"))).first()[0]
    codes = cut(sign_codes(vectors, max(1, dims or 1)).distinct())
    smallest = Window.partitionBy("code").orderBy("vec_id")
    some = codes.withColumn("rank", F.row_number().over(smallest)).where(F.col("rank") <= k)
    members = cut(some.groupBy("code").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))  # at most k ids each
    asked = codes.where(is_query)
    wanted = cut(asked.select("code").distinct())
    n_wanted = wanted.count()
    spread = min(vectors.sparkSession.sparkContext.defaultParallelism, -(-n_wanted // 128))  # few queries: at least a task for each core
    n_blocks, n_asked = -(-members.count() // block) or 1, max(-(-n_wanted // queries), spread) or 1
    deal = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "code"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    stored = members.select(deal(1, n_blocks).alias("b"), "code", "ids").select("b", every(n_asked).alias("a"), "code", "ids")
    probes = wanted.select(deal(2, n_asked).alias("a"), "code").select("a", every(n_blocks).alias("b"), "code")

    def answer(left, right):
        import pandas as pd

        rows = []
        if len(left) and len(right):
            tables = Tables(list(right["code"]), [int(x[0]) for x in right["ids"]])
            ids = list(right["ids"])
            for q in left["code"]:
                rows += [(q, d, ids[p]) for d, p in tables.nearest(q, k)]
        return pd.DataFrame(rows, columns=["asked", "distance", "ids"])

    best = probes.groupBy("a", "b").cogroup(stored.groupBy("a", "b")).applyInPandas(answer, "asked binary, distance int, ids array<long>")
    near = best.select("asked", "distance", F.explode("ids").alias("neighbor_id"))
    rank = F.row_number().over(Window.partitionBy("asked").orderBy("distance", "neighbor_id"))
    merged = near.withColumn("rank", rank).where(F.col("rank") <= k)
    return asked.join(merged, asked["code"] == merged["asked"]).select(F.col("vec_id").alias("query_id"), "rank", "neighbor_id", "distance")
