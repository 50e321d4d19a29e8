"""Similarity join on word n-grams: MinHash candidates, Bayesian pruning, exact verification.

1. Every text becomes its set of hashed five-word shingles. Texts with equal sets are copies: they count as
   one representative with a number of documents, and are not expanded into pairs.
2. Representatives whose MinHash values agree on all rows of a band share a bucket (24 bands of 4 rows: two
   texts at the threshold share none with probability 3e-6). Buckets with the same members count once.
3. Buckets are cut into blocks of at most BLOCK representatives; a task compares one block with itself or
   with another. A pair is handled in the first band that it shares. MinHash values are compared in steps,
   and a pair is dropped when the posterior probability that its similarity reaches the threshold falls below
   TOLERANCE (uniform prior); the others are verified on their whole shingle sets.
4. What leaves a task is a row for each representative (links counted in documents, and the least member of
   its component within the block), not the pairs; components are merged by label propagation with checkpoints.

Defined cases: a text of one to four words is one shingle; null texts and texts without words have no
shingles, link to nothing and are classes of their own; repeated rows are copies; class ids are the least
doc_id of a class. `distinct_documents` keeps one row of each class with all columns.
"""

from __future__ import annotations

import re
from functools import cache
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, materialise

WORDS = 5
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
THRESHOLD = (4, 5)  # similarity 0.8
TOLERANCE = 1e-6
STEP = 16
BLOCK = 512
CACHED = 500_000

_WORD = re.compile(r"\w+")
_P = np.uint64(0x9E3779B97F4A7C15)
_seeds = np.random.default_rng(12345).integers(1, 1 << 62, (2, HASHES), dtype=np.uint64)
_A, _B = _seeds[0] | np.uint64(1), _seeds[1]
_known: dict[str, int] = {}


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of a whole text."""
    import xxhash

    words = _WORD.findall(text.lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(_known) > CACHED:
        _known.clear()
    for w in set(words).difference(_known):
        _known[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    k = min(WORDS, len(h))
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out = (out ^ (out >> np.uint64(29))) * _P + h[i : len(h) - k + 1 + i]
    return np.unique((out ^ (out >> np.uint64(32))) * _P)


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values, 32 bits each."""
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for low in range(0, len(s), 2048):
        part = s[low : low + 2048]
        best = np.minimum(best, ((part[:, None] * _A + _B) >> np.uint64(32)).astype(np.uint32).min(0))
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, of one signature or of rows of them."""
    rows = sig.reshape(*sig.shape[:-1], BANDS, ROWS).astype(np.uint64)
    h = rows[..., 0]
    for i in range(1, ROWS):
        h = (h ^ (h >> np.uint64(31))) * _P + rows[..., i]
    return ((h ^ (h >> np.uint64(32))) * _P).view(np.int64)


def _fingerprint(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, th, fp, keys): text hash, fingerprint of the shingle set (null: none), band keys."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                b = batch.slice(low, 512)
                fps, keys = [], []
                for t in b.column(2).to_pylist():
                    s = shingles(t)
                    fps.append(_fingerprint(s) if len(s) else None)
                    keys.append(band_keys(signature(s)) if len(s) else None)
                ends = np.cumsum([0] + [0 if k is None else BANDS for k in keys]).astype("<i4")
                flat = np.concatenate([k for k in keys if k is not None]) if ends[-1] else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "th", "fp", "keys"])

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, fp binary, keys array<long>")


@cache
def least_matches(n: int) -> int:
    """The fewest of n equal values at which the similarity still reaches the threshold with TOLERANCE."""
    t = THRESHOLD[0] / THRESHOLD[1]
    p, m = 0.0, -1
    while p < TOLERANCE:
        m += 1
        p += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
    return m


def linked_pairs(sigs: np.ndarray, sets: list[np.ndarray], band: int, cross: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x, y) of one block, or between its first `cross` rows and the rest, that are at the threshold and
    share no earlier band."""
    n = len(sigs)
    left, right = (np.arange(n), np.arange(n)) if cross is None else (np.arange(cross), np.arange(cross, n))
    keys = band_keys(sigs)
    open_ = keys[left, band][:, None] == keys[right, band][None, :]
    for b in range(band):
        open_ &= keys[left, b][:, None] != keys[right, b][None, :]
    if cross is None:
        open_ &= np.tri(n, k=-1, dtype=bool).T
    x, y = np.nonzero(open_)
    x, y = left[x], right[y]
    same = np.zeros(len(x), np.int32)
    for low in range(0, HASHES, STEP):
        if not len(x):
            break
        for c in range(0, len(x), 1 << 16):
            part = slice(c, c + (1 << 16))
            same[part] += (sigs[x[part], low : low + STEP] == sigs[y[part], low : low + STEP]).sum(1, dtype=np.int32)
        keep = same >= least_matches(low + STEP)
        x, y, same = x[keep], y[keep], same[keep]
    if not len(x):
        return x, y
    size = np.array([len(s) for s in sets])
    common = _common(sets, x, y)
    keep = THRESHOLD[1] * common >= THRESHOLD[0] * (size[x] + size[y] - common)
    return x[keep], y[keep]


def _common(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of given pairs."""
    if len(x) <= 64:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(x.tolist(), y.tolist(), strict=True)])
    used = np.unique(np.concatenate([x, y]))
    place = np.zeros(len(sets), int)
    place[used] = np.arange(len(used))
    values, column, count = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    shared = count[column] > 1  # what one member alone has is in no intersection
    new = np.cumsum(count > 1) - 1
    row, column = row[shared], new[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(used), len(used)), np.float32)
    width = 4096
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        m = np.zeros((len(used), width), np.float32)
        m[row[a:b], column[a:b] - low] = 1
        total += m @ m.T
    return total[place[x], place[y]].astype(np.int64)


def _block(rows: list[tuple], band: int, first: int, second: int) -> list[tuple[dict, dict, int]]:
    """(node, least node of its component here, documents linked) for one pair of blocks."""
    one = {r[0]: r for r in rows}  # a row of the input may repeat
    order = lambda r: (r[5]["known"], r[5]["doc_id"], r[5]["th"])
    rows = sorted(one.values(), key=lambda r: (r[1] != first, order(r)))
    cross = None if first == second else sum(r[1] == first for r in rows)
    sigs = np.array([np.frombuffer(r[3], np.uint32) for r in rows])
    sets = [np.frombuffer(r[4], np.uint64) for r in rows]
    x, y = linked_pairs(sigs, sets, band, cross)
    if not len(x):
        return []
    docs = np.array([r[2] for r in rows], np.int64)
    links = np.bincount(x, docs[y], len(rows)) + np.bincount(y, docs[x], len(rows))
    ranked = sorted(range(len(rows)), key=lambda i: order(rows[i]))
    label = np.empty(len(rows), int)
    label[ranked] = np.arange(len(rows))
    while True:
        least = label.copy()
        np.minimum.at(least, x, label[y])
        np.minimum.at(least, y, label[x])
        if (least == label).all():
            break
        label = least
    return [(r[5], rows[ranked[int(label[i])]][5], int(links[i])) for i, r in enumerate(rows) if links[i]]


def node(doc_id: Column, th: Column) -> Column:
    """A representative's name: its least document, in an order in which null doc_ids come first. The least node of a
    component is the class itself, so that no class has to be looked up by its label."""
    return F.struct(doc_id.isNotNull().cast("int").alias("known"), F.coalesce(doc_id, F.lit(0)).cast("long").alias("doc_id"), th.alias("th"))


NODE = "struct<known: int, doc_id: long, th: long>"


def _links(sketches: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Representatives (fp, docs, node) and, by block, (node, root, links)."""
    spark = docs.sparkSession
    own = sketches.where("fp is not null")
    reps = own.groupBy("fp").agg(F.count("*").alias("docs"), F.min(node(F.col("doc_id"), F.col("th"))).alias("node"), F.first("keys").alias("keys"))
    reps = materialise(reps, "ngram-reps")
    banded = reps.select("fp", "docs", "node", F.posexplode("keys").alias("band", "key"))
    of = F.xxhash64("fp")
    buckets = banded.groupBy("band", "key").agg(F.count("*").alias("m"), F.sum(of.bitwiseAND(F.lit((1 << 40) - 1))).alias("s"), F.bit_xor(of).alias("x")).where("m > 1")
    chosen = buckets.groupBy("m", "s", "x").agg(F.min(F.struct("band", "key")).alias("k")).select("k.band", "k.key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    members = materialise(banded.join(chosen, ["band", "key"]), "ngram-members")

    # Whole shingle sets of those representatives only.
    wanted = members.select("fp", "node").distinct()
    texts = docs.select(node(F.col("doc_id"), F.xxhash64("text")).alias("node"), "text").join(wanted, "node").select("fp", "text")

    def resketch(batches):
        import pyarrow as pa

        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                b = batch.slice(low, 256)
                sets = [shingles(t) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([signature(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["fp", "sig", "shingles"])

    data = texts.mapInArrow(resketch, "fp binary, sig binary, shingles binary")
    own_block = F.pmod(F.xxhash64(F.lit(3), "fp"), F.col("blocks")).cast("int")
    dealt = members.withColumn("own", own_block).select("fp", "docs", "node", "band", "key", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("fp", "docs", "node", "band", "key", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    grouped = dealt.join(data, "fp").repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j").select("band", "key", "i", "j", "fp", "own", "docs", "sig", "shingles", "node")

    def compare(batches):
        import pyarrow as pa

        def out(found):
            name = pa.struct([("known", pa.int32()), ("doc_id", pa.int64()), ("th", pa.int64())])
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (name, name, pa.int64()), strict=True)], names=["node", "root", "links"])

        now, held, found = None, [], []
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                b = batch.slice(low, 512)
                cols = [c.to_pylist() for c in b.columns]
                for band, key, i, j, *row in zip(*cols, strict=True):
                    if (band, key, i, j) != now:
                        if len(held) > 1:
                            found += _block(held, now[0], now[2], now[3])
                        now, held = (band, key, i, j), []
                        if len(found) > 5000:
                            yield out(found)
                            found = []
                    held.append(row)
        if len(held) > 1:
            found += _block(held, now[0], now[2], now[3])
        if found:
            yield out(found)

    found = grouped.mapInArrow(compare, f"node {NODE}, root {NODE}, links long")
    return reps.select("fp", "docs", "node"), materialise(found, "ngram-links")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each component of edges (u, v); labels travel along edges and then
    jump to their own label's label."""
    both = cut(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    while True:
        told = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("near"))
        step = cut(labels.join(told, labels["node"] == told["u"]).select("node", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved")))
        if step.where("moved").isEmpty():
            return labels
        up = step.select(F.col("node").alias("label"), F.col("label").alias("top"))
        labels = cut(step.select("node", "label").join(up, "label").select("node", F.least("label", "top").alias("label")))


def _classes(docs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(c_fp, n_links, class: the least node) for representatives with copies or links."""
    reps, found = _links(sketches, docs)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).distinct())
    some = reps.join(links, "node", "left").where("docs > 1 or links is not null").join(labels, "node", "left")
    return cut(some.select(F.col("fp").alias("c_fp"), (F.col("docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("label", "node").alias("class")))


def similar_classes(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, class_id, n_links (documents at the threshold, copies included)."""
    sketches = materialise(sketch(docs), "ngram-sketches")
    classes = _classes(docs, sketches)
    some = sketches.where("fp is not null").select("doc_id", "fp").join(classes, F.col("fp") == F.col("c_fp"), "left")
    own = F.when(F.col("class.known") == 1, F.col("class.doc_id"))
    out = some.select("doc_id", F.when(F.col("c_fp").isNull(), F.col("doc_id")).otherwise(own).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return out.unionByName(sketches.where("fp is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The document with the least (doc_id, text hash) of each class, with all its columns; rows that repeat
    a doc_id and a text give one."""
    sketches = materialise(sketch(docs), "ngram-sketches")
    classes = _classes(docs, sketches)
    some = sketches.where("fp is not null").select(node(F.col("doc_id"), F.col("th")).alias("own"), "fp").join(classes, F.col("fp") == F.col("c_fp"))
    # Never null, so that the join and the removal of repeats share one exchange.
    names = [fresh(docs, f"own_{f}") for f in ("known", "doc_id", "th")]
    fields = lambda c: {n: c[f] for n, f in zip(names, ("known", "doc_id", "th"), strict=True)}
    gone = some.where("own <> class").withColumns(fields(F.col("own"))).select(*names).distinct()
    th = F.coalesce(F.xxhash64("text"), F.lit(0))
    own = docs.withColumns(fields(node(F.col("doc_id"), th)))
    return own.join(gone, names, "left_anti").dropDuplicates(names).select(*[f"`{c}`" for c in docs.columns])
