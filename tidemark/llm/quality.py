"""Quality scores by Bradley-Terry pairwise ranking.

Of two documents with different labels the better one is preferred. The score is linear in features of the
text's form (lengths, character classes, repetition), and the weights minimise the logistic loss of feature
differences over preference pairs. The cut is a quantile of the scores of all labelled documents that may be learnt
from: the share of them that is labelled 0 (to a thousandth, by a sketch). A monotone map puts the
cut at CUT and gives scores from 0 to 1.

The fit uses a bounded sample of labelled documents (`sample`, chosen by hash) and a bounded number of pairs
(`pairs`); both are small whatever the corpus. Features of the sample come from the same code as those of
the corpus. Scoring is one pass without a shuffle over whole texts.

Defined cases: null and empty texts have the features of a text without words; doc_ids that labels
contradict each other on, and null ones, aren't learnt from; where one class is missing the weights are 0
and every document gets the score 1; extra columns pass through `keep_good` untouched.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut as cut_lineage

CUT = 0.7
SAMPLE = 20_000
PAIRS = 60_000
ACCURACY = 50_000

_CLASS = np.zeros(256, np.int64)
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[48:58] = 2
_CLASS[65:91] = 3
_CLASS[97:123] = 4
_CLASS[128:192] = 6
_CLASS[192:] = 7
for _c in b".,;:'\"-()":
    _CLASS[_c] = 5
N_FEATURES = 20


def features(text: str | None) -> np.ndarray:
    """Numbers on a text's form; a linear pass over the whole text."""
    x = np.zeros(N_FEATURES)
    words = text.split() if text else []
    if not words:
        return x
    raw = np.frombuffer(text.encode(), np.uint8)
    n = len(raw)
    count = np.bincount(_CLASS[raw], minlength=8)
    size = n - count[6]  # continuation bytes aren't characters
    lines = text.split("\n")
    kept = {}
    for w in words:
        kept[w] = kept.get(w, 0) + 1
    many, k = len(words), len(kept)
    x[0] = 1
    x[1] = np.log(size)
    x[2] = np.log(many)
    x[3] = min(size / many, 40) / 10
    x[4:9] = count[[0, 2, 3, 5, 7]] / size  # odd marks, digits, capitals, usual marks, letters beyond ASCII
    x[9] = np.log(count[0] / size + 1e-4)
    x[10] = np.log(count[3] / size + 1e-4)
    x[11] = np.log(k / many)
    x[12] = np.log(k / many) * np.log(many)
    x[13] = max(kept.values()) / many
    x[14] = sum(a == b for a, b in pairwise(words)) / many
    x[15] = 1 - len(set(lines)) / len(lines)
    x[16] = np.log(size / len(lines))
    x[17] = sum(len(w) <= 3 for w in words) / many
    x[18] = sum(c == 1 for c in kept.values()) / many
    x[19] = np.log(k)
    return x


def _matrix(batch, place: int) -> np.ndarray:
    texts = batch.column(place).to_pylist()
    return np.array([features(t) for t in texts]).reshape(len(texts), N_FEATURES)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learnable(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, y) of labelled documents that aren't held out and whose labels agree."""
    agreed = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out("doc_id")).groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("y2")).where("y = y2")
    return agreed.select("doc_id", F.col("y").cast("int")).join(docs.select("doc_id"), "doc_id", "left_semi")


def sample_rows(docs: DataFrame, told: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most `sample` documents of `told` (doc_id, y)."""
    chosen = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most `sample` rows

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = _matrix(b, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("y").cast("int"))
    rows = found.mapInArrow(run, "doc_id long, y int, x array<double>").groupBy("doc_id", "y").agg(F.min("x").alias("x")).select("x", "y").orderBy("doc_id").toArrow()
    x = np.array(rows.column("x").to_pylist()).reshape(rows.num_rows, N_FEATURES)
    return x, np.array(rows.column("y").to_pylist(), int)


def _newton(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Logistic regression without an intercept of its own."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (p - y) / len(y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        d = np.linalg.solve(h, g)
        d *= min(1, 3 / max(1e-9, np.abs(d).max()))
        w -= d
        if np.abs(d).max() < 1e-8:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 7, cut: Callable | None = None) -> dict:
    """The model: center, scale, weights, cut and slope. `cut` gives the cut for center, scale and weights; by itself it is
    that of x and y."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    model = {"center": np.zeros(N_FEATURES), "scale": np.ones(N_FEATURES), "w": np.zeros(N_FEATURES), "cut": -1e9, "slope": 1.0}
    if not len(good) or not len(bad):
        return model
    center, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - center) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    a, b = rng.choice(good, pairs), rng.choice(bad, pairs)
    flip = rng.random(pairs) < 0.5
    diff = np.where(flip[:, None], z[b] - z[a], z[a] - z[b])
    w = _newton(diff, (~flip).astype(float), ridge)
    s = z @ w
    cut = float(np.quantile(s, len(bad) / len(y))) if cut is None else cut(center, scale, w)
    slope = _newton(np.c_[s - cut, np.ones(len(s))], y.astype(float), 1e-4)[0]
    return {"center": center, "scale": scale, "w": w, "cut": cut, "slope": float(np.clip(slope, 0.05, 50))}


def raw_scores(center: np.ndarray, scale: np.ndarray, w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Scores of rows; a row's sum doesn't depend on the rows beside it."""
    return (np.clip((x - center) / scale, -8, 8) * w).sum(1)


def apply_model(model: dict, x: np.ndarray) -> np.ndarray:
    s = raw_scores(model["center"], model["scale"], model["w"], x)
    return 1 / (1 + np.exp(-np.clip(model["slope"] * (s - model["cut"]) + np.log(CUT / (1 - CUT)), -40, 40)))


def _cut_of_all(docs: DataFrame, told: DataFrame) -> Callable:
    """The cut over all documents of `told`, by a sketch that combines before its shuffle. Texts stay where they are: all
    documents are scored, and ids and scores meet the labels. The cut lies between two scores, on none."""

    def cut(center, scale, w) -> float:
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for low in range(0, batch.num_rows, 1024):
                    b = batch.slice(low, 1024)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw_scores(center, scale, w, _matrix(b, 1)))], names=["doc_id", "s"])

        scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, s double").join(told, "doc_id")
        share, scores = scored.agg(F.avg(1 - F.col("y")), F.percentile_approx("s", [k / 1000 for k in range(1001)], ACCURACY)).first()
        at = scores[round(share * 1000)]
        return float(at + max((x for x in scores if x < at), default=at - 1)) / 2

    return cut


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    told = cut_lineage(learnable(docs, labels))
    return fit(*sample_rows(docs, told, sample), cut=_cut_of_all(docs, told))


def score(docs: DataFrame, model: dict, text: str = "text", into: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 of every whole text; a column named `into` is replaced."""
    kept = [c for c in docs.columns if c != into]
    place = kept.index(text)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                b = batch.slice(low, 1024)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(apply_model(model, _matrix(b, place)))], names=[*kept, into])

    out = docs.select(*[docs[f"`{c}`"] for c in kept])
    return out.mapInArrow(run, T.StructType([*out.schema.fields, T.StructField(into, T.DoubleType())]))


def keep_good(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """The documents that reach the cut, with their own columns only."""
    mark = "quality_score"
    while mark in docs.columns:
        mark += "_"
    return score(docs, model, text, mark).where(F.col(mark) >= CUT).select(*[f"`{c}`" for c in docs.columns])
