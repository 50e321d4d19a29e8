"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

An item of m characters that occurs in a document with at most k edits shares at least m - q + 1 - kq of its
q-grams with the place, on diagonals (place in the document less place in the item) that lie within k + 1 of
each other. So, over whole texts:

1. q-gram hashes of the document are looked up in the index of the items' q-grams; stretches with fewer hits
   than any item of a size class needs are passed over;
2. hits of the rest are counted by item and by diagonal bands of width 2(k + 1) that overlap by half, and bands
   that meet the item's bound are kept;
3. each kept band is verified by an alignment confined to its diagonals, which gives the exact distance.

k is EDITS of the item's length. Where the lemma leaves no shared q-gram for that (items of 20 to 23 characters), the item is
indexed by shorter ones, of SHORT_Q characters. Both sides are lower-cased, and runs of white space and punctuation become one
blank; positions refer to that form. Items go to the tasks in slices of at most SLICE characters (a proven bound on what is
broadcast); a larger benchmark takes several slices, each handled in the same pass over the documents
or, beyond SLICES_A_PASS of them, in further passes. Documents aren't shuffled.

Items of fewer than Q characters have no q-gram and are too short for an edit: they are searched for exactly, as runs of whole
words. Items that are equal in normal form are one item, that with the smallest id; they are grouped before they are sliced.

Defined cases: null and empty documents match nothing; null items and those without a letter or digit are
not searched for; null doc_ids are kept; repeated documents are repeated in the result; extra columns pass through `drop_contaminated`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 12
SHORT_Q = 8
EDITS = 0.05
SLICE = 1_000_000
SLICES_A_PASS = 4
CHUNK = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


_MARKS = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return _MARKS.sub(" ", text.lower()).strip() if text else ""


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def grams(c: np.ndarray, q: int = Q) -> np.ndarray:
    """Hashes of all q-grams; q is Q or SHORT_Q."""
    if len(c) < q:
        return np.zeros(0, np.uint64)
    two = (c[:-1].astype(np.uint64) + np.uint64(7)) * _P + c[1:]
    four = two[:-2] * _P + (two[2:] ^ (two[2:] >> np.uint64(29)))
    eight = four[:-4] * _P + (four[4:] ^ (four[4:] >> np.uint64(31)))
    h = eight[: len(c) - q + 1] * _P + (four[8 : 8 + len(c) - q + 1] if q == Q else np.uint64(1))
    return (h ^ (h >> np.uint64(32))) * _P


def edits_of(length: int) -> int:
    return int(length * EDITS)


def indexes_of(items: list[tuple[int | None, str]]) -> list[Index]:
    """A slice's items in the index for the q-gram length that the lemma allows them."""
    fits = lambda t: len(t) < Q or len(t) - Q + 1 - edits_of(len(t)) * Q >= 1
    few = [x for x in items if not fits(x[1])]
    return [Index([x for x in items if fits(x[1])], Q), *([Index(few, SHORT_Q)] if few else [])]


class Index:
    """Postings of items by their q-grams; apart from them those shorter than Q, by their words."""

    def __init__(self, items: list[tuple[int | None, str]], q: int = Q) -> None:
        self.q = q
        self.short = {tuple(t.split(" ")): i for i, t in items if len(t) < Q}
        self.heads: dict[str, set[int]] = {}
        for words in self.short:
            self.heads.setdefault(words[0], set()).add(len(words))
        items = [x for x in items if len(x[1]) >= Q]
        self.ids = [i for i, _ in items]
        self.strings = [t for _, t in items]
        self.texts = [codes(t) for t in self.strings]
        m = np.array([len(t) for t in self.texts], int)
        self.k = np.array([edits_of(x) for x in m.tolist()], int)
        self.need = np.maximum(1, m - q + 1 - self.k * q)
        self.m = m
        g = [grams(t, q) for t in self.texts]
        h = np.concatenate([np.zeros(0, np.uint64), *g])
        of = np.repeat(np.arange(len(g)), np.array([len(x) for x in g], int))
        at = np.concatenate([np.zeros(0, int), *(np.arange(len(x)) for x in g)])
        order = np.argsort(h, kind="stable")
        self.h, self.of, self.at = h[order], of[order], at[order]
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.h >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        size = np.floor(np.log(np.maximum(m, 1)) / np.log(1.3)).astype(int)
        self.classes = [(int((m + self.k)[size == s].max()), int(self.need[size == s].min())) for s in np.unique(size)]
        self.longest = int((m + 2 * self.k).max(initial=0)) + Q

    def short_places(self, text: str) -> Iterator[tuple[int | None, int, int]]:
        """(item_id, start, end) of the first place of each short item."""
        words, at, seen = text.split(" "), 0, set()
        for k, w in enumerate(words):
            for n in self.heads.get(w, ()):
                run = tuple(words[k : k + n])
                if run in self.short and run not in seen:
                    seen.add(run)
                    yield self.short[run], at, at + len(" ".join(run))
            at += len(w) + 1


def _distance(item: np.ndarray, doc: np.ndarray, low: int, high: int, free: bool = True) -> tuple[int, int]:
    """Least edits of the item against a stretch of doc whose alignment stays on diagonals low..high, and
    the stretch's end; its start is free, or else doc's own."""
    d = np.arange(low, high + 1)
    far = len(item) + len(doc) + 1
    row = np.where((d >= 0) & (d <= len(doc)), 0 if free else d, far)
    # Characters outside the stretch fit nothing: to consume one costs what leaving out the item's does.
    before, after = max(0, -low), max(0, high + len(item) - len(doc))
    padded = np.concatenate([np.full(before, 0xFFFFFFFF, np.uint32), doc, np.full(after, 0xFFFFFFFF, np.uint32)])
    steps, n, at = np.arange(len(d)), len(d), low + before
    for i, c in enumerate(item.tolist()):
        cost = row + (padded[at + i : at + i + n] != c)
        np.minimum(cost[:-1], row[1:] + 1, out=cost[:-1])
        cost -= steps
        row = np.minimum.accumulate(cost)
        row += steps
    best = int(row.argmin())
    return int(row[best]), min(len(doc), max(0, len(item) + low + best))


def _places(index: Index, text: str) -> Iterator[tuple[int, int, int, int]]:
    """(item, edits, start, end) of verified places in one stretch of a document."""
    c = codes(text)
    h = grams(c, index.q)
    if not len(h):
        return
    hit = index.seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)]
    total = np.concatenate([[0], np.cumsum(hit)])
    if not total[-1]:
        return
    kept = np.zeros(len(h) + 1, np.int32)
    n = len(h)
    for width, need in index.classes:
        w = min(width, n)
        full = np.flatnonzero(total[w:] - total[:-w] >= need)
        np.add.at(kept, full, 1)
        np.add.at(kept, full + w, -1)
    at = np.flatnonzero(hit & (np.cumsum(kept)[:-1] > 0))
    if not len(at):
        return
    lo, hi = np.searchsorted(index.h, h[at], "left"), np.searchsorted(index.h, h[at], "right")
    count = hi - lo
    post = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    item, diagonal = index.of[post], np.repeat(at, count) - index.at[post]
    step = index.k[item] + 1
    band = diagonal // step
    item, band = np.concatenate([item, item]), np.concatenate([band, band - 1])
    shift = int(-band.min(initial=0))
    key, many = np.unique(item * (len(c) + shift + 2) + band + shift, return_counts=True)
    item, band = key // (len(c) + shift + 2), key % (len(c) + shift + 2) - shift
    good = many >= index.need[item]
    for t, b in zip(item[good].tolist(), band[good].tolist(), strict=True):
        k = int(index.k[t])
        low, high = b * (k + 1) - k, (b + 2) * (k + 1) - 1 + k
        first, last = max(0, low), max(0, min(len(c), high + int(index.m[t])))
        if (whole := text.find(index.strings[t], first, last)) >= 0:
            yield t, 0, whole, whole + int(index.m[t])
            continue
        part = c[first:last]
        edits, end = _distance(index.texts[t], part, low - first, high - first)
        if edits <= k:
            stretch = part[max(0, end - int(index.m[t]) - k) : end][::-1]
            _, back = _distance(index.texts[t][::-1], stretch, -k, k, False)
            yield t, edits, first + end - back, first + end


def places(indexes: list[Index], text: str | None) -> list[tuple[int | None, int, int, int]]:
    """(item_id, edits, start, end): the best place of each item in a document, the first of equals."""
    c, best = normal(text), {}
    for s, index in enumerate(indexes):
        step = max(CHUNK, 4 * index.longest)
        for low in range(0, max(1, len(c)), step):
            for t, edits, start, end in _places(index, c[low : low + step + index.longest]):
                found = (edits, start + low, end + low)
                if (s, t) not in best or found < best[s, t]:
                    best[s, t] = found
    short = [(i, 0, start, end) for index in indexes if index.short and c for i, start, end in index.short_places(c)]
    return [(indexes[s].ids[t], *best[s, t]) for s, t in sorted(best)] + short


def slices(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """Normalised items in slices of bounded size; items come to the driver one partition at a time."""

    def normalised(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([normal(t) for t in b.column(1).to_pylist()], pa.string())], names=["item_id", "form"])

    forms = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(normalised, "item_id long, form string")
    one = forms.where("form <> ''").groupBy("form").agg(F.min("item_id").alias("item_id"))
    held, size = [], 0
    for r in one.orderBy("item_id", "form").toLocalIterator():
        if held and size + len(r["form"]) > SLICE:
            yield held
            held, size = [], 0
        held.append((r["item_id"], r["form"]))
        size += len(r["form"])
    if held:
        yield held


def _passes(benchmark: DataFrame) -> Iterator[list]:
    """Lists of (digest of a slice's content, the slice as a broadcast)."""
    sc, held = benchmark.sparkSession.sparkContext, []
    for s in slices(benchmark):
        held.append((hashlib.sha256(repr(s).encode()).hexdigest(), sc.broadcast(s)))
        if len(held) == SLICES_A_PASS:
            yield held
            held = []
    if held:
        yield held


_indexes: dict = {}


def _of(sent: list) -> list[Index]:
    """Indexes of broadcast slices, kept by the worker for its later tasks under the slices' digests."""
    key = tuple(digest for digest, _ in sent)
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = [index for _, b in sent for index in indexes_of(b.value)]
    return _indexes[key]


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every place: doc_id, item_id, n_edits, start_at, end_at."""
    schema = "doc_id long, item_id long, n_edits int, start_at long, end_at long"
    out = None
    for sent in _passes(benchmark):

        def run(batches, sent=sent):
            import pyarrow as pa

            indexes = _of(sent)
            for b in batches:
                rows = [(i, *p) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for p in places(indexes, t)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "n_edits", "start_at", "end_at"])

        found = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item occurs, with all their columns."""
    place = docs.columns.index("text")
    out = docs
    for sent in _passes(benchmark):

        def run(batches, sent=sent):
            import pyarrow as pa

            indexes = _of(sent)
            for b in batches:
                yield b.filter(pa.array([not places(indexes, t) for t in b.column(place).to_pylist()], pa.bool_()))

        out = out.mapInArrow(run, out.schema)
    return out
