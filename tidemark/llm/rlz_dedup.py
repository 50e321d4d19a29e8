"""Removal of repeated passages by relative Lempel-Ziv parsing.

A window is LEAST consecutive words. A word goes if a window that covers it also starts anywhere else. The corpus is its
own reference. It is dealt into reference blocks by content, so that a document meets only the blocks that can hold
something of it: the anchor of a window is its least GRAM-word gram by hash, equal windows have equal anchors, and
consecutive windows of one anchor make a run, whose words are sent once. Runs whose anchor stands in no other place can't
repeat and are never sent. A block holds all runs of its anchors; it is indexed by a suffix order of its words, and every
run is factored greedily against it: a factor is the longest match with another place of the block. Factors of LEAST words
and more are repeated. A repeated window that lies in no single factor holds exactly one factor boundary, as the factor
that starts inside it reaches at least its end; so windows over a boundary are looked up where the two factors together
have LEAST words. The result is exact.

Anchors with more than HOT places would make one block grow with the input. Their windows are dealt by a fingerprint of
the whole window instead and counted with partial aggregation, so that no group is gathered. Equal texts count once
and go whole (if they have LEAST words). Texts are written once, bucketed by their digest, so that neither the words of
runs nor the final cut shuffles them again.

Defined cases: null and empty texts have no words; texts of less than LEAST words lose nothing; repeated rows and equal
texts are copies of each other, whatever their ids, null ids included; a text of any length is handled whole; an empty
table gives no rows; other columns aren't read. Words are compared as bytes inside blocks; the fingerprints of hot windows
and the digests of texts have 128 bits.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, new_dir

LEAST = 35
GRAM = 8
HOT = 1 << 14
BLOCK_WORDS = 400_000
PARTS = 20_000  # words of a text that are looked at in one step, so that a long text needs little memory

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(g: np.ndarray) -> np.ndarray:
    g = g ^ (g >> np.uint64(31))
    g = g * np.uint64(0xD6E8FEB86659FD93)
    return g ^ (g >> np.uint64(32))


def _grams(h: np.ndarray, k: int, by: np.uint64 = _P) -> np.ndarray:
    """A hash of each k consecutive elements."""
    n = len(h) - k + 1
    g = np.zeros(max(n, 0), np.uint64)
    for j in range(k if n > 0 else 0):
        g = g * by + h[j : j + n]
    return _mix(g)


def _hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def anchored_runs(h: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor) of each run of the words with hashes h."""
    n = len(h) - least + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = _grams(h, gram)
    at, width, span = np.arange(len(g)), 1, least - gram + 1
    while width < span:  # at[i]: the first place of the least gram among the width grams from i on
        step = min(width, span - width)
        left, right = at[:-step], at[step:]
        at = np.where(g[left] <= g[right], left, right)
        width += step
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return first, np.diff(np.append(first, n)), g[at[first]].view(np.int64)


def _ranks(ids: np.ndarray, depth: int) -> list[np.ndarray]:
    """ranks[k][i]: the place of the 2^k elements from i on among all such sequences, equal ones having equal places."""
    ranks, size = [ids], 1
    while size < depth:
        r = ranks[-1]
        ahead = np.zeros_like(r)
        ahead[:-size] = r[size:] + 1
        ranks.append(np.unique(r * (r.max() + 2) + ahead, return_inverse=True)[1].astype(np.int64))
        size *= 2
    return ranks


class Block:
    """A reference block: the words of its runs one after the other, each run closed by a mark of its own, in suffix order."""

    def __init__(self, runs: list[list[bytes]]) -> None:
        import pandas as pd

        size = np.array([len(r) for r in runs], np.int64)
        self.start = np.cumsum(size + 1) - size - 1
        self.end = self.start + size
        ids = np.zeros(int(size.sum()) + len(runs), np.int64)
        inside = np.ones(len(ids), bool)
        inside[self.end] = False
        ids[inside] = pd.factorize(np.array([w for r in runs for w in r], object))[0] + len(runs)
        ids[self.end] = np.arange(len(runs))
        self.ranks = _ranks(ids, int(size.max(initial=1)) + 1)
        self.order = np.argsort(self.ranks[-1], kind="stable")
        self.place = np.empty_like(self.order)
        self.place[self.order] = np.arange(len(ids))

    def _common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The words that i and j have in common from there on."""
        n, same = len(self.order), np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            a, b = np.minimum(i + same, n - 1), np.minimum(j + same, n - 1)
            same += (self.ranks[k][a] == self.ranks[k][b]).astype(np.int64) << k
        return same

    def longest(self, i: np.ndarray) -> np.ndarray:
        """The longest match of what starts at i with any other place of the block."""
        at, last = self.place[i], len(self.order) - 1
        before = np.where(at > 0, self._common(i, self.order[np.maximum(at - 1, 0)]), 0)
        after = np.where(at < last, self._common(i, self.order[np.minimum(at + 1, last)]), 0)
        return np.maximum(before, after)

    def repeated(self, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(run, from, to) of the repeated words, places counted in the run; spans may overlap."""
        run, at, runs, starts, sizes = np.arange(len(self.start)), self.start.copy(), [], [], []
        while len(run):  # the next factor of every run that isn't parsed to its end
            size = np.maximum(self.longest(at), 1)
            runs.append(run)
            starts.append(at)
            sizes.append(size)
            at = at + size
            more = at < self.end[run]
            run, at = run[more], at[more]
        if not runs:
            return (np.zeros(0, np.int64),) * 3
        run, at, size = map(np.concatenate, (runs, starts, sizes))
        by = np.argsort(at, kind="stable")
        run, at, size = run[by], at[by], size[by]
        long = size >= least
        near = np.flatnonzero((run[1:] == run[:-1]) & (size[1:] + size[:-1] >= least))
        edge = at[near + 1]
        low = np.maximum(at[near], edge - least + 1)
        count = np.maximum(np.minimum(edge - 1, edge + size[near + 1] - least) - low + 1, 0)
        s = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        owner = np.repeat(run[near], count)
        found = self.longest(s) >= least
        s, owner = s[found], owner[found]
        who = np.concatenate([run[long], owner])
        begin = np.concatenate([at[long], s]) - self.start[who]
        return who, begin, begin + np.concatenate([size[long], np.full(len(s), least)])


def _runs_of(least: int, gram: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for t1, t2, text in zip(b.column("t1").to_pylist(), b.column("t2").to_pylist(), b.column("text"), strict=True):
                first, count, anchor = anchored_runs(_hashes(text.as_buffer().to_pybytes().split()), least, gram)
                for k in range(0, len(first), PARTS):
                    f, c, a = first[k : k + PARTS], count[k : k + PARTS], anchor[k : k + PARTS]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(f), t1)), pa.array(np.full(len(f), t2)), pa.array(f.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(a)],
                        names=["t1", "t2", "s", "n", "anchor"],
                    )

    return run


def _words_of(least: int):
    """Rows (dealt, t1, t2, s, words) of the runs that a text is asked for."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out, room = [], 0
            for t1, t2, text, asked in zip(b.column("t1").to_pylist(), b.column("t2").to_pylist(), b.column("text"), b.column("asked").to_pylist(), strict=True):
                words = text.as_buffer().to_pybytes().split()
                for x in asked:
                    some = b" ".join(words[x["s"] : x["s"] + x["n"] + least - 1])
                    out.append((x["dealt"], t1, t2, x["s"], some))
                    room += len(some)
                    if room > 8 << 20:
                        yield _batch(out)
                        out, room = [], 0
            if out:
                yield _batch(out)

    def _batch(rows):
        import pyarrow as pa

        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["dealt", "t1", "t2", "s", "words"])

    return run


def _windows_of(least: int):
    """Rows (t1, t2, s, f1, f2): a fingerprint of each window of the runs that a text is asked for."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for t1, t2, text, asked in zip(b.column("t1").to_pylist(), b.column("t2").to_pylist(), b.column("text"), b.column("asked").to_pylist(), strict=True):
                h = _hashes(text.as_buffer().to_pybytes().split())
                one, two = _grams(h, least), _grams(_mix(h ^ _Q), least, _Q)
                starts = np.concatenate([np.arange(x["s"], x["s"] + x["n"]) for x in asked])
                for k in range(0, len(starts), PARTS):
                    s = starts[k : k + PARTS]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(s), t1)), pa.array(np.full(len(s), t2)), pa.array(s.astype(np.int32)), pa.array(one[s].view(np.int64)), pa.array(two[s].view(np.int64))],
                        names=["t1", "t2", "s", "f1", "f2"],
                    )

    return run


def _parse(least: int):
    def parse(table):
        import pyarrow as pa

        t1, t2, s = (table.column(c).to_numpy() for c in ("t1", "t2", "s"))
        who, begin, end = Block([w.split(b" ") for w in table.column("words").to_pylist()]).repeated(least)
        return pa.table({"t1": t1[who], "t2": t2[who], "begin": (s[who] + begin).astype(np.int32), "end": (s[who] + end).astype(np.int32)})

    return parse


def _cut(least: int):
    """Rows (t1, t2, n_words, n_removed, kept): the words that are left, joined by one blank."""

    def done(rows):
        import pyarrow as pa

        kinds = {"t1": pa.int64(), "t2": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    def run(batches):
        for b in batches:
            out, room = [], 0
            columns = (b.column(c).to_pylist() for c in ("t1", "t2", "copies", "spans"))
            for t1, t2, copies, spans, text in zip(*columns, b.column("text"), strict=True):
                words = text.as_buffer().to_pybytes().split()
                kept, at = [], 0
                if copies > 1 and len(words) >= least:
                    at = len(words)
                for x in sorted(spans or (), key=lambda x: x["begin"]):
                    kept += words[at : max(at, x["begin"])]
                    at = max(at, x["end"])
                kept += words[at:]
                out.append((t1, t2, len(words), len(words) - len(kept), b" ".join(kept)))
                room += len(out[-1][4])
                if room > 8 << 20:
                    yield done(out)
                    out, room = [], 0
            if out:
                yield done(out)

    return run


def _bucketed(df: DataFrame) -> DataFrame:
    """df, grouped by t1 and t2, written once into buckets by these, as many as a shuffle has partitions, so that joins on them
    don't move it."""
    spark, name = df.sparkSession, f"texts_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "t1", "t2").option("compression", "zstd")
    writer.option("path", new_dir(spark, "texts")).saveAsTable(name)
    return spark.table(name)


def repeated_spans(texts: DataFrame, least: int = LEAST, gram: int = GRAM, hot: int = HOT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(t1, t2, begin, end): word spans of texts (t1, t2, text; each text once) that stand elsewhere too; they may overlap."""
    runs = materialise(texts.select("t1", "t2", "text").mapInArrow(_runs_of(least, gram), "t1 long, t2 long, s int, n int, anchor long"), "runs")
    places = runs.groupBy("anchor").agg(F.count("*").alias("places"), (F.sum("n") + (least - 1) * F.count("*")).alias("words")).where("places > 1")
    anchors = materialise(places, "anchors")
    size = anchors.agg(F.sum(F.when(F.col("places") <= hot, F.col("words"))).alias("cold"), F.max("places").alias("most")).first()
    n_blocks = (size["cold"] or 0) // block_words + 1
    dealt = F.when(F.col("places") <= hot, F.pmod(F.xxhash64("anchor"), F.lit(n_blocks)).cast("int")).alias("dealt")
    asked = runs.join(anchors, "anchor").select("t1", "t2", F.struct("s", "n", dealt).alias("x"))

    def met(cold: bool) -> DataFrame:
        some = asked.where(F.col("x.dealt").isNotNull() if cold else F.col("x.dealt").isNull())
        return texts.join(some.groupBy("t1", "t2").agg(F.collect_list("x").alias("asked")), ["t1", "t2"])

    words = met(True).mapInArrow(_words_of(least), "dealt int, t1 long, t2 long, s int, words binary")
    spans = words.groupBy("dealt").applyInArrow(_parse(least), "t1 long, t2 long, begin int, end int")
    if (size["most"] or 0) > hot:
        windows = materialise(met(False).mapInArrow(_windows_of(least), "t1 long, t2 long, s int, f1 long, f2 long"), "windows")
        place = F.xxhash64("t1", "t2", "s")
        twice = windows.groupBy("f1", "f2").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high")
        spans = spans.unionByName(windows.join(twice, ["f1", "f2"]).select("t1", "t2", F.col("s").alias("begin"), (F.col("s") + least).alias("end")))
    return spans


def drop_repeated(
    docs: DataFrame, kept=lambda words: words.cast("string"), least: int = LEAST, gram: int = GRAM, hot: int = HOT, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """docs with n_words, n_removed and `kept` in place of any columns of these names and of the text. kept: what goes on of the
    words that are left (binary, joined by one blank), the words themselves by default."""
    one, two = fresh(docs, "t1"), fresh(docs, "t2")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({one: F.xxhash64(text), two: F.xxhash64(F.lit(2), text)})
    whole = keyed.select(F.col(one).alias("t1"), F.col(two).alias("t2"), text.alias("text"))
    texts = _bucketed(whole.groupBy("t1", "t2").agg(F.any_value("text").alias("text"), F.count("*").alias("copies")))
    spans = materialise(repeated_spans(texts, least, gram, hot, block_words), "spans")
    merged = texts.join(spans.groupBy("t1", "t2").agg(F.collect_set(F.struct("begin", "end")).alias("spans")), ["t1", "t2"], "left")
    cut = merged.select("t1", "t2", "text", "copies", "spans").mapInArrow(_cut(least), "t1 long, t2 long, n_words long, n_removed long, kept binary")
    result = cut.select(F.col("t1").alias(one), F.col("t2").alias(two), "n_words", "n_removed", kept(F.col("kept")).alias("kept"))
    rest = keyed.drop("text", *(c for c in docs.columns if c.lower() in ("n_words", "n_removed", "kept")))
    return rest.join(result, [one, two]).drop(one, two)
