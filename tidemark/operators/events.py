"""From items to gated events: one-pass clustering, percentile ranks, the gate."""

from __future__ import annotations

import functools
import hashlib
import math
import re
import sys
from collections import defaultdict
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..shared import cut
from .ranks import running

COLD_START = 20  # rows of history below which ranks say little
LOOK_BACK = 90  # days of history
TOP_SHARE, EVENTS_A_DAY = 0.95, 3
SCAN, FEW = 4, 256  # clusters for each token of a text, or in all, up to which all are compared instead of looked up
BLOCK = 8  # bits of an id within a block of neighbours
# With Java's white space, without the separators \x1c to \x1f that Python counts as such.
_JAVA_NOISE = tx.NOISE.replace(r"[\s", "[").replace("]+", "]|[^\\S\x1c-\x1f]+")


class Clusters:
    """The clusters of one day so far, with an inverted index of their tokens (of one kind: bigrams or entities).

    A set's similarity to a cluster is at most the smaller size over the larger; and a cluster that reaches the threshold t with a
    set of n tokens has ceil(t n) of them at least, so it has one of any n - ceil(t n) + 1. The rarest so many are looked up, and
    only clusters in their lists whose sizes allow the threshold are compared, as masks of bits. The lists are written when they
    are first asked for: a day of long texts or few clusters needs none."""

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold
        self.bits: dict = defaultdict(count().__next__)  # a new token gets the next number
        self.lists: list[list[int]] = []
        self.unlisted: list[tuple[int, list[int]]] = []
        self.masks: list[int] = []
        self.sizes: list[int] = []

    def tokens(self, words) -> list[int]:
        """Numbers of distinct words, or of what else stands for a token."""
        return list(map(self.bits.__getitem__, words))

    def near(self, tokens: list[int]) -> set[int]:
        """Numbers of the clusters that may reach the threshold."""
        n = len(tokens)
        low, high = self.threshold * n - 1e-9, n / self.threshold + 1e-9
        if len(self.sizes) <= max(SCAN * n, FEW):  # long texts: all clusters are fewer than the entries of the lists
            return {c for c, size in enumerate(self.sizes) if low <= size <= high}
        self.lists += [[] for _ in range(len(self.bits) - len(self.lists))]
        for c, fresh in self.unlisted:
            for b in fresh:
                self.lists[b].append(c)
        self.unlisted.clear()
        enough = math.ceil(self.threshold * n - 1e-9)
        rare = sorted(tokens, key=lambda b: len(self.lists[b]))[: n - enough + 1]
        return {c for b in rare for c in self.lists[b] if low <= self.sizes[c] <= high}

    def mask(self, tokens: list[int]) -> int:
        """Built in place: a sum of single bits would copy the whole number for each token."""
        bits = np.zeros(len(self.bits), bool)
        bits[tokens] = True
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    def similarity(self, mask: int, n: int, c: int) -> float:
        both = (mask & self.masks[c]).bit_count()
        return both / (n + self.sizes[c] - both) if both else 0.0

    def start(self) -> None:
        self.masks.append(0)
        self.sizes.append(0)

    def add(self, c: int, tokens: list[int], mask: int) -> None:
        fresh = mask & ~self.masks[c]
        if fresh != mask:
            bits = np.unpackbits(np.frombuffer(fresh.to_bytes((len(self.bits) >> 3) + 1, "little"), np.uint8), bitorder="little")
            at = np.array(tokens)
            tokens = at[bits[at] == 1].tolist()
        if tokens:
            self.unlisted.append((c, tokens))
            self.sizes[c] += len(tokens)
            self.masks[c] |= fresh


@functools.cache
def _kept() -> np.ndarray:
    """For each code point whether it is no noise."""
    kept = np.ones(sys.maxunicode + 1, bool)
    kept[[ord(c) for found in re.findall(tx.NOISE, "".join(map(chr, range(len(kept))))) for c in found]] = False
    return kept


def _bigrams(title: str) -> list[int]:
    """Distinct character pairs of the stripped title, each as a number; one character is itself. Sorting a text's pairs takes a
    fraction of the time that a set of strings does."""
    codes = np.frombuffer(title.encode("utf-32-le", "surrogatepass"), "<u4")
    codes = codes[_kept()[codes]].astype(np.uint64) + np.uint64(1)
    if len(codes) < 2:
        return codes.tolist()
    pairs = codes[:-1] << np.uint64(21) | codes[1:]
    pairs.sort()
    return pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))].tolist()


def _labels(titles, names, threshold: float) -> list[int]:
    """Cluster numbers of the titles of a group in order; `names` has the entities of each."""
    kinds, label = (Clusters(threshold), Clusters(threshold)), []
    for title, own in zip(titles, names, strict=True):
        told = [k.tokens(words) for k, words in zip(kinds, (_bigrams(title or ""), own), strict=True)]
        masks = [k.mask(tokens) for k, tokens in zip(kinds, told, strict=True)]
        best, score = -1, 0.0
        for c in sorted(kinds[0].near(told[0]) | kinds[1].near(told[1])):
            s = max(k.similarity(mask, len(tokens), c) for k, mask, tokens in zip(kinds, masks, told, strict=True))
            if s > score:
                best, score = c, s
        if best < 0 or score < threshold:
            best = len(kinds[0].masks)
            for k in kinds:
                k.start()
        for k, tokens, mask in zip(kinds, told, masks, strict=True):
            k.add(best, tokens, mask)
        label.append(best)
    return label


def cluster(items: DataFrame, group: list[str], order: list[str], threshold: float = 0.5, entity: str = tx.ENTITY) -> DataFrame:
    """One-pass greedy clustering within each group (a day's items of all sources).

    In order, an item joins the cluster with the greatest similarity (bigrams of titles or entities, the better
    of the two; the earliest cluster on ties) if that reaches the threshold, else it starts one. The result depends
    on the order of a group's items, so a group is one task: a day's items are the bound. An item meets only the clusters
    that an inverted index says can reach the threshold.
    Returns items with cluster_no (from 0 within the group).
    """
    name = re.compile(entity)

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        label = _labels(pdf["title"], [set(name.findall(t or "")) for t in pdf["title"]], threshold)
        return pdf.assign(cluster_no=pd.Series(label, dtype="int32"))

    return items.groupBy(*group).applyInPandas(run, T.StructType([*items.schema.fields, T.StructField("cluster_no", T.IntegerType())]))


def group_events(items: DataFrame, group: list[str], order: list[str], threshold: float = 0.5, entity: str = tx.ENTITY, entities: bool = True) -> DataFrame:
    """The rows of to_events(cluster(items)) and each event's novelty hash; without entities if they aren't asked for.

    Events are told where their group is clustered: only the title of an event comes back from there, no text is dealt out again by
    cluster, and what the clusters know of a text (its entities) isn't looked for anew."""
    name, noise, own = re.compile(entity), re.compile(_JAVA_NOISE), items.schema
    ids, texts = T.ArrayType(own["id"].dataType), T.ArrayType(T.StringType())
    told = [("cluster_no", T.IntegerType()), ("title", T.StringType()), ("media_count", T.LongType()), ("first_observed_at", own["ts"].dataType), ("n_items", T.LongType())]
    told += [("has_disclosure", T.BooleanType()), ("codes", T.ArrayType(own["code"].dataType)), ("news_ids", ids), ("disclosure_ids", ids), *([("entities", texts)] if entities else [])]
    schema = T.StructType([*(own[c] for c in group), *(T.StructField(c, t) for c, t in told), T.StructField("novelty", T.StringType())])

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        names = [set(name.findall(t or "")) for t in pdf["title"]]
        title, ts, number, kind = (pdf[c].tolist() for c in ("title", "ts", "id", "kind"))
        source, code = (pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in ("source", "code"))
        members: dict[int, list[int]] = {}
        for at, label in enumerate(_labels(title, names, threshold)):
            members.setdefault(label, []).append(at)
        out = []
        for label, own in members.items():
            best = min(own, key=lambda i: (-len(title[i] or ""), ts[i], number[i]))
            news, disclosures = (sorted(number[i] for i in own if kind[i] == k) for k in ("news", "disclosure"))
            told = [label, title[best], len({source[i] for i in own} - {None}), min(ts[i] for i in own), len(own), any(kind[i] == "disclosure" for i in own)]
            told += [sorted({code[i] for i in own} - {None}), news, disclosures, *([sorted(set().union(*(names[i] for i in own)))] if entities else [])]
            novelty = f"{'|'.join(sorted(names[best])[:3])}::{noise.sub('', title[best] or '')}"
            out.append((*(pdf[c].iloc[0] for c in group), *told, hashlib.sha256(novelty.encode()).hexdigest()))
        return pd.DataFrame(out, columns=schema.names)

    return items.groupBy(*group).applyInPandas(run, schema)


def to_previous(items: DataFrame, entity: str = tx.ENTITY) -> DataFrame:
    """(id, before, similarity): similarity of each item to that whose id is one less, the better of bigrams of titles and of
    entities. Items are grouped into blocks of neighbouring ids, and only the last of a block goes to the next one too, so
    that a text is taken apart once and what it gives isn't stored; a block is 257 items at most."""
    noise, name = re.compile(_JAVA_NOISE), re.compile(entity)
    ends = F.shiftright("id", BLOCK)
    told = items.select("id", "title", F.explode(F.array_distinct(F.array(ends, F.shiftright(F.col("id") + 1, BLOCK)))).alias("block"))

    def jaccard(a: set, b: set) -> float:
        both = len(a & b)
        return both / (len(a) + len(b) - both) if both else 0.0

    def run(pdf):
        import pandas as pd

        block, last, before, out = pdf["block"].iloc[0], None, [], []
        for at, titles in pdf.sort_values("id").groupby("id", sort=True)["title"]:
            own = []
            for title in titles:
                t = noise.sub("", title or "")
                own.append(({t[i : i + 2] for i in range(len(t) - 1)} if len(t) > 1 else ({t} if t else set()), set(name.findall(title or ""))))
            if last == at - 1 and at >> BLOCK == block:
                out += [(at, last, max(jaccard(g, pg), jaccard(n, pn))) for g, n in own for pg, pn in before]
            last, before = at, own
        return pd.DataFrame(out, columns=["id", "before", "similarity"])

    return told.groupBy("block").applyInPandas(run, "id long, before long, similarity double")


def to_events(clustered: DataFrame, group: list[str], entity: str = tx.ENTITY) -> DataFrame:
    """One event for each cluster: the longest title (the first of equals), distinct sources, first time, sorted codes,
    ids by kind, entities of all titles. A cluster's lists are bounded by its day's items."""
    keys = [*group, "cluster_no"]
    ids = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("id"))))
    return clustered.withColumn("__e", tx.entities(F.col("title"), entity)).groupBy(*keys).agg(
        F.min_by("title", F.struct(-F.length("title"), "ts", "id")).alias("title"),
        F.size(F.collect_set("source")).cast("long").alias("media_count"),  # a distinct count would sort whole texts for a second stage
        F.min("ts").alias("first_observed_at"),
        F.count("*").alias("n_items"),
        F.bool_or(F.col("kind") == "disclosure").alias("has_disclosure"),
        F.array_sort(F.collect_set("code")).alias("codes"),
        ids("news").alias("news_ids"),
        ids("disclosure").alias("disclosure_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("__e")))).alias("entities"),
    )


def percentile_rank(values: DataFrame, history: DataFrame, value: str, by: list[str], into: str, weight: Column | None = None) -> DataFrame:
    """Share of history strictly below each value; 0 without history. Both sides are reduced to distinct values, which are put in
    order in ranges, so that no task has all values of a key, and the rank joins the rows by value; no pair of value and
    history row is formed. `weight` is how many rows a row of history stands for."""
    ranks = _below(values.select(*by, value), history, value, by, F.lit(1) if weight is None else weight)
    rank = F.when(F.col("__all") > 0, F.col("__below") / F.col("__all")).otherwise(0.0)
    told = ranks.select(*[F.col(c).alias(f"__{c}") for c in (*by, value)], rank.alias(into))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*by, value)]
    return values.join(told, same, "left").drop(*[f"__{c}" for c in (*by, value)])


def _below(asked: DataFrame, history: DataFrame, value: str, by: list[str], weight: Column) -> DataFrame:
    """(by, value, __below, __all): for each distinct asked value the weight of its key's history below it, and of all of it."""
    h = history.groupBy(*by, value).agg(F.sum(weight).cast("long").alias("__c")).withColumn("__k", F.lit(1))
    v = asked.distinct().withColumn("__c", F.lit(0).cast("long")).withColumn("__k", F.lit(0))
    placed = running(v.unionByName(h), [F.col(value).asc_nulls_first(), F.asc("__k")], "__c", "__below", by).where("__k = 0")
    if not by:
        return placed.join(F.broadcast(h.agg(F.sum("__c").alias("__all")))).drop("__c", "__k")
    totals = h.groupBy(*by).agg(F.sum("__c").alias("__all"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"p.{c}").eqNullSafe(F.col(f"t.{c}"))
    return placed.alias("p").join(totals.alias("t"), same, "left").select(*[F.col(f"p.{c}") for c in (*by, value, "__below")], F.coalesce("t.__all", F.lit(0)).alias("__all"))


def _blocks(low: int, high: int) -> list[tuple[int, int]]:
    """(level, number) of the blocks of 2^level days that together are the days low to high, both included."""
    out = []
    while low <= high:
        level = 0
        while low % (2 << level) == 0 and low + (2 << level) - 1 <= high:
            level += 1
        out.append((level, low >> level))
        low += 1 << level
    return out


def sliding_ranks(rows: DataFrame, day: str, names: list[str], days: int = LOOK_BACK) -> DataFrame:
    """(name, day, value, rank, n, any): for each distinct (day, value) of each named column the share of that column's values of the
    `days` days before which is strictly below it, their number, and whether any is positive.

    A value of the history isn't copied to each day that looks back to it: it stands in one block of 2^level days for each
    level, and a day's look-back is a handful of such blocks, whose counts add up. Days are those that occur; their blocks are
    made on the driver (a row for each day of the calendar that occurs, times some ten)."""
    spark = rows.sparkSession
    long = rows.select(F.unix_date(day).alias("t"), F.stack(F.lit(len(names)), *[x for n in names for x in (F.lit(n), F.col(n))]).alias("name", "value"))
    own = cut(long.groupBy("name", "t", "value").agg(F.count("*").alias("n")))
    levels = range((days + 1).bit_length())
    block = lambda level: F.struct(F.lit(level).alias("level"), F.shiftright("t", level).alias("number"))
    history = own.withColumn("b", F.explode(F.array(*[block(level) for level in levels]))).select("name", F.col("b.level").alias("level"), F.col("b.number").alias("number"), "value", "n")
    occurring = [r["t"] for r in own.select("t").distinct().collect()]
    parts = [(t, level, number) for t in occurring for level, number in _blocks(t - days, t - 1)]
    asked_blocks = F.broadcast(spark.createDataFrame(parts, "t int, level int, number int"))
    asked = own.select("name", "t", "value").join(asked_blocks, "t")
    told = _below(asked.select("name", "level", "number", "value"), history, "value", ["name", "level", "number"], F.col("n"))
    told = asked.join(told, ["name", "level", "number", "value"]).groupBy("name", "t", "value").agg(F.sum("__below").alias("__below"), F.sum("__all").alias("n"))
    positive = own.where("value > 0").select("name", F.col("t").alias("__t")).distinct()  # a row for each name and day
    looks = F.broadcast(spark.createDataFrame([(t,) for t in occurring], "t int"))
    some = positive.join(looks, (F.col("__t") < F.col("t")) & (F.col("__t") >= F.col("t") - days)).select("name", "t").distinct().withColumn("any", F.lit(True))
    rank = F.when(F.col("n") > 0, F.col("__below") / F.col("n")).otherwise(0.0)
    told = told.join(F.broadcast(some), ["name", "t"], "left")
    return told.select("name", F.date_from_unix_date("t").alias(day), "value", rank.alias("rank"), "n", F.coalesce("any", F.lit(False)).alias("any"))


def seen_before(events: DataFrame, day: str, novelty: str) -> DataFrame:
    """events with `seen`: whether their novelty hash came up on an earlier day."""
    first = events.groupBy(novelty).agg(F.min(day).alias("__first"))
    return events.join(first, novelty).withColumn("seen", F.col("__first") < F.col(day)).drop("__first")


def forced(title: Column, codes: Column, active_codes: Column, keywords: Column) -> Column:
    """Whether an event touches an active scenario: a common code, or one of its keywords in the title."""
    return F.coalesce(F.arrays_overlap(codes, active_codes), F.lit(False)) | F.exists(keywords, lambda k: F.contains(title, k))


def composite(parts: list[tuple[Column, Column, Column]]) -> Column:
    """Mean percentile of the indicators that are measured: (value, percentile, history has positive values)."""
    used = [F.when((v > 0) | h, p) for v, p, h in parts]
    total = sum((F.coalesce(u, F.lit(0.0)) for u in used), F.lit(0.0))
    n = sum((u.isNotNull().cast("int") for u in used), F.lit(0))
    return F.when(n > 0, total / n).otherwise(0.0)


def strong_kind(title: Column, disclosure_type: Column, kinds: list[str] | None = None) -> Column:
    """Whether an event's title or type is that of a strong disclosure (tx.STRONG, or `kinds`)."""
    return tx.is_strong(title, kinds) | tx.is_strong(disclosure_type, kinds)


def gate(events: DataFrame, cold_start: Column, growth_measured: Column) -> DataFrame:
    """Verdicts for events with score, media_count, growth, growth_percentile, strong, seen, forced, day and pos (a number of
    its own): passed, forced_in, reason. At most EVENTS_A_DAY that aren't forced pass a day: the best of each task are told
    first, then of all, and only these few meet the events again."""
    attention = (F.col("score") >= TOP_SHARE) | (cold_start & (F.col("media_count") > 0))
    growth = (F.col("growth") > 0) & growth_measured & (F.col("growth_percentile") >= TOP_SHARE)
    strong = F.col("strong")
    reasons = F.array_join(F.array_compact(F.array(F.when(attention, "注目度が上位5%"), F.when(growth, "注目度の伸びが上位5%"), F.when(strong, "強い種類の開示"))), " / ")
    meets = attention | growth | strong
    out = cut(events.withColumns({"__why": reasons, "__in": ~F.col("seen") & (meets | F.col("forced"))}))
    own = Window.partitionBy("day").orderBy(F.desc("score"), F.desc("media_count"), "pos")
    rank = F.row_number().over(own)
    best = out.where(F.col("__in") & ~F.col("forced")).select("day", "pos", "score", "media_count").withColumn("__r", rank).where(F.col("__r") <= EVENTS_A_DAY)
    best = best.select("day", "pos", F.lit(True).alias("__best"))
    out = out.join(best, ["day", "pos"], "left").withColumn("__over", F.col("__in") & ~F.col("forced") & F.col("__best").isNull())
    reason = (
        F.when(F.col("seen"), "新規性なし(既知の事実)")
        .when(~F.col("__in"), "注目度・開示の種類のいずれの条件も満たさない")
        .when(F.col("forced") & (F.col("__why") == ""), "進行中シナリオに関係")
        .when(F.col("forced"), F.concat("__why", F.lit("(進行中シナリオの別枠)")))
        .when(F.col("__over"), F.concat("__why", F.lit(f"(上限 {EVENTS_A_DAY} 件を超過)")))
        .otherwise(F.col("__why"))
    )
    passed = F.col("__in") & ~F.col("__over")
    return out.withColumns({"passed": passed, "forced_in": F.col("__in") & F.col("forced"), "reason": reason}).drop("__why", "__in", "__over", "__best")
