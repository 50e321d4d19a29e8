"""License scan by a positional rare-token index, in DataFrame functions only.

The index holds postings (template, position) of each licence template's rarest words and of the rarest words of its
mandatory key phrase; document frequencies are counted over all documents. Of each file's words that stand in
the index the highest-IDF ones, and those of key phrases, are looked up at all their places. A place's postings give
template starts (place in the file less place in the template). A start is kept where the key phrase stands word for word at
its own place and the words beside it agree: of the template's words within NEAR places of the key phrase, outside it, those
that stand at their relative positions have at least SHARE of the IDF weight. So a phrase that a licence has in common with
other prose, or with another licence, isn't a match by itself; a template without words beside its key phrase needs no more.

Since a key phrase's rarest words are always looked up, no template whose key phrase and surroundings stand is missed. The
score is the largest IDF-weighted share of a template's words that stand in place among its matches; 1 where a base
phrase stands (it is itself a template that is there whole), else 0.

All is one narrow pass: nothing is shuffled but the document frequencies. A text is split into words once, and time
is in proportion to its words and the postings at its rare words' places.

Defined cases: a null text is an empty one; texts without words have no places; repeated rows give repeated
results; null doc_ids are kept; extra columns of the input aren't read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import TEMPLATES

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
RARE = 8  # indexed words of a template
RARE_KEY = 4  # indexed words of its key phrase
LOOKED_UP = 16  # highest-IDF words of a file, beside those of key phrases
NEAR = 8
SHARE = 0.4
WIDE = 1 << 12  # more words than any template has


def words_of(text: str = "text") -> Column:
    """Lower-cased (A-Z) words of a text; an empty array for null."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, SEPARATORS), "")


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How many documents hold each word of a fixed vocabulary."""
    found = docs.select(F.explode(F.array_intersect(words_of(), _strings(vocabulary))).alias("w")).groupBy("w").count()
    return {r["w"]: r["count"] for r in found.collect()}  # at most a row for each word of the vocabulary


class Index:
    """Templates, the positions of their indexed words, and all words' weights."""

    def __init__(self, templates: list[tuple[str, str, str]], frequencies: dict[str, int], n_docs: int) -> None:
        if any(len(text.split()) >= WIDE for _, text, _ in templates):
            raise ValueError(f"a template has {WIDE} words or more")
        self.labels = [label for label, _, _ in templates]
        self.words = [text.split() for _, text, _ in templates]
        self.keys = [key.split() for _, _, key in templates]
        self.key_at = [_find(w, k) for w, k in zip(self.words, self.keys, strict=True)]
        self.idf = {w: math.log((n_docs + 1) / (frequencies.get(w, 0) + 1)) + 0.01 for words in self.words for w in words}
        self.at = []
        for words, key, at in zip(self.words, self.keys, self.key_at, strict=True):
            rarest = lambda places, n: sorted(places, key=lambda i: (-self.idf[words[i]], i))[:n]  # noqa: B023, E731
            self.at.append(sorted({*rarest(range(len(words)), RARE), *rarest(range(at, at + len(key)), RARE_KEY)}))
        self.near = [[i for i in range(max(0, at - NEAR), min(len(w), at + len(k) + NEAR)) if not at <= i < at + len(k)] for w, k, at in zip(self.words, self.keys, self.key_at, strict=True)]
        self.postings: dict[str, list[int]] = {}
        for t, (words, places) in enumerate(zip(self.words, self.at, strict=True)):
            for i in places:
                self.postings.setdefault(words[i], []).append(t * WIDE + i)
        self.key_words = sorted({words[i] for words, key, at, places in zip(self.words, self.keys, self.key_at, self.at, strict=True) for i in places if at <= i < at + len(key)})


def _find(words: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


def _strings(values: list[str]) -> Column:
    """A constant array; it folds to one literal."""
    return F.split(F.lit(" ".join(values)), " ")


def _numbers(values: list, kind: str) -> Column:
    return F.split(F.lit(" ".join(map(repr, values))), " ").cast(f"array<{kind}>")


def scan(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    vocabulary = sorted({w for _, text, _ in templates for w in text.split()})
    index = Index(templates, document_frequencies(docs, vocabulary), docs.count())
    phrases = [(p.split(), label) for p, label in base.items()]
    anchors = [max(range(len(p)), key=lambda i: (len(p[i]), -i)) for p, _ in phrases]  # noqa: B023

    rare = sorted({*index.postings, *(p[a] for (p, _), a in zip(phrases, anchors, strict=True))})
    always = sorted({*index.key_words, *(p[a] for (p, _), a in zip(phrases, anchors, strict=True))})
    weight = F.map_from_arrays(_strings(rare), _numbers([index.idf.get(w, 0.0) for w in rare], "double"))
    posted = F.map_from_arrays(_strings([*index.postings]), F.array(*[_numbers(p, "int") for p in index.postings.values()]))
    words, labels = F.array(*[_strings(w) for w in index.words]), _strings(index.labels)
    keys, key_at = F.array(*[_strings(k) for k in index.keys]), _numbers(index.key_at, "int")
    beside = F.array(*[_numbers(a, "int") if a else F.array().cast("array<int>") for a in index.near])
    wanted = _numbers([SHARE * sum(index.idf[w[i]] for i in a) - 1e-9 for w, a in zip(index.words, index.near, strict=True)], "double")
    weights = F.array(*[_numbers([index.idf[x] for x in w], "double") for w in index.words])

    # The file's rare words, then the places at which those looked up stand.
    rows = docs.select("doc_id", words_of().alias("w"))
    rows = rows.select("doc_id", "w", F.array_intersect("w", _strings(rare)).alias("rare"))
    ranked = F.transform(F.sort_array(F.transform("rare", lambda x: F.struct((-F.element_at(weight, x)).alias("o"), x.alias("x")))), lambda s: s["x"])
    rows = rows.select("doc_id", "w", F.array_union(F.slice(ranked, 1, LOOKED_UP), F.array_intersect("rare", _strings(always))).alias("asked"))
    everywhere = F.when(F.size("asked") > 0, F.sequence(F.lit(0), F.size("w") - 1)).otherwise(F.array().cast("array<int>"))
    # Arrays that lambdas use are bound as lambda variables; as outer expressions they'd be taken anew for each element.
    bound = F.array(F.struct(F.col("w").alias("w"), F.col("asked").alias("asked"), everywhere.alias("every")))
    places = F.transform(bound, lambda b: F.struct(b["w"].alias("w"), F.filter(b["every"], lambda i: F.array_contains(b["asked"], F.get(b["w"], i))).alias("places")))

    def matches(b: Column) -> Column:
        """Starts of templates in the file, as (start + WIDE) * WIDE + template."""
        file = b["w"]

        def stands(code: Column) -> Column:
            t, start = (code % WIDE).cast("int"), (F.floor(code / WIDE) - WIDE).cast("int")
            own, weight_of = F.get(words, t), F.get(weights, t)
            agree = F.aggregate(F.get(beside, t), F.lit(0.0), lambda u, a: u + F.when(F.get(file, start + a) == F.get(own, a), F.get(weight_of, a)).otherwise(0.0))
            at = start + F.get(key_at, t)
            return (agree >= F.get(wanted, t)) & (at >= 0) & (F.slice(file, F.greatest(at, F.lit(0)) + 1, F.size(F.get(keys, t))) == F.get(keys, t))

        def starts(i: Column) -> Column:
            found = F.coalesce(F.element_at(posted, F.get(file, i)), F.array().cast("array<int>"))
            return F.filter(F.transform(found, lambda p: (i - p % WIDE + WIDE).cast("long") * WIDE + F.floor(p / WIDE)), stands)

        return F.array_distinct(F.flatten(F.transform(b["places"], starts)))

    def cover(b: Column, code: Column) -> Column:
        t, start = (code % WIDE).cast("int"), (F.floor(code / WIDE) - WIDE).cast("int")
        pairs = F.zip_with(F.get(words, t), F.get(weights, t), lambda x, v: F.struct(x.alias("x"), v.alias("v")))
        inside = F.transform(pairs, lambda x, k: F.when(F.get(b["w"], start + k) == x["x"], x["v"]).otherwise(0.0))
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda u, v: u + v)
        return total(inside) / total(F.get(weights, t))

    def base_starts(b: Column, phrase: list[str], anchor: int) -> Column:
        here = lambda i: F.slice(b["w"], F.greatest(i - anchor, F.lit(0)) + 1, len(phrase)) == _strings(phrase)
        own = F.filter(b["places"], lambda i: (F.get(b["w"], i) == phrase[anchor]) & (i >= anchor) & here(i))
        return F.transform(own, lambda i: i - anchor)

    whole = F.transform(places, lambda b: F.struct(b["w"].alias("w"), matches(b).alias("found"), *[base_starts(b, p, a).alias(f"p{k}") for k, ((p, _), a) in enumerate(zip(phrases, anchors, strict=True))]))
    told = F.transform(
        whole,
        lambda b: F.struct(
            F.size(b["w"]).cast("long").alias("n_words"),
            F.transform(b["found"], lambda c: F.get(labels, (c % WIDE).cast("int"))).alias("found"),
            F.array_max(F.transform(b["found"], lambda c: cover(b, c))).alias("cover"),
            *[b[f"p{k}"].alias(f"p{k}") for k in range(len(phrases))],
        ),
    )
    rows = rows.select("doc_id", told[0].alias("r")).select("doc_id", "r.*")
    starts = [F.col(f"p{k}") for k in range(len(phrases))]
    rows = rows.select(
        "doc_id", "n_words", "found", "cover",
        sum((F.size(s) for s in starts), F.lit(0)).cast("long").alias("n_base"),
        F.least(*[F.array_min(s) for s in starts], F.lit(None).cast("int")).cast("long").alias("first_word"),
        F.greatest(*[F.array_max(s) for s in starts], F.lit(None).cast("int")).cast("long").alias("last_word"),
        F.array_compact(F.array(*[F.when(F.size(s) > 0, F.lit(label)) for s, (_, label) in zip(starts, phrases, strict=True)])).alias("own"),
    )
    line = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        line(F.col("own")).alias("base_labels"),
        line(F.concat("own", "found")).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.round(F.coalesce("cover", F.lit(0.0)), 6)).alias("score"),
    )
