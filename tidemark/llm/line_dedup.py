"""Line dedup by a log-template tree, in DataFrame functions only.

Lines are parsed by a tree of fixed depth: the number of tokens (what runs of white space separate), then the LEAD
leading tokens (tokens with a digit, "@" or "://" are variable from the start). In each leaf that enough
texts reach, a token is constant at its position if enough texts have it there, and variable otherwise; a line's
template is its tokens with the variable ones generalised. A template recurs

- if at least MIN_DOCS texts have lines of it and at least CONSTANT of its tokens are constant (in MIN_DOCS texts), so
  that a leaf of different sentences gives none;
- for lines of LONG tokens and more, also if at least LEAST texts have it and at least FIXED of its tokens are
  constant (in LEAST texts).

Lines of recurring templates are dropped wherever they stand.

Texts are counted, not documents, so that exact copies don't make lines recur, and near copies count as one text:
each leaf has a first text (by hash), and a text counts as another one if most of its lines and of its tokens stand in
leaves whose first text is that one; lines that it shares with a third text are left out of this reckoning. Pages of one
layout share a header and a footer that may outweigh their bodies, which doesn't make them copies: where all that a text shares
with the first one stands in MIN_DOCS texts, and it has lines of its own, it is a copy only if it shares COPIED_LINES lines and
more with that one, and these are COPIED of them and its own lines, in number and in tokens. Lines that only near copies share stay; settling those is for
near-duplicate removal.

All counts combine before their shuffles, and joins on keys that can be hot are left to the adaptive skew join. Lines
move between tasks as hashes; texts are shuffled once, to drop the lines found. The leaves that recur are
broadcast if they are at most SENT, else lines are shuffled to them.

Defined cases: null and empty texts stay as they are; blank lines are never dropped; all columns pass through,
whatever their names; repeated rows are treated alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise

LEAD = 3
MIN_DOCS = 10
CONSTANT = 0.6
LONG = 12
LEAST = 2
FIXED = 0.8
COPIED_LINES = 4
COPIED = 0.8
SENT = 400_000  # leaves of two numbers each
VARIABLE = "[0-9]|@|://"
RUNS = "[\t\r\f][ \t\r\f]*| [ \t\r\f]+"  # white space that isn't a single blank already


def masked(line: Column) -> Column:
    """Tokens that are variable from the start as <*>."""
    return F.when(line.rlike(VARIABLE), F.regexp_replace(line, f"(?<![^ ])[^ ]*?(?:{VARIABLE})[^ ]*", "<*>")).otherwise(line)


def _lines(docs: DataFrame) -> DataFrame:
    """(th, pos, line, n, leaf): every line that isn't blank, with its number of tokens and its leaf. Only the leading
    tokens are parsed here; most lines stand alone in their leaf and need no more."""
    runs = F.col("text").contains("  ") | F.col("text").contains("\t") | F.col("text").contains("\r") | F.col("text").contains("\f")
    clean = F.when(runs, F.regexp_replace("text", RUNS, " ")).otherwise(F.col("text"))
    # The hash is projected before the lines are exploded; beside the explosion it would be taken anew for each line.
    one = docs.where("text is not null").select(F.unhex(F.md5("text")).alias("th"), clean.alias("text")).select("th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    n = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    some = one.withColumn("line", F.trim("line")).where("line <> ''").withColumn("n", n)
    return some.withColumn("leaf", F.xxhash64("n", masked(F.substring_index("line", " ", LEAD))))


def near_copies(places: DataFrame, shared: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(th, g): texts that count as another one, g. `places` has every line (th, n), `shared` those (th, n, leaf, first) in
    leaves of several texts."""
    whole = places.groupBy("th").agg(F.count("*").alias("lines"), F.sum("n").alias("tokens"))
    wide = shared.select("n", "leaf", "th").distinct().groupBy("n", "leaf").agg((F.count("*") >= min_docs).alias("wide")).where("wide")
    parts = shared.join(wide, ["n", "leaf"], "left").groupBy("th", "first")
    parts = parts.agg(F.count("*").alias("c"), F.sum("n").alias("t"), F.sum(F.when(F.col("wide"), 0).otherwise(1)).alias("few"))
    other = lambda c: F.when(F.col("th") != F.col("first"), c)
    best = parts.groupBy("th").agg(
        F.max(other(F.struct("c", "t", "first", "few"))).alias("x"), F.sum(other(F.col("c"))).alias("all_c"), F.sum(other(F.col("t"))).alias("all_t"),
        F.sum("c").alias("shared_c"), F.sum("t").alias("shared_t"),
    )
    most = F.expr("x.c * 2 > lines - (all_c - x.c) and x.t * 2 > tokens - (all_t - x.t)")
    nearly = (F.col("x.c") >= F.expr("x.c + lines - shared_c") * COPIED) & (F.col("x.t") >= F.expr("x.t + tokens - shared_t") * COPIED)
    copied = (F.col("x.few") > 0) | (F.col("shared_c") == F.col("lines")) | (F.col("x.c") >= COPIED_LINES) & nearly
    return best.where("x is not null").join(whole, "th").where(most & copied).select("th", F.col("x.first").alias("g"))


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(th, pos) of the lines whose template recurs; th is the md5 of the text."""
    places = materialise(_lines(docs).select("th", "pos", "n", "leaf"), "template-places")
    several = places.groupBy("n", "leaf").agg(F.min("th").alias("first"), F.max("th").alias("last")).where("first <> last").select("n", "leaf", "first")
    shared = materialise(places.join(several, ["n", "leaf"]).select("th", "n", "leaf", "first"), "template-shared")
    copies = materialise(near_copies(places, shared, min_docs), "template-copies")

    # Leaves that enough texts reach, near copies counted once.
    counted = shared.select("n", "leaf", "th").join(copies, "th", "left").select("n", "leaf", F.coalesce("g", "th").alias("g"))
    reach = counted.distinct().groupBy("n", "leaf").agg(F.count("*").alias("reach"))
    leaves = materialise(reach.where((F.col("reach") >= min_docs) | (F.col("n") >= LONG) & (F.col("reach") >= LEAST)), "template-leaves")
    few = F.broadcast if leaves.count() <= SENT else lambda df: df
    hot = _lines(docs).join(few(leaves), ["n", "leaf"]).select("n", "leaf", "reach", "th", "pos", masked(F.col("line")).alias("line"))
    hot = hot.join(copies, "th", "left").select("n", "leaf", "reach", "th", "pos", F.coalesce("g", "th").alias("g"), "line", F.unhex(F.md5("line")).alias("id"))
    hot = materialise(hot, "template-lines")

    # Tokens of distinct lines, and the number of texts that have each at its place in the leaf.
    forms = hot.select("n", "leaf", "reach", "id", "line", "g").distinct().groupBy("n", "leaf", "reach", "id", "line").agg(F.count("*").alias("docs"))
    placed = forms.select("n", "leaf", "reach", "id", "docs", F.posexplode(F.split("line", " ")).alias("at", "word"))
    support = placed.where("word <> '<*>'").groupBy("n", "leaf", "at", "word").agg(F.sum("docs").alias("support")).where(F.col("support") >= min(LEAST, min_docs))
    told = placed.join(support, ["n", "leaf", "at", "word"], "left")
    often, twice = F.coalesce(F.col("support") >= min_docs, F.lit(False)), F.coalesce(F.col("support") >= LEAST, F.lit(False))
    token = lambda kept: F.sort_array(F.collect_list(F.struct("at", F.when(kept, F.col("word")).otherwise("<*>").alias("word"))))
    name = lambda kept: F.unhex(F.md5(F.array_join(token(kept)["word"], " ")))
    parsed = told.groupBy("n", "leaf", "reach", "id").agg(F.avg(often.cast("int")).alias("s1"), name(often).alias("t1"), F.avg(twice.cast("int")).alias("s2"), name(twice).alias("t2"))  # the tokens of one line
    wide = F.when((F.col("s1") >= CONSTANT) & (F.col("reach") >= min_docs), F.struct(F.lit(min_docs).alias("least"), F.col("t1").alias("template")))
    long = F.when((F.col("s2") >= FIXED) & (F.col("n") >= LONG), F.struct(F.lit(LEAST).alias("least"), F.col("t2").alias("template")))
    named = parsed.select("n", "leaf", "id", F.explode(F.array_compact(F.array(wide, long))).alias("x")).select("n", "leaf", "id", "x.*")
    named = materialise(named, "template-names")

    # Templates that enough texts have, and the lines of these.
    seen = hot.select("n", "leaf", "id", "g").distinct().join(named, ["n", "leaf", "id"]).select("n", "leaf", "least", "template", "g").distinct()
    recurs = seen.groupBy("n", "leaf", "least", "template").agg(F.count("*").alias("texts")).where("texts >= least")
    gone = named.join(recurs, ["n", "leaf", "least", "template"]).select("n", "leaf", "id").distinct()
    return hot.select("n", "leaf", "id", "th", "pos").join(gone, ["n", "leaf", "id"]).select("th", "pos").distinct()


def drop_recurring(docs: DataFrame, min_docs: int = MIN_DOCS, count: str | None = None) -> DataFrame:
    """docs without the lines whose template recurs; with `count`, a column of how many were dropped."""
    key, gone = fresh(docs, "key"), fresh(docs, "gone")
    drops = recurring_lines(docs, min_docs).groupBy(F.col("th").alias(key)).agg(F.collect_list("pos").alias(gone))  # one text's own lines
    drops = materialise(drops, "template-drops")
    lines = F.split("text", "\n")
    # The text's lines and the places to keep are bound once, not for each line.
    both = F.array(F.struct(lines.alias("l"), F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)).alias("k")))
    kept = F.transform(both, lambda b: F.array_join(F.transform(b["k"], lambda i: F.get(b["l"], i)), "\n"))[0]
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)
    joined = docs.withColumn(key, F.unhex(F.md5("text"))).join(drops, key, "left")
    columns = [text.alias("text") if c == "text" else joined[f"`{c}`"] for c in docs.columns]
    return joined.select(*columns, *([F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(count)] if count else []))
