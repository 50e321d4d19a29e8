"""Hash-chained records and the checks of a committed document."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import row_json

# Fixed values.
GENESIS = "0" * 64
GRADES = ["S", "A", "B", "C"]
TIME_TYPES = ["単発", "局面展開", "予定日"]
CODE_FORM = "^[0-9][0-9A-Z]{3}$"


def last_of(log: DataFrame, by: list[str]) -> DataFrame:
    """(by, _seq, _hash) of the last record of each chain of a log, for `chain` to go on from."""
    return log.groupBy(*by).agg(F.max("_seq").alias("_seq"), F.max_by("_hash", "_seq").alias("_hash"))


def chain(rows: DataFrame, kind: str, order: str, after: tuple[int, str] | DataFrame = (0, GENESIS), by: list[str] | None = None) -> DataFrame:
    """rows with _seq, _kind, _prev_hash and _hash, the SHA-256 of the row's canonical JSON without the hash itself; so each
    hash covers the row's content and, by _prev_hash, all before it. With `by` each key has a chain of its own. `after` is the
    number and hash to go on from, or a frame with those of each key (see last_of); keys that it lacks begin.

    A chain is sequential by nature: its rows are one night's new records, in `order`, and run in one task. That task only
    joins texts and hashes; what a hash covers is built before it, in parallel."""
    keys = by or []
    whole = rows.withColumns({"_kind": F.lit(kind), "_prev_hash": F.lit("")})
    w = Window.partitionBy(*(keys or [F.lit(kind)])).orderBy(order)
    if isinstance(after, tuple):
        whole = whole.withColumns({"__from": F.lit(after[0]), "__hash": F.lit(after[1])})
    else:
        whole = whole.join(after.select(*keys, F.col("_seq").alias("__from"), F.col("_hash").alias("__hash")), keys, "left")
        whole = whole.withColumns({"__from": F.coalesce("__from", F.lit(0)), "__hash": F.coalesce("__hash", F.lit(GENESIS))})
    whole = whole.withColumn("_seq", F.row_number().over(w).cast("long") + F.col("__from"))
    before, rest = row_json(whole.schema, [c for c in whole.columns if c not in ("__from", "__hash")], around="_prev_hash")
    whole = whole.withColumns({"__before": before, "__rest": rest, "_hash": F.lit("")})

    def run(pdf):
        pdf = pdf.sort_values("_seq").reset_index(drop=True)
        prev, links, own = pdf["__hash"].iloc[0], [], []
        for a, b in zip(pdf["__before"], pdf["__rest"], strict=True):
            links.append(prev)
            prev = hashlib.sha256(f"{a}{prev}{b}".encode()).hexdigest()
            own.append(prev)
        return pdf.assign(_prev_hash=links, _hash=own)

    chained = whole.groupBy(*(keys or ["_kind"])).applyInPandas(run, whole.schema)
    return chained.select(*rows.columns, "_seq", "_kind", "_prev_hash", "_hash")


def audit(rows: DataFrame, chain: list[str], after: tuple[int, str] = (0, GENESIS)) -> DataFrame:
    """Rows of chains that aren't as they were written, with `problem`: `content` where the row's own hash, taken anew, isn't
    the one it carries; `link` where the hash it carries of the row before isn't that row's; `number` where the number before
    it is missing, or its own stands more than once. A row may have several. A last hash that was forged is told by the
    content, so nothing outside the table is needed. Rows look up the one before by number; no chain is gathered."""
    hashed = [c for c in rows.columns if c != "_hash"]
    own = F.sha2(row_json(rows.schema, hashed).cast("binary"), 256)
    before = rows.groupBy(*chain, (F.col("_seq") + 1).alias("_seq")).agg(F.max("_hash").alias("__before"))
    twice = rows.groupBy(*chain, "_seq").agg(F.count("*").alias("__times")).where("__times > 1")
    told = rows.withColumn("__own", own).join(before, [*chain, "_seq"], "left").join(twice, [*chain, "_seq"], "left")
    first = F.col("_seq") == after[0] + 1
    expected = F.when(first, F.lit(after[1])).otherwise(F.col("__before"))
    problems = {
        "number": (~first & F.col("__before").isNull()) | F.col("__times").isNotNull(),
        "link": ~F.col("_prev_hash").eqNullSafe(expected),
        "content": ~F.col("_hash").eqNullSafe(F.col("__own")),
    }
    found = F.array_compact(F.array(*[F.when(wrong, F.lit(name)) for name, wrong in problems.items()]))
    return told.withColumn("problem", F.explode(found)).select(*rows.columns, "problem")


def violations(checks: dict[str, Column]) -> Column:
    """Sorted names of the checks that don't hold (null counts as not holding)."""
    return F.array_sort(F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()])))


def candidate_checks(code_form: str = CODE_FORM) -> dict[str, Column]:
    return {
        "code": F.col("code").rlike(code_form),
        "realization_prob": F.col("realization_prob").between(0, 1),
        "stage": F.col("stage").between(1, 3),
        "side": F.col("side").isin("long", "caution"),
    }


def scenario_checks() -> dict[str, Column]:
    return {
        "expected_days": F.col("expected_days").between(1, 60),
        "time_type": F.col("time_type").isin(*TIME_TYPES),
        "n_candidates": F.col("n_candidates").between(1, 5),
    }


def downgrade(confirmations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Confirmations without supporting evidence of tier 1 or 2 become unconfirmed."""
    strong = evidence.where("supports = 'for' and source_tier <= 2").select("scenario_id", "arrow_no").distinct().withColumn("__ok", F.lit(True))
    out = confirmations.join(strong, ["scenario_id", "arrow_no"], "left")
    return out.withColumn("status", F.when((F.col("status") == "確認") & F.col("__ok").isNull(), "未確認").otherwise(F.col("status"))).drop("__ok")
