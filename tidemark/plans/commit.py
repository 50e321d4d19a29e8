"""The commit of a night's documents: checks, numbers, rules across kinds, and one frame for each record kind.

Inputs are flat frames that share doc (source hash): documents, scenarios, candidates, plans, evidence, statuses,
updates. A document that breaks a check or was committed before gives one row of commit_rejection and nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import records
from ..operators.ranks import numbered
from ..shared import cut
from ..sources import masters


SHORTEST, LONGEST = 5, 20  # business days that a one-off scenario is given


@dataclass(frozen=True)
class Known:
    """What was committed before: document hashes, scenario ids, (scenario_id, arrow_no) with strong support."""

    documents: DataFrame
    scenarios: DataFrame
    support: DataFrame


def numbers(scenarios: DataFrame, n_known: int) -> DataFrame:
    """scenarios (doc, ref, ...) with scenario_id: SC and a running number in order of doc and ref, after the known ones."""
    told = numbered(scenarios, [F.asc("doc"), F.asc("ref")], "__n")
    return told.withColumn("scenario_id", F.format_string("SC%04d", F.col("__n") + n_known)).drop("__n")


def commit(documents: DataFrame, scenarios: DataFrame, candidates: DataFrame, evidence: DataFrame, statuses: DataFrame, updates: DataFrame, known: Known, names: DataFrame, aliases: DataFrame, n_known: int, plans: DataFrame | None = None, more: dict[str, DataFrame] | None = None, code_form: str = records.CODE_FORM, shown_code: Column | None = None) -> dict[str, DataFrame]:
    """The frames to append, by record kind, and `warning` (doc, text): what was mended or left out of documents that were taken.

    documents (doc); scenarios (doc, ref, time_type, expected_days, low, median, high, started); candidates (doc, ref, no,
    code, company_name, realization_prob, stage, side); evidence (doc, scenario, arrow_no, supports, source_tier); statuses
    (doc, scenario, arrow_no, status); updates (doc, scenario_id, change). `scenario` is a ref of this document or a known id. plans
    (doc, ref, arrow_no, ...) become unconfirmed rows of check_plan; `more` has frames (doc, ...) by the name of a kind that is
    recorded as it is, such as grade, premise_card and theme_temperature. Codes have the form `code_form`; warnings show them as
    `shown_code`, or as they are.
    """
    n = candidates.groupBy("doc", "ref").agg(F.count("*").alias("n_candidates"))
    bad = lambda df, checks: df.select("doc", F.explode(records.violations(checks)).alias("error"))
    broken = bad(scenarios.join(n, ["doc", "ref"], "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0))), records.scenario_checks())
    broken = broken.unionByName(bad(candidates, records.candidate_checks(code_form))).distinct()
    again = documents.join(known.documents, "doc", "left_semi").join(broken.select("doc"), "doc", "left_anti").select("doc", F.lit("committed before").alias("error"))
    errors = cut(broken.unionByName(again).groupBy("doc").agg(F.array_sort(F.collect_set("error")).alias("errors")))  # at most a name for each check
    ok = lambda df: df.join(errors, "doc", "left_anti")

    given = cut(numbers(ok(scenarios), n_known))
    ids = given.select("doc", F.col("ref").cast("string").alias("scenario"), F.col("scenario_id").alias("__new"))
    old = known.scenarios.select(F.col("scenario_id").alias("scenario")).distinct().withColumn("__old", F.col("scenario"))

    def resolved(df):
        """Rows whose scenario is a ref of their document or a known id."""
        out = ok(df).join(ids, ["doc", "scenario"], "left").join(old, "scenario", "left").withColumn("scenario_id", F.coalesce("__new", "__old"))
        return out.where("scenario_id is not null").drop("__new", "__old", "scenario")

    three = F.array_sort(F.array("low", "median", "high"))
    days = F.when(F.col("time_type") == "単発", F.least(F.greatest("expected_days", F.lit(SHORTEST)), F.lit(LONGEST))).otherwise(F.col("expected_days"))
    scenario = given.select(
        "doc", "ref", "scenario_id", "time_type", days.alias("expected_days"), three[0].alias("low"), three[1].alias("median"), three[2].alias("high"),
        F.when(F.col("started"), "進行中").otherwise("待機").alias("status"), F.lit(1).alias("version"),
    )
    told = masters.reconcile(ok(candidates), names, aliases).join(given.select("doc", "ref", "scenario_id"), ["doc", "ref"])
    place = F.row_number().over(Window.partitionBy("scenario_id").orderBy("no", "code"))
    accepted = told.where("ok").withColumn("candidate_id", F.concat("scenario_id", F.lit("-"), place.cast("string"))).drop("ok", "reason")
    rejected = told.where("not ok").select("doc", "scenario_id", "code", "company_name", "reason")
    proof = cut(resolved(evidence))
    support = proof.where("supports = 'for' and source_tier <= 2").select("scenario_id", "arrow_no").unionByName(known.support.select("scenario_id", "arrow_no"))
    seen = records.downgrade(resolved(statuses), support.withColumns({"supports": F.lit("for"), "source_tier": F.lit(1)}))
    kept = ok(updates).join(known.scenarios.select("scenario_id").distinct(), "scenario_id", "left_semi")
    if plans is not None:
        planned = ok(plans).join(given.select("doc", "ref", "scenario_id"), ["doc", "ref"]).withColumn("status", F.lit("未確認"))
        seen = planned.unionByName(seen, allowMissingColumns=True)

    say = lambda df, *parts: df.select("doc", F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).alias("text"))
    sid, unknown = F.col("scenario_id"), ok(updates).join(known.scenarios.select("scenario_id").distinct(), "scenario_id", "left_anti")
    lost = lambda df: ok(df).join(ids, ["doc", "scenario"], "left_anti").join(old, "scenario", "left_anti")
    strong = support.select("scenario_id", "arrow_no").distinct()
    warnings = [
        say(given.where("not (low <= median and median <= high)"), sid, ": 想定上昇幅の下限・中央・上限の順序が不正のため、並べ替えて記録"),
        say(given.where(days != F.col("expected_days")), sid, ": 単発型の想定期間 ", F.col("expected_days"), " を ", days, " 営業日に補正"),
        say(rejected, sid, ": 候補 ", F.col("code") if shown_code is None else shown_code, " ", F.col("company_name"), " を確定しない(", F.col("reason"), ")"),
        say(given.join(accepted.select("scenario_id").distinct(), "scenario_id", "left_anti"), sid, ": 確定できる候補が無いため、候補なしのシナリオとして記録"),
        say(unknown, "更新先のシナリオ ", sid, " が存在しないため、記録しない"),
        say(lost(evidence), "証拠の参照先 ", F.col("scenario"), " が不明なため、記録しない"),
        say(lost(statuses), "確認状況の参照先 ", F.col("scenario"), " が不明なため、記録しない"),
        say(resolved(statuses).where("status = '確認'").join(strong, ["scenario_id", "arrow_no"], "left_anti"), sid, " 矢印", F.col("arrow_no"), ": 信頼度1・2の証拠が無いため「未確認」に修正"),
    ]
    warned = warnings[0]
    for w in warnings[1:]:
        warned = warned.unionByName(w)
    out = {"commit_rejection": errors, "scenario": scenario, "candidate": accepted, "rejected_candidate": rejected, "evidence": proof, "check_plan": seen, "scenario_update": kept, "warning": warned}
    return out | {kind: ok(df) for kind, df in (more or {}).items()}
