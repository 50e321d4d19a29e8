"""The shapes of the documents that a night and a month commit, and their check as JSON texts.

Keys, value lists, bounds and patterns are fixed values of the formats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_schema import violations


def record(required: dict, optional: dict | None = None) -> dict:
    """An object with these keys and no others."""
    return {"type": "object", "required": list(required), "additionalProperties": False, "properties": {**required, **(optional or {})}}


def listed(items: dict, **bounds: int) -> dict:
    return {"type": "array", "items": items, **bounds}


def one_of(*values) -> dict:
    return {"enum": list(values)}


def or_null(kind: str, **more) -> dict:
    return {"type": [kind, "null"], **more}


TEXT, TEXTS, FILLED, FLAG = {"type": "string"}, listed({"type": "string"}), {"type": "string", "minLength": 1}, {"type": "boolean"}
DAY, DAY_OR_NONE = {"type": "string", "format": "date"}, or_null("string", format="date")
FROM_ZERO, FROM_ONE, SHARE = {"type": "number", "minimum": 0}, {"type": "integer", "minimum": 1}, {"type": "number", "minimum": 0, "maximum": 1}
STRENGTH = one_of("Weak", "Weak+", "Medium", "Strong")
RISE = record({"low": FROM_ZERO, "median": FROM_ZERO, "high": FROM_ZERO, "basis": TEXT})
CODE = {"type": "string", "pattern": "^[0-9][0-9A-Z]{3}$"}

_CARD = record(
    {"theme_id": TEXT, "version": FROM_ONE, "market_premise": FILLED, "key_numbers": TEXTS, "breaking_directions": TEXTS},
    {"based_on_event_id": or_null("string")},
)
_GRADE = record(
    {
        "event_id": TEXT, "provisional_grade": one_of("S", "A", "B", "C"), "new_fact": TEXT,
        "distance_from_premise": record({"summary": TEXT, "numbers": listed(record({"label": TEXT, "premise": TEXT, "new": TEXT}))}),
        "source_certainty": TEXT, "theme_ids": TEXTS, "check_basis": one_of("1段目", "銘柄群", "業種指数", "なし"), "check_codes": TEXTS, "new_theme_flag": FLAG,
    },
    {"premise_card_version": or_null("integer")},
)
_UPDATE = record(
    {
        "scenario_id": TEXT, "event_id": TEXT, "type": one_of("強化", "弱体化", "繰り返し", "消滅", "起動"), "new_fact_summary": TEXT, "reading_for": TEXT,
        "reading_against": TEXT, "strength_after": STRENGTH,
    },
    {"expected_rise": RISE, "evidence_urls": TEXTS},
)
_CANDIDATE = record(
    {
        "code": CODE, "company_name": FILLED, "stage": one_of(1, 2, 3), "viewpoint": one_of("経済", "投資家", "両方"), "side": one_of("long", "caution"), "rationale": TEXT,
        "break_conditions": listed(TEXT, minItems=1), "next_catalyst": TEXT, "realization_prob": SHARE, "direction_clear": FLAG,
    }
)
_PLAN = record({"arrow_no": FROM_ONE, "arrow": TEXT, "indicator": TEXT, "source": TEXT, "criterion": TEXT}, {"next_release": DAY_OR_NONE})
_SCENARIO = record(
    {
        "scenario_ref": TEXT, "event_id": TEXT, "statement": TEXT, "theme_ids": TEXTS, "new_theme_flag": FLAG, "time_type": one_of("単発", "局面展開", "予定日"), "started": FLAG,
        "end_condition": TEXT, "expected_days": FROM_ONE | {"maximum": 60}, "strength": STRENGTH, "expected_rise": RISE, "past_case_ids": TEXTS,
        "check_plan": listed(_PLAN, minItems=1), "candidates": listed(_CANDIDATE, minItems=1, maxItems=5),
        "rejected_candidates": listed(record({"code": TEXT, "company_name": TEXT, "reason": TEXT})),
    },
    {"phase": or_null("string"), "start_condition": or_null("string"), "scheduled_date": DAY_OR_NONE},
)
_EVIDENCE = record(
    {
        "scenario": TEXT, "arrow_no": {"type": "integer", "minimum": 0}, "url": {"type": "string", "pattern": "^https?://"}, "retrieved_at": TEXT | {"format": "date-time"},
        "value": TEXT, "source_tier": one_of(1, 2, 3, 4), "supports": one_of("for", "against"),
    },
    {"published_at": or_null("string")},
)
_STATUS = record({"scenario": TEXT, "arrow_no": FROM_ONE, "status": one_of("確認", "否定", "未確認")})

DAILY = record(
    {
        "run": record({"date": DAY, "mode": one_of("通常", "最小"), "model_id": FILLED, "prompt_version": FILLED, "input_pack_hash": {"type": "string", "minLength": 8}}),
        "grades": listed(_GRADE), "scenario_updates": listed(_UPDATE), "scenarios": listed(_SCENARIO), "evidence": listed(_EVIDENCE), "check_status": listed(_STATUS),
    },
    {"premise_cards": listed(_CARD), "theme_temperatures": listed(record({"theme_id": TEXT, "temperature": one_of("上昇中", "横ばい", "冷却中"), "reason": TEXT}))},
)

MONTHLY = record(
    {
        "month": {"type": "string", "pattern": "^[0-9]{4}-[0-9]{2}$"}, "model_id": TEXT, "prompt_version": TEXT,
        "related_movers": listed(record({"event_id": TEXT, "code": TEXT, "company_name": TEXT, "related": FLAG, "reason": TEXT})),
        "miss_analysis": listed(record({
            "event_id": TEXT, "code": TEXT, "detail": TEXT,
            "cause": one_of("足切りで落ちた", "等級を低く付けた", "連想の幅が足りない", "候補の上限で落ちた", "照合で落ちた", "その他"),
        })),
        "failure_analysis": listed(record({"scenario_id": TEXT, "code": TEXT, "wrong_arrow": or_null("integer"), "detail": TEXT})),
        "improvements": listed(record({"target": one_of("指示文", "前提カード", "等級の基準", "過去事例", "足切り", "その他"), "proposal": TEXT, "reason": TEXT})),
        "new_past_cases": listed({"type": "object"}),
    }
)


def checked(documents: DataFrame, schema: dict, text: str = "text", into: str = "errors") -> DataFrame:
    """documents with what is wrong with each, sorted by path."""
    return documents.withColumn(into, violations(schema, F.col(text)))


def rejections(documents: DataFrame, schema: dict, source_hash: Column, text: str = "text") -> DataFrame:
    """(source_hash, errors): the commit_rejection records of the documents that don't fit, no JSON included."""
    return checked(documents, schema, text).where(F.size("errors") > 0).select(source_hash.alias("source_hash"), "errors")


def accepted(documents: DataFrame, schema: dict, shape: str, text: str = "text") -> DataFrame:
    """The documents that fit, parsed into `shape`, a type of Spark, as `doc`."""
    return checked(documents, schema, text).where(F.size("errors") == 0).drop("errors").withColumn("doc", F.from_json(text, shape))
