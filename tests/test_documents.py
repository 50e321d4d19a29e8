"""Schemas, canonical JSON, audits and row numbers."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.canonical import canonical_json
from tidemark.functions.json_schema import violations
from tidemark.operators import ranks, records
from tidemark.plans import documents
from tidemark.sources import files


def errors(spark, schema, *docs):
    rows = [(i, d if isinstance(d, str | None) else json.dumps(d, ensure_ascii=False)) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "i int, text string")
    return [r["e"] for r in df.select("i", violations(schema, F.col("text")).alias("e")).orderBy("i").collect()]


CANDIDATE = {
    "code": "130A", "company_name": "甲", "stage": 1, "viewpoint": "経済", "side": "long", "rationale": "r", "break_conditions": ["b"], "next_catalyst": "n",
    "realization_prob": 0.5, "direction_clear": True,
}
SCENARIO = {
    "scenario_ref": "new1", "event_id": "e", "statement": "s", "theme_ids": ["t"], "new_theme_flag": False, "time_type": "単発", "started": True, "end_condition": "x",
    "expected_days": 10, "strength": "Weak", "expected_rise": {"low": 0.1, "median": 0.2, "high": 0, "basis": "b"}, "past_case_ids": [],
    "check_plan": [{"arrow_no": 1, "arrow": "a", "indicator": "i", "source": "s", "criterion": "c", "next_release": None}], "candidates": [CANDIDATE], "rejected_candidates": [],
}
NIGHT = {
    "run": {"date": "2026-01-05", "mode": "通常", "model_id": "m", "prompt_version": "p", "input_pack_hash": "12345678"},
    "grades": [], "scenario_updates": [], "scenarios": [SCENARIO], "evidence": [], "check_status": [],
}


def changed(path, value):
    doc = json.loads(json.dumps(NIGHT))
    place = doc
    for k in path[:-1]:
        place = place[k]
    if value is KeyError:
        del place[path[-1]]
    else:
        place[path[-1]] = value
    return doc


def test_a_night_that_fits_has_no_errors(spark):
    empty = NIGHT | {"scenarios": []}
    assert errors(spark, documents.DAILY, NIGHT, empty, NIGHT | {"premise_cards": [], "theme_temperatures": []}) == [[], [], []]


CASES = [
    (("run", "date"), "2026-02-30", "run/date: not a date"),
    (("run", "date"), "20260105", "run/date: not a date"),
    (("run", "mode"), "全部", "run/mode: not one of 通常, 最小"),
    (("run", "model_id"), "", "run/model_id: shorter than 1"),
    (("run", "input_pack_hash"), "日本語の文字", "run/input_pack_hash: shorter than 8"),
    (("run", "more"), None, "run: not allowed: more"),
    (("run",), KeyError, "(全体): run is required"),
    (("grades",), {"a": 1}, "grades: not of type array"),
    (("scenarios", 0), "x", "scenarios/0: not of type object"),
    (("scenarios", 0, "expected_days"), 61, "scenarios/0/expected_days: greater than the maximum of 60"),
    (("scenarios", 0, "expected_days"), 0, "scenarios/0/expected_days: less than the minimum of 1"),
    (("scenarios", 0, "expected_days"), 3.5, "scenarios/0/expected_days: not of type integer"),
    (("scenarios", 0, "started"), 1, "scenarios/0/started: not of type boolean"),
    (("scenarios", 0, "theme_ids"), ["a", 2], "scenarios/0/theme_ids/1: not of type string"),
    (("scenarios", 0, "phase"), 7, "scenarios/0/phase: not of type string, null"),
    (("scenarios", 0, "scheduled_date"), "soon", "scenarios/0/scheduled_date: not a date"),
    (("scenarios", 0, "candidates"), [], "scenarios/0/candidates: fewer than 1 items"),
    (("scenarios", 0, "candidates"), [CANDIDATE] * 6, "scenarios/0/candidates: more than 5 items"),
    (("scenarios", 0, "candidates", 0, "code"), "13A0x", "scenarios/0/candidates/0/code: doesn't match ^[0-9][0-9A-Z]{3}$"),
    (("scenarios", 0, "candidates", 0, "stage"), 4, "scenarios/0/candidates/0/stage: not one of 1, 2, 3"),
    (("scenarios", 0, "candidates", 0, "stage"), "1", "scenarios/0/candidates/0/stage: not one of 1, 2, 3"),
    (("scenarios", 0, "candidates", 0, "realization_prob"), 1.01, "scenarios/0/candidates/0/realization_prob: greater than the maximum of 1"),
    (("scenarios", 0, "expected_rise", "low"), -0.1, "scenarios/0/expected_rise/low: less than the minimum of 0"),
    (("scenarios", 0, "expected_rise", "basis"), KeyError, "scenarios/0/expected_rise: basis is required"),
]


def test_each_kind_of_error_is_told_where_it_is(spark):
    found = errors(spark, documents.DAILY, *[changed(path, value) for path, value, _ in CASES])
    assert found == [[want] for _, _, want in CASES]


def test_what_is_no_document_and_the_order_of_errors(spark):
    assert errors(spark, documents.DAILY, "{broken", None, "[]", "null") == [["(全体): not JSON"], ["(全体): not JSON"], ["(全体): not of type object"], ["(全体): not of type object"]]
    doc = changed(("scenarios",), [SCENARIO | {"expected_days": 0}] * 11)
    found = errors(spark, documents.DAILY, doc | {"zzz": 1, "aaa": 2})[0]
    assert found == ["(全体): not allowed: aaa, zzz"] + [f"scenarios/{i}/expected_days: less than the minimum of 1" for i in range(11)]
    whole = {"a": 1.0, "b": None}
    form = documents.record({"a": {"type": "integer"}, "b": documents.or_null("string")})
    assert errors(spark, form, whole, {"a": True, "b": None}, {"a": 1}) == [[], ["a: not of type integer"], ["(全体): b is required"]]


def test_rejections_and_accepted(spark):
    df = spark.createDataFrame([(1, json.dumps(NIGHT)), (2, "{}"), (3, "no")], "doc long, text string")
    told = {r["source_hash"]: r["errors"] for r in documents.rejections(df, documents.DAILY, F.col("doc")).collect()}
    assert set(told) == {2, 3} and len(told[2]) == 6 and told[3] == ["(全体): not JSON"]
    assert [r["doc"]["run"]["mode"] for r in documents.accepted(df.drop("doc"), documents.DAILY, "run struct<mode: string>").collect()] == ["通常"]
    month = {"month": "2026-1", "model_id": "m", "prompt_version": "p", "related_movers": [], "miss_analysis": [], "failure_analysis": [], "improvements": [], "new_past_cases": [1]}
    assert errors(spark, documents.MONTHLY, month) == [["month: doesn't match ^[0-9]{4}-[0-9]{2}$", "new_past_cases/0: not of type object"]]


def test_canonical_json_is_what_the_json_library_writes(spark):
    rng = random.Random(5)
    doubles = [0.0, -0.0, 1.0, 0.1, 123456789.125, 1e15, 1e16, 1.5e22, 1e-4, 1.25e-5, 9.5e-7, -3.75, 12345678.0, 1e100, 2.5e-300] + [round(rng.uniform(-1e6, 1e6), 3) for _ in range(50)]
    texts = ["", "plain", 'q"\\/', "a\nb\tc\r\b\f", "\x00\x01\x1f\x7f", "日本語 é 😀", None]
    rows = [(d, texts[i % 7], i if i % 5 else None, i % 2 == 0, [d, None], {"b": texts[i % 7], "A": "x", "_": None}, (i, texts[(i + 1) % 7])) for i, d in enumerate(doubles)]
    df = spark.createDataFrame(rows, "z double, _t string, A long, flag boolean, l array<double>, m map<string,string>, s struct<y: int, B: string>")
    told = [r["j"] for r in df.coalesce(1).select(canonical_json(F.struct("*"), df.schema).alias("j")).collect()]
    names = ["z", "_t", "A", "flag", "l", "m", "s"]
    want = [json.dumps(dict(zip(names, [*r[:6], {"y": r[6][0], "B": r[6][1]}], strict=True)), ensure_ascii=False, sort_keys=True) for r in rows]
    assert told == want and all(math.isfinite(d) for d in doubles)


def test_every_forgery_of_a_chain_is_told(spark):
    rows = spark.createDataFrame([(c, n, f"text {n}\n", n / 8) for c in "abcdef" for n in range(1, 7)], "c string, n int, v string, x double")
    good = records.chain(rows, "grade", "n", by=["c"]).cache()
    for r in good.collect():
        body = {k: v for k, v in r.asDict().items() if k != "_hash"}
        import hashlib

        assert r["_hash"] == hashlib.sha256(json.dumps(body, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
    assert records.audit(good, ["c"]).count() == 0
    at = lambda c, n: (F.col("c") == c) & (F.col("_seq") == n)
    bad = good.where(~at("b", 3)).withColumns(
        {
            "v": F.when(at("a", 2), "forged").otherwise(F.col("v")),
            "_hash": F.when(at("c", 6), F.repeat(F.lit("0"), 64)).otherwise(F.col("_hash")),
            "_prev_hash": F.when(at("d", 4), F.repeat(F.lit("1"), 64)).otherwise(F.col("_prev_hash")),
        }
    ).unionByName(good.where(at("e", 5)))
    told = sorted({(r["c"], r["_seq"], r["problem"]) for r in records.audit(bad, ["c"]).collect()})
    assert told == [("a", 2, "content"), ("b", 4, "link"), ("b", 4, "number"), ("c", 6, "content"), ("d", 4, "content"), ("d", 4, "link"), ("e", 5, "number")]


@pytest.mark.parametrize("by", [None, ["g"]])
def test_numbers_without_one_task(spark, by):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(7)
    got = sorted((r["g"] or "", r["v"], r["i"], r["n"]) for r in ranks.numbered(df, [F.desc("v"), F.asc("i")], "n", by).collect())
    want, seen = [], {}
    for g, v, i in sorted(rows, key=lambda r: (-r[1], r[2])):
        k = g if by else 0
        seen[k] = seen.get(k, 0) + 1
        want.append((g or "", v, i, seen[k]))
    assert got == sorted(want)
    assert ranks.numbered(df.limit(0), [F.asc("v")], "n", by).count() == 0


def test_logs_go_on_and_a_torn_tail_stops_reading(spark, tmp_path):
    log, payload = str(tmp_path / "grade"), "n int, v string"
    rows = spark.createDataFrame([(n, f"日本\n{n}") for n in range(1, 6)], "n int, v string")
    files.append_records(records.chain(rows.where("n <= 3"), "grade", "n"), log)
    last = records.last_of(files.read_records(spark, log, payload), []).first()
    assert last["_seq"] == 3
    files.append_records(records.chain(rows.where("n > 3"), "grade", "n", after=(last["_seq"], last["_hash"])), log)
    read = files.read_records(spark, log, payload)
    whole = {r["n"]: r["_hash"] for r in records.chain(rows, "grade", "n").collect()}
    assert {r["n"]: r["_hash"] for r in read.collect()} == whole
    lines = [x for f in (tmp_path / "grade").glob("part-*") for x in f.read_text(encoding="utf-8").splitlines()]
    assert all(x == json.dumps(json.loads(x), ensure_ascii=False, sort_keys=True) for x in lines) and len(lines) == 5
    (tmp_path / "grade" / "part-blank.txt").write_text("\n  \n", encoding="utf-8")
    assert read.count() == 5
    (tmp_path / "grade" / "part-torn.txt").write_text('{"_seq": 6, "_kind": "gra', encoding="utf-8")
    with pytest.raises(Exception, match="part-torn.txt has a broken line"):
        files.read_records(spark, log, payload).collect()


def test_a_check_is_not_asked_for_its_type_at_each_value(spark):
    """Expressions in lambdas are interpreted; flatten and elements of arrays ask all that is below them for its type unless that is a variable."""
    import re

    names = [f"k{i}" for i in range(3)]
    schema = documents.listed(documents.record({n: documents.FROM_ONE for n in names}))
    df = spark.createDataFrame([('[{"k0": 1, "k1": 0, "k2": 2.5}, {"k0": null}]',)], "text string").select(violations(schema, F.col("text")).alias("e"))
    assert df.first()["e"] == ["0/k1: less than the minimum of 1", "0/k2: not of type integer", "1: k1 is required", "1: k2 is required", "1/k0: not of type integer"]
    plan = df._jdf.queryExecution().analyzed().toString()
    assert not re.findall(r"flatten\((?!filter\(lambda |lambda )", plan) and not re.findall(r"\)\)\[0\]", plan)
