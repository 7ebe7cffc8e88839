"""Validation against a record-at-a-time model, checks, splits."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assaykit.functions import fixed_values as V
from assaykit.operators import checks as K
from assaykit.operators import validate as E
from assaykit.operators import warehouse as W
from assaykit.operators.rules import FieldRule

RULES = [
    FieldRule("name", "string", True, 3, 8),
    FieldRule("mail", "email", False, 5, 30),
    FieldRule("amount", "float", True, None, None, 0.0, 10.0),
    FieldRule("tier", "categorical", True, None, None, None, None, ("gold", "silver")),
]


def model(record):
    """What one record scores, field by field."""
    scores, issues, warnings = [], [], []
    for r in RULES:
        v, score = record.get(r.field), 1.0
        if v is None or v == "":
            if r.required:
                issues.append((r.field, "missing_value"))
            scores.append(0.0 if r.required else 0.9)
            continue
        bad_type = {"email": lambda: not re.match(V.PATTERNS["email"][0], v, re.I),
                    "float": lambda: not re.match(V.FLOAT_PATTERN, v, re.I)}.get(r.kind, lambda: False)()
        if bad_type:
            issues.append((r.field, "invalid_format"))
            score *= 0.5
        if r.min_length is not None and len(v) < r.min_length:
            issues.append((r.field, "length_violation"))
            score *= 0.7
        elif r.max_length is not None and len(v) > r.max_length:
            issues.append((r.field, "length_violation"))
            score *= 0.8
        if r.kind == "float":
            try:
                if not r.min_value <= float(v) <= r.max_value:
                    issues.append((r.field, "out_of_range"))
                    score *= 0.7
            except ValueError:
                pass
        if r.allowed and v not in r.allowed:
            warnings.append(r.field)
            score *= 0.9
        if r.kind == "email" and bad_type:
            issues.append((r.field, "inconsistent_pattern"))
            score *= 0.6
        scores.append(score)
    total = sum(scores) / len(scores)
    return total, not issues and total >= 0.6, sorted(issues), warnings


CELLS = {
    "name": st.sampled_from([None, "", "ab", "abc", "abcdefgh", "abcdefghi"]),
    "mail": st.sampled_from([None, "", "a@b.co", "nope", "x" * 40 + "@b.co", "a.b.example.com"]),
    "amount": st.sampled_from([None, "", "0.0", "10.0", "10.5", "-1.5", "7", "abc", "99"]),
    "tier": st.sampled_from([None, "gold", "bronze", ""]),
}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.fixed_dictionaries(CELLS), min_size=1, max_size=40))
def test_records_score_as_the_model_says(spark, records):
    df = spark.createDataFrame([(i, r["name"], r["mail"], r["amount"], r["tier"]) for i, r in enumerate(records)],
                               "id int, name string, mail string, amount string, tier string")
    for row in E.validate(df, RULES, ["id"]).collect():
        total, valid, issues, warnings = model(records[row["id"]])
        assert row["quality_score"] == pytest.approx(total) and row["is_valid"] == valid
        assert sorted((i["field"], i["issue_type"]) for i in row["issues"]) == issues
        assert len(row["warnings"]) == len(warnings)
        assert 0.0 <= row["quality_score"] <= 1.0
        assert sum(row["field_scores"].values()) / 4 == pytest.approx(total)


def test_absent_and_unexpected_fields(spark):
    df = spark.createDataFrame([(1, "abc", "extra")], "id int, name string, odd string")
    r = E.validate(df, RULES, ["id"]).first()
    assert [i["description"] for i in r["issues"]] == ["Required field is missing"] * 2
    assert r["warnings"] == ["Optional field 'mail' is missing", "Unexpected field 'odd' found"]
    assert r["field_scores"] == {"name": 1.0, "mail": 0.8, "amount": 0.0, "tier": 0.0}


def test_quotes_in_names_and_values(spark):
    rule = FieldRule("o'brien \\ co", "string", True, 2, 3, None, None, ("it's",))
    df = spark.createDataFrame([("it's",), ("x",)], ["o'brien \\ co"])
    rows = E.validate(df, [rule], []).collect()
    assert rows[0]["issues"][0]["field"] == "o'brien \\ co" and "it's" not in rows[0]["warnings"]
    assert rows[1]["warnings"] == ["Field 'o'brien \\ co' has unexpected category: x"]


def test_splits_partition_the_records(spark):
    df = spark.createDataFrame([(i, "abc" if i % 3 else "", "a@b.co", "1.0" if i % 5 else "z", "gold") for i in range(60)],
                               "id int, name string, mail string, amount string, tier string")
    r = E.validate(df, RULES, ["id"])
    assert E.good(r).count() + E.bad(r).count() == 60
    assert E.high_quality(r).count() + E.low_quality(r).count() == 60
    assert W.staging(r).count() + W.quarantine(r).count() == 60
    stats = E.ingest_stats(r).first()
    assert stats["valid_records"] + stats["invalid_records"] == stats["total_records"] == 60
    assert sum(stats[f"{n}_records"] for n in ("excellent", "good", "fair", "poor")) == stats["valid_records"]


def test_validation_is_one_stage_without_python(spark):
    df = spark.createDataFrame([("abc", "a@b.co", "1.0", "gold")], "name string, mail string, amount string, tier string")
    out = E.validate(df, RULES, []).filter(~F.col("is_valid")).select("quality_score")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert plan.count("RLIKE") <= 4  # a filter does not copy the patterns


def test_hot_key_duplicates(spark):
    rows = [(1 if i % 3 == 0 else i, i) for i in range(900)]
    df = spark.createDataFrame(rows, "k int, v int")
    want = {}
    for k, _ in rows:
        want[k] = want.get(k, 0) + 1
    got = {(r["k"], r["v"]): r["copies"] for r in K.mark_duplicates(df, ["k"]).collect()}
    assert got == {(k, v): want[k] for k, v in rows}


def test_duplicates_with_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (3, 3)], "k int, v int")
    assert sorted(r["copies"] for r in K.mark_duplicates(df, ["k"]).collect()) == [1, 2, 2]


def test_orphans(spark):
    child = spark.createDataFrame([(1,), (2,), (2,), (9,), (9,), (None,)], "ref int")
    parent = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    assert [tuple(r) for r in K.orphans(child, "ref", parent, "id").collect()] == [(9, 2)]


def test_three_way_disposition_in_the_shape_of_the_recorded_run(spark):
    rows = ([("A", 1.0, "2025-09-02", "2025-09-01")] * 21 + [("A", -1.0, "2025-09-02", "2025-09-01")] * 9
            + [("A", 2.0, "2025-08-30", "2025-09-01")] * 6 + [(None, 1.0, "2025-09-02", "2025-09-01")] * 3
            + [("A", None, "2025-09-02", "2025-09-01")] * 3 + [("A", 1.0, None, "2025-09-01")] * 1)
    df = spark.createDataFrame(rows, "cust string, freight double, shipped string, ordered string")
    kind = K.disposition([F.col("cust"), F.col("freight"), F.col("shipped")], [F.col("freight") < 0, F.col("shipped") < F.col("ordered")])
    assert {r["d"]: r["count"] for r in df.groupBy(kind.alias("d")).count().collect()} == {"accepted": 21, "quarantine": 15, "violation": 7}


def test_constraints_keep_records_valid_unless_required_is_missing(spark):
    definition = [FieldRule("a", "integer", True, None, None, 1.0, 5.0), FieldRule("b", "string", False, 2, 3, None, None, ("xx", "yyy"))]
    df = spark.createDataFrame([("9", "x"), ("", None), ("2", "xx"), ("q", "zzzz")], "a string, b string")
    rows = K.validate_constraints(df, definition).collect()
    assert [r["is_valid"] for r in rows] == [True, False, True, True]
    assert rows[0]["quality_score"] == pytest.approx((0.5 + 0.7 * 0.6) / 2)
    assert rows[1]["quality_score"] == pytest.approx((0.0 + 1.0) / 2)
    assert rows[3]["quality_score"] == pytest.approx((0.8 + 0.7 * 0.6) / 2)
    assert [r["status"] for r in rows] == ["valid", "invalid", "valid", "warning"]


def test_custom_rules(spark):
    df = spark.createDataFrame([("a1", 5.0, "x"), ("b", 50.0, "x"), ("a2", None, "y")], "code string, n double, u string")
    rules = [K.CustomRule("code", "pattern", "^a\\d$", "bad code"), K.CustomRule("n", "range", (0, 10), "n out"),
             K.CustomRule("n", "required", None, "n missing"), K.CustomRule("u", "unique", None, "u repeats"), K.CustomRule("u", "values", ["x"], "u off")]
    got = {r["code"]: r["failures"] for r in K.validate_custom(df, rules).collect()}
    assert got == {"a1": ["u repeats"], "b": ["bad code", "n out", "u repeats"], "a2": ["n missing", "u off"]}
    with pytest.raises(ValueError):
        K.validate_custom(df, [K.CustomRule("u", "guess")])
