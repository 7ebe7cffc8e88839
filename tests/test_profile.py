"""Profiles against brute force, and the plans they run as."""

import statistics

import pytest
from pyspark.sql import functions as F

from assaykit.functions import fixed_values as V
from assaykit.operators import profile as P
from assaykit.operators import rules as R


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def people(spark):
    rows = [(f"user{i}@x.example.com" if i % 10 else None, "hot" if i % 3 == 0 else f"name {i}", f"{i - 50}.5", "NaN-free", None) for i in range(300)]
    return spark.createDataFrame(rows, "mail string, name string, amount string, same string, empty string")


def test_profile_matches_brute_force(people):
    rows = {r["field"]: r for r in P.profile(people).collect()}
    amounts = [float(f"{i - 50}.5") for i in range(300)]
    assert rows["mail"]["detected_type"] == "email" and rows["mail"]["null_count"] == 30 and rows["mail"]["nullable"]
    assert rows["mail"]["unique_values"] == 270 and rows["mail"]["completeness"] == 0.9
    assert rows["name"]["unique_values"] == 201
    assert rows["amount"]["detected_type"] == "float"
    assert rows["amount"]["mean_value"] == pytest.approx(statistics.mean(amounts))
    assert rows["amount"]["std_value"] == pytest.approx(statistics.stdev(amounts))
    assert rows["same"]["is_categorical"] and rows["same"]["detected_type"] == "categorical"
    empty = rows["empty"]
    assert empty["detected_type"] == "string" and empty["overall_quality"] == 0.0 and not empty["is_categorical"]


def test_spread_is_stable_for_large_values(spark):
    values = [1.7e15 + i for i in range(100)]
    df = spark.createDataFrame([(f"-{v:.1f}",) for v in values], "v string")
    row = P.profile(df).first()
    assert row["detected_type"] == "float"
    assert row["std_value"] == pytest.approx(statistics.stdev(values), rel=1e-6)


def test_types_below_the_acceptance_are_strings(spark):
    for good, kind in ((8, "percentage"), (7, "string")):
        df = spark.createDataFrame([("1%" if i < good else f"word {i}",) for i in range(10)], "v string")
        assert P.profile(df).first()["detected_type"] == kind


def test_ties_go_to_the_earlier_type(spark):
    df = spark.createDataFrame([(str(1000 + i),) for i in range(60)], "v string")
    assert P.profile(df).first()["detected_type"] == "phone"
    assert P.profile(df, order=V.TYPE_ORDER_NUMERIC_FIRST).first()["detected_type"] == "integer"


def test_top_and_sample_values(people):
    top = P.top_categories(people.select("same")).collect()
    assert [(r["category"], r["frequency"], r["position"]) for r in top] == [("NaN-free", 300, 1)]
    sample = [r["value"] for r in P.sample_values(people, ["name"]).orderBy("position").collect()]
    assert sample == sorted({r["name"] for r in people.collect()})[:10]


def test_approximate_counts_are_close(people):
    exact = {r["field"]: r for r in P.profile_basic(people).collect()}
    for r in P.profile_basic_approx(people).collect():
        assert r["total_values"] == exact[r["field"]]["total_values"] and r["null_count"] == exact[r["field"]]["null_count"]
        assert abs(r["unique_values"] - exact[r["field"]]["unique_values"]) <= 0.06 * exact[r["field"]]["unique_values"] + 1


def test_profile_moves_data_once(people):
    plan = plan_of(P.profile(people))
    final = plan.split("== Initial Plan ==")[0]
    assert "Python" not in final
    assert final.count("posexplode") == 1  # the second pass reads the same histogram
    assert "ReusedExchange" in final


def test_rules_read_the_source_once(people):
    final = plan_of(P.with_categories(people)).split("== Initial Plan ==")[0]
    assert final.count("posexplode") == 1 and "WindowGroupLimit" in final


def test_top_values_are_cut_before_the_exchange(people):
    plan = plan_of(P.top_values(P.histogram(people), 3))
    assert "WindowGroupLimit" in plan


def test_rules(people):
    rules = {r.field: r for r in R.learn_rules(people)}
    longest = len("user299@x.example.com")
    assert not rules["mail"].required and rules["mail"].max_length == longest + 10
    assert rules["name"].required and rules["name"].min_length == 1
    assert rules["amount"].min_value < -50.5 and rules["same"].allowed == ("NaN-free",)
    definition = {r.field: r for r in R.learn_definition(people)}
    assert definition["amount"].min_value == -50.5 and definition["mail"].required is False


def test_field_metrics_count_empty_text_as_null(spark):
    df = spark.createDataFrame([("a",), ("a",), ("",), (None,)], "v string")
    r = P.field_metrics(df).first()
    assert (r["completeness"], r["uniqueness"], r["null_rate"]) == (0.5, 0.5, 0.5)


def test_numeric_columns_profile_like_their_text(spark):
    df = spark.range(20).select((F.col("id") * 1.25).alias("v"))
    r = P.profile(df).first()
    assert r["total_values"] == 20 and r["unique_values"] == 20


def test_approximate_profile_is_close_and_moves_no_data(people):
    exact = {r["field"]: r for r in P.profile(people).collect()}
    approx = P.profile_approx(people)
    for r in approx.collect():
        want = exact[r["field"]]
        assert abs(r["unique_values"] - want["unique_values"]) <= 0.06 * want["unique_values"] + 1
        for c in ("detected_type", "total_values", "null_count", "min_length", "max_length", "min_value", "max_value", "completeness", "validity"):
            assert r[c] == want[c], c
        assert r["std_value"] == (pytest.approx(want["std_value"]) if want["std_value"] is not None else None)
    assert plan_of(approx).split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1


def test_long_values_profile_alike_as_hashes(spark):
    rows = [("https://x.example.com/" + "a" * (20 * (i % 7)), "9" * (1 + i % 40) + ".5", "word " * (i % 30)) for i in range(200)]
    df = spark.createDataFrame(rows, "u string, n string, t string")
    plain = {r["field"]: r.asDict() for r in P.profile(df).collect()}
    hashed = {r["field"]: r.asDict() for r in P.profile(df, compact_over=20).collect()}
    for field, want in plain.items():
        for name, value in want.items():
            assert hashed[field][name] == (pytest.approx(value) if isinstance(value, float) else value), (field, name)


def test_rules_do_not_move_columns_that_hardly_repeat(spark):
    df = spark.range(3000).select(F.concat(F.lit("user"), F.col("id"), F.lit("@mail.example.org")).alias("mail"), (F.col("id") % 7).alias("kind"))
    assert P.many_valued(df, ["mail", "kind"]) == ["mail"]
    alone = P.rule_profile(df, ["mail"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(field_id" in alone and not any("value" in line for line in alone.splitlines() if "hashpartitioning" in line)
    whole = {r["field"]: r for r in P.rule_profile(df, ["kind", "mail"]).collect()}
    exact = {r["field"]: r for r in P.with_categories(df, ["kind", "mail"]).collect()}
    for name, row in exact.items():
        for c in ("field_id", "detected_type", "nullable", "min_length", "max_length", "min_value", "max_value", "is_categorical", "categories"):
            assert whole[name][c] == row[c]
