"""Cleaning, warehouse, reports and registry on small frames."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from assaykit.operators import clean as C
from assaykit.operators import insights as I
from assaykit.operators import registry as S
from assaykit.operators import reports as G
from assaykit.operators import warehouse as W
from assaykit.plans import fixtures as X


def stamp(text):
    return datetime.fromisoformat(text)


def test_clean(spark):
    df = spark.createDataFrame([(" a ", "NULL", 1.0), ("nan", "", float("nan")), ("b", " None ", 2.0)], " `First Name` string, `x` string, n double")
    df = df.withColumnRenamed("First Name", " First Name ")
    assert [tuple(r) for r in C.clean(df).collect()] == [("a", None, 1.0), ("b", None, 2.0)]
    assert C.clean(df).columns == ["First_Name", "x", "n"]


def test_clean_does_not_shuffle(spark):
    df = spark.createDataFrame([("a", "b")], "x string, y string")
    assert "Exchange" not in C.clean(df)._jdf.queryExecution().executedPlan().toString()


def test_flatten(spark):
    df = spark.sql("SELECT 1 AS id, named_struct('b', named_struct('c', 2), 'd', 3) AS a")
    assert C.flatten(df).columns == ["id", "a.b.c", "a.d"]


def test_merge_keeps_old_values_where_none_are_given(spark):
    jobs = spark.createDataFrame([(1, "pending", None, None, 10), (2, "pending", None, None, 20), (3, "completed", stamp("2020-01-01"), None, 30)],
                                 "job_id long, status string, completed_at timestamp_ntz, error_message string, total_records long")
    updates = spark.createDataFrame([(1, "failed", "boom", None), (2, "processing", None, 99)], "job_id long, status string, error_message string, total_records long")
    now = F.lit("2021-05-05 00:00:00").cast("timestamp_ntz")
    rows = {r["job_id"]: r for r in W.merge_job_status(jobs, updates, now).collect()}
    assert (rows[1]["status"], rows[1]["completed_at"], rows[1]["error_message"], rows[1]["total_records"]) == ("failed", stamp("2021-05-05"), "boom", 10)
    assert (rows[2]["status"], rows[2]["completed_at"], rows[2]["total_records"]) == ("processing", None, 99)
    assert rows[3]["completed_at"] == stamp("2020-01-01")


def test_empty_input_gives_zero_rates(spark):
    empty = spark.createDataFrame([], "is_valid boolean, quality_score double, quality_level string")
    r = W.processing_metrics(empty).first()
    assert (r["total_records"], r["success_rate"], r["avg_quality_score"]) == (0, 0.0, 0.0)


def test_date_dimension(spark):
    rows = W.date_dimension(spark.sql("SELECT DATE'2024-12-30' AS first_day, DATE'2025-01-05' AS last_day")).orderBy("date_id").collect()
    assert [r["date_id"] for r in rows][:3] == [20241230, 20241231, 20250101]
    assert (rows[0]["week"], rows[0]["day_of_week"], rows[0]["day_name"], rows[-1]["is_weekend"]) == (1, 1, "Monday", True)


@pytest.mark.parametrize("created, text", [
    ("2024-01-08 12:00:00", "2 days ago"), ("2024-01-09 11:59:00", "1 day ago"), ("2024-01-10 09:00:00", "3 hours ago"), ("2024-01-10 10:59:59", "1 hour ago"),
    ("2024-01-10 11:00:00", "60 minutes ago"), ("2024-01-10 11:58:00", "2 minutes ago"), ("2024-01-10 11:59:00", "Just now"), (None, "Unknown time")])
def test_age_text(spark, created, text):
    now = F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")
    assert spark.range(1).select(G.age_text(F.lit(created).cast("timestamp_ntz"), now)).first()[0] == text


def test_latest_is_a_top_k(spark, sf):
    plan = G.latest(X.jobs(spark, sf), "created_at", "job_id", 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_job_totals_are_combined_before_the_join(spark, sf):
    plan = X.jobs(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan
    assert "ReadSchema" in plan and "l_shipdate" not in plan  # unused columns are not read


@pytest.mark.parametrize("rate, first", [(95.0, "Excellent"), (85.0, "Good"), (70.0, "Fair"), (69.9, "Poor")])
def test_report_insight_thresholds(spark, rate, first):
    row = spark.createDataFrame([(100, 80, 20, 64, 0, 0, 16, rate, "missing", 11)],
                                "total_records long, valid_records long, invalid_records long, excellent_records long, good_records long, fair_records long, "
                                "poor_records long, success_rate_pct double, top_error string, top_error_count long")
    found = [r["insight"] for r in I.report_insights(row).orderBy("position").collect()]
    assert found[0].startswith(first)
    assert found[1] == "Majority of valid records have excellent quality scores"
    assert found[-1] == "Over 50% of errors are related to missing - focus on fixing this issue"


def entry(spark, name, day, fields):
    return spark.createDataFrame([(name, "file", stamp(f"2024-01-{day:02d}"), fields)], f"schema_name string, source_type string, created_at timestamp_ntz, fields {S.FIELD_TYPE}")


def test_registry(spark):
    a, b = [("id", "integer", True), ("name", "string", False)], [("name", "string", True), ("mail", "email", False)]
    first = S.register(S.empty_registry(spark), entry(spark, "c", 1, a))
    assert [(r["schema_name"], r["schema_version"]) for r in first.collect()] == [("c", 1)]
    again = S.register(first, entry(spark, "c", 2, list(reversed(a))).unionByName(entry(spark, "c", 3, b)).unionByName(entry(spark, "c", 4, b)))
    assert [(r["schema_name"], r["schema_version"]) for r in again.collect()] == [("c", 2)]
    both = first.unionByName(again)
    changes = {r["field"]: r["change"] for r in S.evolution(both).collect()}
    assert changes == {"id": "removed", "mail": "added", "name": "modified"}
    fields = S.fields_of(S.schema_info(both, "c", 2))
    assert S.diff(fields, fields).count() == 0


def test_structured_store_skips_reserved_names_and_bad_values(spark):
    df = spark.createDataFrame([(1, "5", "x"), (2, "five", "y")], "k long, n string, id string")
    out = S.structured(df, {"n": "integer", "id": "string"}, row_index=F.col("k"), job_id="j", source_file="f", ingestion_time=F.lit("2024-01-01").cast("timestamp_ntz"),
                       status=F.lit("valid"), score=F.lit(1.0))
    assert out.columns == ["id", "job_id", "source_file", "row_index", "validation_status", "quality_score", "ingestion_time", "n"]
    assert [(r["id"], r["n"]) for r in out.collect()] == [("j-1", 5), ("j-2", None)]


def test_filters_are_values_not_sql(spark):
    df = spark.createDataFrame([(1, "x' OR '1'='1"), (2, "b")], "k int, v string")
    assert S.query_structured(df, {"v": "x' OR '1'='1"}, ["k"]).count() == 1
    assert S.query_structured(df, {"v": "' OR 1=1 --"}, ["k"]).count() == 0


def test_json_field_types(spark):
    df = spark.createDataFrame([('{"a": 1, "b": 1, "d": "2024-01-01", "o": {"x": 1}, "n": null}',), ('{"a": 2, "b": 1.5, "d": "2024-01-02", "o": {"x": 2}}',), ("[1]",), ("{bad",)], "p string")
    assert {r["field"]: r["type"] for r in S.json_field_types(df, "p").collect()} == {"a": "integer", "b": "float", "d": "datetime", "o": "json"}
