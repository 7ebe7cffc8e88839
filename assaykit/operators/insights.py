"""Findings in words, drawn from one-row summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V


def _one_of(*cases: tuple[Column, str], otherwise: str | None = None) -> Column:
    out = None
    for cond, text in cases:
        out = (F.when if out is None else out.when)(cond, text)
    return out.otherwise(F.lit(otherwise))


def _as_rows(df: DataFrame, findings: list[Column]) -> DataFrame:
    return df.select(F.posexplode(F.array_compact(F.array(*findings))).alias("position", "insight"))


def validator_insights(summary: DataFrame) -> DataFrame:
    """``summary``: one row of ingest stats, schema counts and the most problematic field."""
    c, valid = F.col, F.col("valid_records") > 0
    rate = c("success_rate_pct")
    some = c("total_records") > 0
    findings = [
        F.when(~some, "No data processed yet"),
        F.when(some, F.format_string("Automatically detected %d fields with %d different data types", c("fields"), c("types"))),
        F.when(some, F.format_string("Most common data type: %s (%d fields)", c("top_type"), c("top_type_fields"))),
        F.when(some, _one_of(
            (rate >= 95, "Excellent data quality - very high success rate with intelligent validation"),
            (rate >= 80, "Good data quality - acceptable success rate"),
            (rate >= 60, "Fair data quality - consider data source review"),
            otherwise="Poor data quality - immediate attention required")),
        F.when(valid, _one_of(
            (F.try_divide(c("excellent_records"), c("valid_records")) * 100 >= 80, "Majority of valid records have excellent quality scores"),
            (F.try_divide(c("poor_records"), c("valid_records")) * 100 >= 30, "High percentage of poor quality records among valid data"))),
        F.when(c("worst_field").isNotNull(), F.format_string(
            "Most problematic field: '%s' with %d validation issues", c("worst_field"), c("worst_field_issues"))),
    ]
    return _as_rows(summary, findings)


def report_insights(summary: DataFrame) -> DataFrame:
    """``summary``: one row of ingest stats with the most common error and the number of failing records, and the
    throughput if it is known."""
    c, valid = F.col, F.col("valid_records") > 0
    rate = c("success_rate_pct")
    excellent = F.try_divide(c("excellent_records"), c("valid_records")) * 100
    strong = excellent + F.try_divide(c("good_records"), c("valid_records")) * 100
    poor = F.try_divide(c("poor_records"), c("valid_records")) * 100
    some = c("total_records") > 0
    findings = [
        F.when(~some, "No data to analyze"),
        F.when(some, _one_of(
            (rate >= 95, "Excellent data quality with very high success rate"),
            (rate >= 85, "Good data quality with acceptable success rate"),
            (rate >= 70, "Fair data quality - consider data source review"),
            otherwise="Poor data quality - immediate attention required")),
        F.when(valid, _one_of(
            (excellent >= 80, "Majority of valid records have excellent quality scores"),
            (poor >= 30, "High percentage of poor quality records - review data collection processes"))),
        F.when(valid & (strong >= 90), "Strong overall data quality suitable for production use"),
        F.when(c("top_error").isNotNull(), F.concat(F.lit("Most common validation issue: "), c("top_error"))),
        F.when(F.try_divide(c("top_error_count"), c("invalid_records")) > 0.5, F.concat(
            F.lit("Over 50% of errors are related to "), c("top_error"), F.lit(" - focus on fixing this issue"))),
    ]
    if "throughput_records_per_second" in summary.columns:
        speed = c("throughput_records_per_second")
        findings.insert(4, F.when(some, _one_of(
            (speed >= V.THROUGHPUT_HIGH, V.THROUGHPUT_TEXTS[0]), (speed < V.THROUGHPUT_LOW, V.THROUGHPUT_TEXTS[1]))))
    return _as_rows(summary, findings)
