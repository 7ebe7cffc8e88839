"""Routing and the warehouse tables: dimensions, facts, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V


# ---- routing -----------------------------------------------------------------------------------
def staging(results: DataFrame, floor: float = V.ROUTE_SCORE) -> DataFrame:
    """Records at or above the route score."""
    return results.filter(F.col("quality_score") >= floor).withColumn(
        "status", F.when(F.col("is_valid"), "completed").otherwise("pending"))


def quarantine(results: DataFrame, floor: float = V.ROUTE_SCORE) -> DataFrame:
    """Records below the route score, with severity and reason."""
    score = F.col("quality_score")
    return results.filter(score < floor).withColumns({
        "severity_score": 1.0 - score,
        "quarantine_reason": F.format_string(f"Quality score %.2f below threshold {floor}", score),
    })


def issue_types(issues: Column) -> Column:
    """The text before the colon of every issue."""
    return F.transform(issues, lambda i: F.split_part(i, F.lit(":"), F.lit(1)))


def ratio(part: Column, whole: Column) -> Column:
    """Quotient, zero where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


# ---- dimensions ----------------------------------------------------------------------------------
def date_id(stamp: Column) -> Column:
    return F.date_format(stamp, "yyyyMMdd").cast("int")


def date_dimension(spans: DataFrame) -> DataFrame:
    """Calendar rows for the ``first_day``..``last_day`` of a one-row frame."""
    days = spans.select(F.explode(F.sequence("first_day", "last_day")).alias("date_value"))
    d = F.col("date_value")
    return days.select(
        date_id(d).alias("date_id"), d, F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"),
        F.weekofyear(d).alias("week"), F.dayofmonth(d).alias("day"), (F.weekday(d) + 1).alias("day_of_week"),
        F.date_format(d, "EEEE").alias("day_name"), F.date_format(d, "MMMM").alias("month_name"),
        (F.weekday(d) >= 5).alias("is_weekend"))


def new_rows(candidates: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates whose key is not there yet, one row per key: of several the one that sorts first."""
    rest = [c for c in candidates.columns if c not in keys]
    first = F.min(F.struct(*[F.col(f"`{c}`") for c in rest])) if rest else F.count(F.lit(1))
    one = candidates.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(first.alias("__first"))
    columns = [F.col(f"`{c}`") if c in keys else F.col("__first").getField(c).alias(c) for c in candidates.columns]
    return one.select(*columns).join(existing.select(*keys).distinct(), keys, "left_anti")


# ---- job facts ------------------------------------------------------------------------------------
METRICS = ["total_records", "valid_records", "invalid_records", "quarantined_records", "avg_quality_score",
           "success_rate", "processing_duration_seconds", "throughput_records_per_second"]


def merge_job_status(jobs: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """Apply status updates: new metrics and messages win where they are given.

    Of several updates of a job the one with the latest ``updated_at`` counts; without that column
    several updates of one job raise an error, as none is the last.
    """
    fields = [c for c in updates.columns if c not in ("job_id", "updated_at")]
    if "updated_at" in updates.columns:
        one = F.max_by(F.struct(*fields), F.struct("updated_at", *fields))
    else:
        one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("several updates of one job without updated_at"))).otherwise(F.first(F.struct(*fields)))
    updates = updates.groupBy("job_id").agg(one.alias("__one")).select("job_id", "__one.*")
    changes = updates.select(
        "job_id", *[F.col(c).alias(f"new_{c}") for c in ("status", "error_message", *METRICS) if c in updates.columns],
        F.lit(True).alias("changed"))
    joined = jobs.join(changes, "job_id", "left")
    changed, done = F.col("changed"), F.col("new_status").isin("completed", "failed")
    out = []
    for c in jobs.columns:
        if c == "status":
            out.append(F.coalesce("new_status", "status").alias(c))
        elif c == "completed_at":
            out.append(F.when(changed & done, now).otherwise(F.col(c)).alias(c))
        elif f"new_{c}" in changes.columns:
            out.append(F.coalesce(f"new_{c}", c).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def validation_fact(results: DataFrame, job_id: Column, record_id: Column) -> DataFrame:
    return results.select(
        job_id.alias("job_id"), record_id.alias("record_id"), "is_valid", "quality_score", "quality_level",
        F.size("issues").alias("issue_count"), F.size("warnings").alias("warning_count"))


def quality_metric_fact(results: DataFrame, profiled: DataFrame, fields: list[str]) -> DataFrame:
    """Average field score next to the profile of each field."""
    scores = results.agg(*[F.avg(F.col("field_scores")[f]).alias(f) for f in fields])
    long = scores.unpivot([], fields, "field", "metric_value")
    return profiled.join(F.broadcast(long), "field").withColumn("metric_type", F.lit("comprehensive"))  # one row per field


JOB_METRICS = [
    ("Total Records", "count", "total_records"),
    ("Valid Records", "count", "valid_records"),
    ("Invalid Records", "count", "invalid_records"),
    ("Success Rate", "percentage", "success_rate_pct"),
    ("Data Quality Score", "score", "avg_quality_score"),
]


def job_metrics(jobs: DataFrame) -> DataFrame:
    """Five metrics per job in long form under the field ``__job__``."""
    wide = jobs.withColumn("success_rate_pct", F.col("success_rate") * 100)
    rows = F.array(*[
        F.struct(
            F.lit("__job__").alias("field_name"), F.lit(kind).alias("metric_type"),
            F.coalesce(F.col(source).cast("double"), F.lit(0.0)).alias("metric_value"),
            F.to_json(F.struct(F.lit(name).alias("display_name"), F.lit("job_summary").alias("category"))).alias("metric_details"))
        for name, kind, source in JOB_METRICS])
    return wide.select("job_id", "created_at", F.inline(rows))


def processing_metrics(results: DataFrame) -> DataFrame:
    """Counters of a run. ``poor_records`` are under the valid score, ``quarantined_records`` under the route score."""
    n, score = F.count(F.lit(1)), F.col("quality_score")
    return results.agg(
        n.alias("total_records"), F.count_if("is_valid").alias("valid_records"),
        F.count_if(~F.col("is_valid")).alias("invalid_records"),
        F.count_if(score < V.VALID_SCORE).alias("poor_records"), F.count_if(score < V.ROUTE_SCORE).alias("quarantined_records"),
        F.coalesce(F.avg(score), F.lit(0.0)).alias("avg_quality_score"), ratio(F.count_if("is_valid"), n).alias("success_rate"))


def rule_summary(cells: DataFrame, rules: dict[str, int]) -> DataFrame:
    """Counts per field and rule from ``field, bits`` rows; ``rules`` names the check bits of each rule.

    A field is one group with a counter per rule, so no row is copied per rule.
    """
    wide = cells.groupBy("field").agg(
        F.count(F.lit(1)).alias("records_checked"),
        *[F.count_if(F.col("bits").bitwiseAND(mask) == 0).alias(name) for name, mask in rules.items()])
    rows = wide.unpivot(["field", "records_checked"], list(rules), "rule", "records_passed")
    return rows.withColumn("records_failed", F.col("records_checked") - F.col("records_passed")).withColumn(
        "success_rate", ratio(F.col("records_passed"), F.col("records_checked")))


def period_summary(jobs: DataFrame) -> DataFrame:
    """Daily, weekly and monthly totals: one pass, each job counted under three periods."""
    periods = F.array(*[
        F.struct(F.lit(name).alias("period_type"), F.date_trunc(unit, "created_at").cast("date").alias("period_start"))
        for name, unit in (("daily", "day"), ("weekly", "week"), ("monthly", "month"))])
    spread = jobs.select(F.inline(periods), "status", "total_records", "valid_records", "invalid_records", "avg_quality_score")
    return spread.groupBy("period_type", "period_start").agg(
        F.count(F.lit(1)).alias("total_jobs"), F.count_if(F.col("status") == "completed").alias("completed_jobs"),
        F.count_if(F.col("status") == "failed").alias("failed_jobs"), F.sum("total_records").alias("total_records"),
        F.sum("valid_records").alias("valid_records"), F.sum("invalid_records").alias("invalid_records"),
        F.avg("avg_quality_score").alias("avg_quality_score"))


def lineage(step: str, before: DataFrame, after: DataFrame) -> DataFrame:
    """Records in and out of a step, as one row."""
    a = before.agg(F.count(F.lit(1)).alias("records_in"))
    b = after.agg(F.count(F.lit(1)).alias("records_out"))
    return a.crossJoin(b).select(F.lit(step).alias("transformation"), "records_in", "records_out")  # one row each


def rewrite(df: DataFrame, path: str, partition: str) -> None:
    """Write the given partitions of a stored table anew and leave the others; doing it again changes nothing.

    ``df`` must not read ``path`` itself: write it as a table of its own first.
    """
    df.hint("rebalance", partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def delete_jobs(table: DataFrame, doomed: DataFrame) -> DataFrame:
    """The table without the rows of the given jobs."""
    return table.join(doomed.select("job_id"), "job_id", "left_anti")


def progress(status: Column) -> Column:
    return F.when(status.isin("completed", "failed"), 100).when(status == "processing", 50).otherwise(0)
