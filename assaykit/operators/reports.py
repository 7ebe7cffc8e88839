"""Report queries over the job tables. ``now`` is always a parameter.

Every "latest n" is ``orderBy(...).limit(n)``, which Spark runs as a top-k per task followed by a
merge of n rows each. Ties are broken by the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .warehouse import progress


def count() -> Column:
    return F.count(F.lit(1))


def count_where(cond: Column) -> Column:
    return F.count_if(cond)


def recent(df: DataFrame, column: str, now: Column, days: int) -> DataFrame:
    """Rows of the last ``days`` days."""
    return df.filter(F.col(column) >= now - F.expr(f"INTERVAL {int(days)} DAYS"))


def latest(df: DataFrame, column: str, key: str, n: int) -> DataFrame:
    return df.orderBy(F.col(column).desc(), F.col(key).desc()).limit(n)


# ---- job listings --------------------------------------------------------------------------------
JOB_COLUMNS = ["job_id", "job_name", "job_type", "status", "total_records", "valid_records", "invalid_records",
               "quarantined_records", "avg_quality_score", "success_rate", "created_at"]


def with_source(jobs: DataFrame, sources: DataFrame, how: str = "inner") -> DataFrame:
    return jobs.join(sources, "source_id", how)


def job_detail(jobs: DataFrame, sources: DataFrame, job_id: int) -> DataFrame:
    return with_source(jobs.filter(F.col("job_id") == job_id), sources)


def job_listing(jobs: DataFrame, n: int = 100) -> DataFrame:
    """Newest jobs; the counters only for completed ones."""
    done = F.col("status") == "completed"
    return latest(jobs, "created_at", "job_id", n).select(
        "job_id", F.col("job_name").alias("filename"), F.col("job_type").alias("action"), "status",
        progress(F.col("status")).alias("progress"), F.concat(F.lit("Status: "), "status").alias("message"),
        *[F.when(done, F.coalesce(c, F.lit(0))).alias(c) for c in ("total_records", "valid_records", "invalid_records")],
        F.col("error_message").alias("error"), "created_at", F.coalesce("completed_at", "started_at", "created_at").alias("updated_at"))


def jobs_with_counts(jobs: DataFrame, results: DataFrame, metrics: DataFrame) -> DataFrame:
    """Jobs with their numbers of results and metrics; both are counted before the join."""
    a = results.groupBy("job_id").agg(count().alias("validation_count"))
    b = metrics.groupBy("job_id").agg(count().alias("metrics_count"))
    joined = jobs.join(a, "job_id", "left").join(b, "job_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("validation_count", "metrics_count")})


def reports_summary(jobs: DataFrame, results: DataFrame, metrics: DataFrame) -> DataFrame:
    status = F.col("status")
    a = jobs.agg(count().alias("total_jobs"), count_where(status == "completed").alias("completed_jobs"),
                 count_where(status == "failed").alias("failed_jobs"))
    b = results.agg(count().alias("total_validations"))
    c = metrics.agg(count().alias("total_metrics"))
    return a.crossJoin(b).crossJoin(c)  # three frames of one row


def metric_names(metrics: DataFrame) -> DataFrame:
    """Display name from the details, else the field, else the type."""
    return metrics.withColumn("metric_name", F.coalesce(
        F.get_json_object("metric_details", "$.display_name"), "field_name", "metric_type"))


def pct(part: str, whole: str, places: int = 2) -> Column:
    """Percentage with a zero guard."""
    share = F.when(F.col(whole) > 0, F.col(part) / F.col(whole) * 100).otherwise(0.0)
    return F.round(share, places)


def jobs_overview(jobs: DataFrame, now: Column, days: int = 30, n: int = 100) -> DataFrame:
    return latest(recent(jobs, "created_at", now, days), "created_at", "job_id", n).select(
        "job_id", "job_name", "status", "total_records", "valid_records", "invalid_records", "quarantined_records",
        pct("valid_records", "total_records").alias("success_rate_pct"), pct("invalid_records", "total_records").alias("invalid_pct"),
        pct("quarantined_records", "total_records").alias("quarantined_pct"),
        F.round(F.coalesce("avg_quality_score", F.lit(0.0)) * 100, 2).alias("quality_score_pct"), "created_at")


MISSING_ISSUE = "(?i)missing|null|empty"


def missing_by_job(results: DataFrame) -> DataFrame:
    """Issues about missing, null or empty values per job; a job without issues has none of them."""
    hits = F.filter("issues", lambda i: F.split_part(i, F.lit(":"), F.lit(1)).rlike(MISSING_ISSUE))
    return results.groupBy("job_id").agg(F.sum(F.coalesce(F.size(hits), F.lit(0)).cast("long")).alias("missing_count"))


def missing_pct(results: DataFrame, fields: int) -> DataFrame:
    """Missing values per job in percent of its cells, of records with ``fields`` fields each."""
    counted = results.groupBy("job_id").agg(count().alias("records")).join(missing_by_job(results), "job_id")
    return counted.select("job_id", (F.col("missing_count") / (F.col("records") * fields) * 100).alias("missing_pct"))


def quarantined_jobs(jobs: DataFrame) -> DataFrame:
    invalid, total = F.col("invalid_records"), F.col("total_records")
    rate = F.when(total > 0, F.col("valid_records") / total * 100).otherwise(0.0)
    return jobs.filter((F.col("status") == "completed") & (invalid > 0)).select(
        "job_id", F.col("job_name").alias("filename"),
        F.concat(F.lit("Validation failed: "), invalid.cast("string"), F.lit(" invalid records")).alias("reason"),
        F.when(invalid > total * 0.1, "high").otherwise("medium").alias("severity"), invalid.alias("records"), total.alias("total_records"),
        F.coalesce("completed_at", "created_at").alias("quarantine_date"),
        F.greatest(F.lit(0), 100 - F.floor(rate).cast("int")).alias("risk_score"))


def shown_status(status: Column) -> Column:
    low = F.lower(status)
    return F.when(low == "failed", "error").when(low.isin("completed", "running", "pending"), low).otherwise("unknown")


def age_text(stamp: Column, now: Column) -> Column:
    """Age in the largest whole unit."""
    seconds = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(stamp.cast("timestamp"))
    days, rest = F.floor(seconds / 86400), F.pmod(seconds, F.lit(86400))
    hours, minutes = F.floor(rest / 3600), F.floor(rest / 60)

    def words(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n > 1, "s").otherwise(""), F.lit(" ago"))

    return (F.when(stamp.isNull(), "Unknown time").when(days > 0, words(days, "day")).when(rest > 3600, words(hours, "hour"))
            .when(rest > 60, words(minutes, "minute")).otherwise("Just now"))


# ---- aggregates ------------------------------------------------------------------------------------
def daily_metric_averages(metrics: DataFrame, now: Column, days: int) -> DataFrame:
    def avg_of(kind: str) -> Column:
        return F.avg(F.when(F.col("metric_type") == kind, F.col("metric_value")))

    rows = recent(metrics, "created_at", now, days).filter(F.col("field_name") == "__job__")
    return rows.groupBy(F.to_date("created_at").alias("date")).agg(
        avg_of("percentage").alias("avg_percentage"), avg_of("score").alias("avg_score"), count().alias("metric_points"))


def system_statistics(jobs: DataFrame) -> DataFrame:
    status, done = F.col("status"), F.col("status") == "completed"

    def total(c: str) -> Column:
        return F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0))

    return jobs.agg(
        count().alias("total_jobs"), count_where(done).alias("completed_jobs"), count_where(status == "failed").alias("failed_jobs"),
        count_where(status == "processing").alias("running_jobs"), total("total_records").alias("total_records"),
        total("valid_records").alias("valid_records"), total("invalid_records").alias("invalid_records"),
    ).withColumn("success_rate_pct", pct("valid_records", "total_records"))


def validation_metrics(results: DataFrame) -> DataFrame:
    level = F.col("quality_level")
    return results.groupBy("job_id").agg(
        count().alias("total_validations"), count_where(F.col("is_valid")).alias("valid_count"), F.avg("quality_score").alias("avg_quality_score"),
        *[count_where(level == n).alias(f"{n}_count") for n in ("excellent", "good", "fair", "poor")])


def job_stats(jobs: DataFrame, now: Column, days: int = 30) -> DataFrame:
    status = F.col("status")
    return recent(jobs, "started_at", now, days).agg(
        count().alias("total_jobs"), count_where(status == "completed").alias("completed_jobs"), count_where(status == "failed").alias("failed_jobs"),
        count_where(status == "processing").alias("running_jobs"), F.avg("processing_duration_seconds").alias("avg_processing_time"),
        F.sum("total_records").alias("total_records_processed"), F.avg("avg_quality_score").alias("overall_avg_quality"))


def source_type_stats(jobs: DataFrame, sources: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """The time condition on jobs makes the join an inner one."""
    return with_source(recent(jobs, "started_at", now, days), sources).groupBy("source_type").agg(
        count().alias("job_count"), F.avg("success_rate").alias("avg_success_rate"))


def source_stats(jobs: DataFrame, sources: DataFrame, now: Column, days: int = 30) -> DataFrame:
    return with_source(recent(jobs, "created_at", now, days), sources).groupBy("source_id", "source_name", "source_type").agg(
        count().alias("total_jobs"), F.sum(F.when(F.col("status") == "completed", 1).otherwise(0)).alias("successful_jobs"),
        F.avg("total_records").alias("avg_records"), F.max("created_at").alias("last_processed"))


def quality_distribution(results: DataFrame, jobs: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Results of recent jobs per level. The semi join comes first: results of older jobs are never aggregated."""
    keys = recent(jobs, "started_at", now, days).select("job_id")
    return results.join(keys, "job_id", "left_semi").groupBy("quality_level").agg(count().alias("count"))


def dashboard_status(jobs: DataFrame, now: Column, days: int = 30) -> DataFrame:
    return recent(jobs, "created_at", now, days).groupBy("status").agg(
        count().alias("count"), F.avg("processing_duration_seconds").alias("avg_duration"))


def dashboard_trend(jobs: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Completeness and consistency are both the mean quality score, as the dashboard shows them."""
    return recent(jobs, "created_at", now, days).groupBy(F.to_date("created_at").alias("date")).agg(
        F.avg("avg_quality_score").alias("completeness"), F.avg("success_rate").alias("validity"),
        F.avg("avg_quality_score").alias("consistency"), F.sum("total_records").alias("records_processed"))


def dashboard_errors(jobs: DataFrame, now: Column, days: int = 30, n: int = 10) -> DataFrame:
    rows = recent(jobs, "created_at", now, days)
    a = rows.filter(F.col("status") == "failed").agg(count().alias("count")).select(F.lit("Processing Errors").alias("error_type"), "count")
    b = rows.agg(F.sum("invalid_records").alias("count")).select(F.lit("Invalid Records").alias("error_type"), "count")
    return a.unionByName(b).orderBy(F.col("count").desc(), "error_type").limit(n)


def dashboard_summary(jobs: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Totals and the clamped mean of the three daily rates, from one pass: rows per day, then one row."""
    daily = recent(jobs, "created_at", now, days).groupBy(F.to_date("created_at").alias("date")).agg(
        count().alias("jobs"), F.avg("avg_quality_score").alias("completeness"), F.avg("success_rate").alias("validity"),
        count_where(F.col("status") == "failed").alias("failed"), F.coalesce(F.sum("invalid_records"), F.lit(0)).alias("invalid"))
    rates = sum((F.coalesce(c, F.lit(0.0)) for c in ("completeness", "validity", "completeness")), F.lit(0.0))
    score = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(F.avg(rates / 3) * 100, F.lit(0.0))))
    return daily.agg(F.coalesce(F.sum("jobs"), F.lit(0)).alias("total_jobs"), score.alias("avg_quality_score"),
                     F.coalesce(F.sum(F.col("failed") + F.col("invalid")), F.lit(0)).alias("total_errors"))


def processing_timeline(jobs: DataFrame, now: Column, days: int = 7) -> DataFrame:
    hour = F.date_trunc("hour", "created_at").cast("timestamp_ntz")
    return recent(jobs, "created_at", now, days).groupBy(hour.alias("timestamp"), "status").agg(
        count().alias("count"), F.avg("total_records").alias("avg_records"), F.sum("total_records").alias("total_records"))


def daily_quality(jobs: DataFrame, now: Column, days: int = 30) -> DataFrame:
    score = F.col("avg_quality_score") * 100
    rows = recent(jobs, "created_at", now, days).filter(F.col("avg_quality_score").isNotNull())
    return rows.groupBy(F.to_date("created_at").alias("date")).agg(
        F.avg(score).alias("avg_value"), F.min(score).alias("min_value"), F.max(score).alias("max_value"), count().alias("sample_count"),
    ).withColumn("metric_name", F.lit("quality_score"))


def rule_pass_fail(jobs: DataFrame, now: Column, days: int = 30, floor: float = 0.8) -> DataFrame:
    rows, met = recent(jobs, "created_at", now, days), F.col("avg_quality_score") >= floor
    a = rows.agg(F.sum("valid_records").alias("passed"), F.sum("invalid_records").alias("failed"))
    b = rows.filter(F.col("avg_quality_score").isNotNull()).agg(
        F.sum(F.when(met, F.col("total_records")).otherwise(0)).alias("passed"),
        F.sum(F.when(met, 0).otherwise(F.col("total_records"))).alias("failed"))
    return a.withColumn("validation_rule", F.lit("Successful Validations")).unionByName(
        b.withColumn("validation_rule", F.lit("Quality Threshold Met")))


def level_share(stats: DataFrame) -> DataFrame:
    """Share of the valid records per level, from one row of ingest stats."""
    names = ["excellent", "good", "fair", "poor"]
    rows = F.array(*[F.struct(F.lit(n).alias("level"), F.col(f"{n}_records").alias("records")) for n in names])
    return stats.select(F.inline(rows), "valid_records").select(
        "level", "records", F.round(F.when(F.col("valid_records") > 0, F.col("records") / F.col("valid_records") * 100).otherwise(0.0), 1).alias("share_pct"))


def error_patterns(results: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent text before the colon over the issues of invalid records."""
    issue = F.col("issue")
    kind = F.when(issue.contains(":"), F.split_part(issue, F.lit(":"), F.lit(1))).otherwise("general")
    rows = results.filter(~F.col("is_valid")).select(F.explode("issues").alias("issue"))
    return rows.groupBy(kind.alias("error_type")).agg(count().alias("count")).orderBy(F.col("count").desc(), "error_type").limit(n)


def success_buckets(jobs: DataFrame) -> DataFrame:
    """Jobs per success bucket, in the two groupings of the report page."""
    rate = F.col("success_rate") * 100
    wide = F.when(rate >= 90, "90+").when(rate >= 75, "75-90").otherwise("<75")
    fine = F.when(rate >= 100, "100").when(rate >= 95, "95-100").when(rate >= 90, "90-95").otherwise("<90")
    rows = F.array(F.struct(F.lit("wide").alias("grouping"), wide.alias("bucket")), F.struct(F.lit("fine").alias("grouping"), fine.alias("bucket")))
    return jobs.select(F.inline(rows)).groupBy("grouping", "bucket").agg(count().alias("jobs"))


def quarantine_bands(items: DataFrame) -> DataFrame:
    """Risk bands of quarantined jobs."""
    risk = F.col("risk_score")
    band = F.when(risk >= 80, "HIGH").when(risk >= 50, "MEDIUM").otherwise("LOW")
    return items.groupBy(band.alias("band")).agg(
        count().alias("jobs"), F.sum("records").alias("records"), count_where(risk >= 80).alias("high_risk"))


def result_cards(jobs: DataFrame) -> DataFrame:
    status = F.col("status")
    return jobs.agg(
        count().alias("total"), count_where(status == "completed").alias("completed"), count_where(status == "failed").alias("failed"),
        count_where(status.isin("running", "pending", "processing")).alias("active"), F.avg("success_rate").alias("avg_success"),
        F.sum("invalid_records").alias("total_issues"))


def share_of_total(df: DataFrame, value: str, groups: list[str] | None = None) -> DataFrame:
    """Share of each row in the total of its group, or of all rows."""
    if not groups:  # a total of one row: no task sees all rows
        joined = df.crossJoin(df.agg(F.sum(value).alias("__total")))
        return joined.withColumn("share_pct", F.when(F.col("__total") > 0, F.col(value) / F.col("__total") * 100).otherwise(0.0)).drop("__total")
    total = F.sum(value).over(Window.partitionBy(*groups))
    return df.withColumn("share_pct", F.when(total > 0, F.col(value) / total * 100).otherwise(0.0))


def success_band(rate_pct: Column) -> Column:
    return F.when(rate_pct >= 90, "success").when(rate_pct >= 70, "warning").otherwise("error")
