"""Queries: job reports, dashboards, distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import insights as I
from ..operators import reports as G
from ..operators import validate as E
from ..operators import warehouse as W
from . import fixtures as X
from .catalog import query
from .ctes import NOW, block, with_blocks
from .q_profile import rounded as _rounded
from .q_validate import res
from .q_warehouse import quarantined


def rounded(df, *names):
    """Nine places: averages over a few jobs often end in a 5 at the seventh, where the order of adding would decide."""
    return _rounded(df, *names, places=9)


_NOW = f"TIMESTAMP '{NOW}'"
DAYS = 90


def since(column: str, days: int = DAYS) -> str:
    return f"{column} >= {_NOW} - INTERVAL {days} DAY"


def jobs_of(spark, sf_dir):
    return X.jobs(spark, sf_dir), X.sources(spark, sf_dir)


_DETAIL = ["job_id", "job_name", "job_type", "status", "total_records", "valid_records", "invalid_records", "quarantined_records",
           "created_at", "source_name", "source_type", "source_format"]


@query(with_blocks(["jobs", "sources"], f"SELECT {', '.join(_DETAIL)} FROM jobs JOIN sources USING (source_id) WHERE job_id = (SELECT min(job_id) FROM jobs JOIN sources USING (source_id))"))
def report_job_detail(spark, sf_dir):
    jobs, sources = jobs_of(spark, sf_dir)
    first = G.with_source(jobs, sources).agg(F.min("job_id")).first()[0]
    return G.job_detail(jobs, sources, first).select(*_DETAIL)


@query(with_blocks(["jobs", "sources"], f"SELECT {', '.join(_DETAIL)} FROM jobs JOIN sources USING (source_id) ORDER BY created_at DESC, job_id DESC LIMIT 100"))
def report_recent_jobs(spark, sf_dir):
    jobs, sources = jobs_of(spark, sf_dir)
    return G.latest(G.with_source(jobs, sources), "created_at", "job_id", 100).select(*_DETAIL)


# rule results per job: each kind of issue is a rule, checked on every record of the job
block("job_rules", """
    SELECT job_id, rule_name, count(*) AS records_checked, count(*) FILTER (WHERE passed) AS records_passed, count(*) FILTER (WHERE NOT passed) AS records_failed,
           round(count(*) FILTER (WHERE passed) / count(*), 9) AS success_rate, max(validated_at) AS validated_at
    FROM (SELECT job_id, validated_at, 'missing_value' AS rule_name, NOT list_contains(issues, 'missing_value: Freight is empty') AS passed FROM results
          UNION ALL SELECT job_id, validated_at, 'invalid_format', NOT list_contains(issues, 'invalid_format: Returned line') FROM results
          UNION ALL SELECT job_id, validated_at, 'out_of_range', NOT list_contains(issues, 'out_of_range: Tax above limit') FROM results)
    GROUP BY job_id, rule_name""", ["results"])


def job_rules(spark, sf_dir):
    kinds = W.issue_types(F.col("issues"))
    rows = F.array(*[F.struct(F.lit(k).alias("rule_name"), (~F.array_contains(kinds, k)).alias("passed"))
                     for k in ("missing_value", "invalid_format", "out_of_range")])
    return X.results(spark, sf_dir).select("job_id", "validated_at", F.inline(rows)).groupBy("job_id", "rule_name").agg(
        F.count(F.lit(1)).alias("records_checked"), F.count_if("passed").alias("records_passed"), F.count_if(~F.col("passed")).alias("records_failed"),
        F.round(F.count_if("passed") / F.count(F.lit(1)), 9).alias("success_rate"), F.max("validated_at").alias("validated_at"))


@query(with_blocks(["job_rules"], "SELECT * FROM job_rules ORDER BY validated_at DESC, job_id DESC, rule_name LIMIT 1000"))
def report_rule_results(spark, sf_dir):
    return job_rules(spark, sf_dir).orderBy(F.desc("validated_at"), F.desc("job_id"), "rule_name").limit(1000)


@query(with_blocks(["job_metrics"], """
    SELECT job_id, json_extract_string(metric_details, '$.display_name') AS metric_name, field_name, metric_type, round(metric_value, 9) AS metric_value, created_at AS calculated_at
    FROM job_metrics ORDER BY created_at DESC, job_id DESC, metric_type, json_extract_string(metric_details, '$.display_name') LIMIT 1000"""))
def report_metrics(spark, sf_dir):
    named = G.metric_names(W.job_metrics(X.jobs(spark, sf_dir)))
    top = named.orderBy(F.desc("created_at"), F.desc("job_id"), "metric_type", "metric_name").limit(1000)
    return top.select("job_id", "metric_name", "field_name", "metric_type", F.round("metric_value", 9).alias("metric_value"), F.col("created_at").alias("calculated_at"))


@query(with_blocks(["jobs", "sources"], "SELECT job_id, job_name, status, started_at, source_name FROM jobs LEFT JOIN sources USING (source_id) ORDER BY started_at DESC, job_id DESC LIMIT 50"))
def recent_jobs_left(spark, sf_dir):
    jobs, sources = jobs_of(spark, sf_dir)
    # only the kept jobs are joined: the order does not depend on the source
    return G.with_source(G.latest(jobs, "started_at", "job_id", 50), sources, "left").select("job_id", "job_name", "status", "started_at", "source_name")


block("listing", """
    SELECT job_id, job_name AS filename, job_type AS action, status, CASE WHEN status IN ('completed', 'failed') THEN 100 WHEN status = 'processing' THEN 50 ELSE 0 END AS progress,
           'Status: ' || status AS message, CASE WHEN status = 'completed' THEN total_records END AS total_records,
           CASE WHEN status = 'completed' THEN valid_records END AS valid_records, CASE WHEN status = 'completed' THEN invalid_records END AS invalid_records,
           error_message AS error, created_at, coalesce(completed_at, started_at, created_at) AS updated_at
    FROM jobs ORDER BY created_at DESC, job_id DESC LIMIT 100""", ["jobs"])


@query(with_blocks(["listing"], "SELECT * FROM listing"))
def list_jobs(spark, sf_dir):
    return G.job_listing(X.jobs(spark, sf_dir))


@query(with_blocks(["jobs"], "SELECT count(*) AS job_count FROM jobs"))
def job_count(spark, sf_dir):
    return X.jobs(spark, sf_dir).agg(F.count(F.lit(1)).alias("job_count"))


@query(with_blocks(["jobs", "job_metrics", "results"], """
    SELECT job_id, job_name, status, created_at, coalesce(v.n, 0) AS validation_count, coalesce(m.n, 0) AS metrics_count FROM jobs
    LEFT JOIN (SELECT job_id, count(*) AS n FROM results GROUP BY job_id) v USING (job_id) LEFT JOIN (SELECT job_id, count(*) AS n FROM job_metrics GROUP BY job_id) m USING (job_id)"""))
def reports_with_counts(spark, sf_dir):
    jobs = X.jobs(spark, sf_dir)
    return G.jobs_with_counts(jobs, X.results(spark, sf_dir), W.job_metrics(jobs)).select(
        "job_id", "job_name", "status", "created_at", "validation_count", "metrics_count")


@query(with_blocks(["jobs", "job_metrics", "results"], """
    SELECT count(*) AS total_jobs, count(*) FILTER (WHERE status = 'completed') AS completed_jobs, count(*) FILTER (WHERE status = 'failed') AS failed_jobs,
           (SELECT count(*) FROM results) AS total_validations, (SELECT count(*) FROM job_metrics) AS total_metrics FROM jobs"""))
def reports_summary(spark, sf_dir):
    jobs = X.jobs(spark, sf_dir)
    return G.reports_summary(jobs, X.results(spark, sf_dir), W.job_metrics(jobs))


@query(with_blocks(["job_metrics"], f"""
    SELECT CAST(created_at AS DATE) AS date, round(avg(CASE WHEN metric_type = 'percentage' THEN metric_value END), 9) AS avg_percentage,
           round(avg(CASE WHEN metric_type = 'score' THEN metric_value END), 9) AS avg_score, count(*) AS metric_points
    FROM job_metrics WHERE {since('created_at')} AND field_name = '__job__' GROUP BY 1"""))
def daily_metric_avgs(spark, sf_dir):
    return rounded(G.daily_metric_averages(W.job_metrics(X.jobs(spark, sf_dir)), X.now(), DAYS), "avg_percentage", "avg_score")


@query(with_blocks(["jobs"], f"""
    SELECT job_id, job_name, status, total_records, valid_records, invalid_records, quarantined_records,
           round(CASE WHEN total_records > 0 THEN valid_records / total_records * 100 ELSE 0 END, 2) AS success_rate_pct,
           round(CASE WHEN total_records > 0 THEN invalid_records / total_records * 100 ELSE 0 END, 2) AS invalid_pct,
           round(CASE WHEN total_records > 0 THEN quarantined_records / total_records * 100 ELSE 0 END, 2) AS quarantined_pct,
           round(coalesce(avg_quality_score, 0) * 100, 2) AS quality_score_pct, created_at
    FROM jobs WHERE {since('created_at')} ORDER BY created_at DESC, job_id DESC LIMIT 100"""))
def jobs_overview(spark, sf_dir):
    return G.jobs_overview(X.jobs(spark, sf_dir), X.now(), DAYS)


@query(with_blocks(["results"], """
    SELECT job_id, CAST(sum(len(list_filter(issues, lambda i: regexp_matches(split_part(i, ':', 1), '(?i)missing|null|empty')))) AS BIGINT) AS missing_count
    FROM results GROUP BY job_id"""))
def missing_by_job(spark, sf_dir):
    return G.missing_by_job(X.results(spark, sf_dir))


@query(with_blocks(["results"], f"""
    SELECT job_id, round(sum(len(list_filter(issues, lambda i: regexp_matches(split_part(i, ':', 1), '(?i)missing|null|empty')))) / (count(*) * {len(X.DIRTY_FIELDS)}) * 100, 9) AS missing_pct
    FROM results GROUP BY job_id"""))
def missing_pct(spark, sf_dir):
    """The counted share of missing cells; no guess from a job's name."""
    return rounded(G.missing_pct(X.results(spark, sf_dir), len(X.DIRTY_FIELDS)), "missing_pct")


@query(with_blocks(["results", "jobs"], f"""
    SELECT job_id, count(*) AS result_count FROM results WHERE job_id IN (SELECT job_id FROM jobs WHERE {since('created_at')}) GROUP BY job_id"""))
def validations_for_jobs(spark, sf_dir):
    keys = G.recent(X.jobs(spark, sf_dir), "created_at", X.now(), DAYS).select("job_id")
    return X.results(spark, sf_dir).join(keys, "job_id", "left_semi").groupBy("job_id").agg(F.count(F.lit(1)).alias("result_count"))


@query(with_blocks(["jobs"], """
    SELECT count(*) AS total_jobs, count(*) FILTER (WHERE status = 'completed') AS completed_jobs, count(*) FILTER (WHERE status = 'failed') AS failed_jobs,
           count(*) FILTER (WHERE status = 'processing') AS running_jobs, CAST(sum(total_records) FILTER (WHERE status = 'completed') AS BIGINT) AS total_records,
           CAST(sum(valid_records) FILTER (WHERE status = 'completed') AS BIGINT) AS valid_records, CAST(sum(invalid_records) FILTER (WHERE status = 'completed') AS BIGINT) AS invalid_records,
           round(sum(valid_records) FILTER (WHERE status = 'completed') / sum(total_records) FILTER (WHERE status = 'completed') * 100, 2) AS success_rate_pct FROM jobs"""))
def system_statistics(spark, sf_dir):
    return G.system_statistics(X.jobs(spark, sf_dir))


_BY_LEVEL = ", ".join(f"count(*) FILTER (WHERE quality_level = '{n}') AS {n}_count" for n in ("excellent", "good", "fair", "poor"))


@query(with_blocks(["results"], f"""
    SELECT job_id, count(*) AS total_validations, count(*) FILTER (WHERE is_valid) AS valid_count, round(avg(quality_score), 9) AS avg_quality_score, {_BY_LEVEL}
    FROM results GROUP BY job_id"""))
def job_validation_metrics(spark, sf_dir):
    return rounded(G.validation_metrics(X.results(spark, sf_dir)), "avg_quality_score")


@query(with_blocks(["job_metrics"], "SELECT job_id, field_name, metric_type, round(metric_value, 9) AS metric_value FROM job_metrics WHERE job_id = (SELECT max(job_id) FROM jobs)"))
def job_field_metrics(spark, sf_dir):
    jobs = X.jobs(spark, sf_dir)
    last = X.read_table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    rows = W.job_metrics(jobs.filter(F.col("job_id") == last)).orderBy("field_name", "metric_type")
    return rows.select("job_id", "field_name", "metric_type", F.round("metric_value", 9).alias("metric_value"))


@query(with_blocks(["quarantined", "jobs", "sources"], """
    SELECT q.job_id, q.record_id, q.part_key, round(q.severity_score, 9) AS severity_score, q.validated_at, array_to_string(list_transform(q.issues, lambda i: split_part(i, ':', 1)), ',') AS issue_types,
           j.job_name, s.source_name FROM quarantined q LEFT JOIN jobs j USING (job_id) LEFT JOIN sources s USING (source_id)
    ORDER BY q.validated_at DESC, q.job_id DESC, q.record_id DESC, q.part_key DESC, q.severity_score DESC LIMIT 100"""))
def quarantine_listing(spark, sf_dir):
    """The newest items first, then the joins: no item is lost by a left join."""
    top = quarantined(spark, sf_dir).orderBy(*[F.desc(c) for c in ("validated_at", "job_id", "record_id", "part_key", "severity_score")]).limit(100)
    joined = top.join(X.jobs(spark, sf_dir).select("job_id", "job_name", "source_id"), "job_id", "left")
    return joined.join(X.sources(spark, sf_dir).select("source_id", "source_name"), "source_id", "left").select(
        "job_id", "record_id", "part_key", F.round("severity_score", 9).alias("severity_score"), "validated_at",
        F.array_join("issue_types", ",").alias("issue_types"), "job_name", "source_name")


@query(with_blocks(["jobs"], f"""
    SELECT count(*) AS total_jobs, count(*) FILTER (WHERE status = 'completed') AS completed_jobs, count(*) FILTER (WHERE status = 'failed') AS failed_jobs,
           count(*) FILTER (WHERE status = 'processing') AS running_jobs, round(avg(processing_duration_seconds), 9) AS avg_processing_time,
           CAST(sum(total_records) AS BIGINT) AS total_records_processed, round(avg(avg_quality_score), 9) AS overall_avg_quality FROM jobs WHERE {since('started_at')}"""))
def warehouse_job_stats(spark, sf_dir):
    return rounded(G.job_stats(X.jobs(spark, sf_dir), X.now(), DAYS), "avg_processing_time", "overall_avg_quality")


@query(with_blocks(["jobs", "sources"], f"""SELECT source_type, count(job_id) AS job_count, round(avg(success_rate), 9) AS avg_success_rate
    FROM sources LEFT JOIN jobs USING (source_id) WHERE {since('started_at')} GROUP BY source_type"""))
def source_type_stats(spark, sf_dir):
    return rounded(G.source_type_stats(*jobs_of(spark, sf_dir), X.now(), DAYS), "avg_success_rate")


@query(with_blocks(["results", "jobs"], f"SELECT quality_level, count(*) AS count FROM results JOIN jobs USING (job_id) WHERE {since('started_at')} GROUP BY quality_level"))
def quality_distribution(spark, sf_dir):
    return G.quality_distribution(X.results(spark, sf_dir), X.jobs(spark, sf_dir), X.now(), DAYS)


@query(with_blocks(["jobs"], f"SELECT status, count(*) AS count, round(avg(processing_duration_seconds), 9) AS avg_duration FROM jobs WHERE {since('created_at')} GROUP BY status"))
def dashboard_status(spark, sf_dir):
    return rounded(G.dashboard_status(X.jobs(spark, sf_dir), X.now(), DAYS), "avg_duration")


block("trend", f"""
    SELECT CAST(created_at AS DATE) AS date, avg(avg_quality_score) AS completeness, avg(success_rate) AS validity, avg(avg_quality_score) AS consistency,
           CAST(sum(total_records) AS BIGINT) AS records_processed FROM jobs WHERE {since('created_at')} GROUP BY 1""", ["jobs"])


@query(with_blocks(["trend"], "SELECT date, round(completeness, 9) AS completeness, round(validity, 9) AS validity, round(consistency, 9) AS consistency, records_processed FROM trend"))
def dashboard_trend(spark, sf_dir):
    return rounded(G.dashboard_trend(X.jobs(spark, sf_dir), X.now(), DAYS), "completeness", "validity", "consistency")


block("errors", f"""
    SELECT 'Processing Errors' AS error_type, count(*) AS count FROM jobs WHERE status = 'failed' AND {since('created_at')}
    UNION ALL SELECT 'Invalid Records', CAST(sum(invalid_records) AS BIGINT) FROM jobs WHERE {since('created_at')}""", ["jobs"])


@query(with_blocks(["errors"], "SELECT * FROM errors ORDER BY count DESC LIMIT 10"))
def dashboard_errors(spark, sf_dir):
    return G.dashboard_errors(X.jobs(spark, sf_dir), X.now(), DAYS)


@query(with_blocks(["trend", "errors"], f"""
    SELECT (SELECT count(*) FROM jobs WHERE {since('created_at')}) AS total_jobs, CAST((SELECT sum(count) FROM errors) AS BIGINT) AS total_errors,
           round(least(100, greatest(0, sum(coalesce(completeness, 0) + coalesce(validity, 0) + coalesce(consistency, 0)) / (3 * count(*)) * 100)), 9) AS avg_quality_score FROM trend"""))
def dashboard_summary(spark, sf_dir):
    return rounded(G.dashboard_summary(X.jobs(spark, sf_dir), X.now(), DAYS), "avg_quality_score")


@query(with_blocks(["jobs"], f"""
    SELECT date_trunc('hour', created_at) AS timestamp, status, count(*) AS count, round(avg(total_records), 9) AS avg_records, CAST(sum(total_records) AS BIGINT) AS total_records
    FROM jobs WHERE {since('created_at')} GROUP BY 1, 2"""))
def processing_timeline(spark, sf_dir):
    return rounded(G.processing_timeline(X.jobs(spark, sf_dir), X.now(), DAYS), "avg_records")


@query(with_blocks(["jobs", "sources"], f"""
    SELECT source_id, source_name, source_type, count(job_id) AS total_jobs, CAST(sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) AS BIGINT) AS successful_jobs,
           round(avg(total_records), 9) AS avg_records, max(created_at) AS last_processed
    FROM sources LEFT JOIN jobs USING (source_id) WHERE {since('created_at')} GROUP BY 1, 2, 3"""))
def data_source_stats(spark, sf_dir):
    return rounded(G.source_stats(*jobs_of(spark, sf_dir), X.now(), DAYS), "avg_records")


@query(with_blocks(["jobs"], f"""
    SELECT CAST(created_at AS DATE) AS date, 'quality_score' AS metric_name, round(avg(avg_quality_score * 100), 9) AS avg_value, round(min(avg_quality_score * 100), 9) AS min_value,
           round(max(avg_quality_score * 100), 9) AS max_value, count(*) AS sample_count
    FROM jobs WHERE {since('created_at')} AND avg_quality_score IS NOT NULL GROUP BY 1"""))
def daily_quality_metrics(spark, sf_dir):
    return rounded(G.daily_quality(X.jobs(spark, sf_dir), X.now(), DAYS), "avg_value", "min_value", "max_value")


@query(with_blocks(["jobs"], f"""
    SELECT 'Successful Validations' AS validation_rule, CAST(sum(valid_records) AS BIGINT) AS passed, CAST(sum(invalid_records) AS BIGINT) AS failed FROM jobs WHERE {since('created_at')}
    UNION ALL SELECT 'Quality Threshold Met', CAST(sum(CASE WHEN avg_quality_score >= 0.8 THEN total_records ELSE 0 END) AS BIGINT),
           CAST(sum(CASE WHEN avg_quality_score < 0.8 THEN total_records ELSE 0 END) AS BIGINT) FROM jobs WHERE {since('created_at')} AND avg_quality_score IS NOT NULL"""))
def rule_pass_fail(spark, sf_dir):
    return G.rule_pass_fail(X.jobs(spark, sf_dir), X.now(), DAYS)


block("qjobs", """
    SELECT job_id, job_name AS filename, 'Validation failed: ' || invalid_records || ' invalid records' AS reason,
           CASE WHEN invalid_records > total_records * 0.1 THEN 'high' ELSE 'medium' END AS severity, invalid_records AS records, total_records,
           coalesce(completed_at, created_at) AS quarantine_date,
           CAST(greatest(0, 100 - floor(CASE WHEN total_records > 0 THEN valid_records / total_records * 100 ELSE 0 END)) AS INTEGER) AS risk_score
    FROM jobs WHERE status = 'completed' AND invalid_records > 0""", ["jobs"])


@query(with_blocks(["qjobs"], "SELECT * FROM qjobs"))
def quarantined_jobs(spark, sf_dir):
    return G.quarantined_jobs(X.jobs(spark, sf_dir))


@query(with_blocks(["listing"], f"""
    SELECT job_id, filename AS name, CASE status WHEN 'failed' THEN 'error' WHEN 'completed' THEN 'completed' ELSE 'unknown' END AS status,
           CASE WHEN secs // 86400 > 0 THEN (secs // 86400) || ' day' || CASE WHEN secs // 86400 > 1 THEN 's' ELSE '' END || ' ago'
                WHEN secs % 86400 > 3600 THEN (secs % 86400 // 3600) || ' hour' || CASE WHEN secs % 86400 // 3600 > 1 THEN 's' ELSE '' END || ' ago'
                WHEN secs % 86400 > 60 THEN (secs % 86400 // 60) || ' minute' || CASE WHEN secs % 86400 // 60 > 1 THEN 's' ELSE '' END || ' ago' ELSE 'Just now' END AS age,
           action, progress FROM (SELECT *, CAST(date_diff('second', created_at, {_NOW}) AS BIGINT) AS secs FROM listing ORDER BY created_at DESC, job_id DESC LIMIT 20)"""))
def recent_validations(spark, sf_dir):
    rows = G.latest(G.job_listing(X.jobs(spark, sf_dir)), "created_at", "job_id", 20)
    return rows.select("job_id", F.col("filename").alias("name"), G.shown_status(F.col("status")).alias("status"),
                       G.age_text(F.col("created_at"), X.now()).alias("age"), "action", "progress")


@query(with_blocks(["stats"], " UNION ALL ".join(
    f"SELECT '{n}' AS level, {n}_records AS records, round(CASE WHEN valid_records > 0 THEN {n}_records / valid_records * 100 ELSE 0 END, 1) AS share_pct FROM stats"
    for n in ("excellent", "good", "fair", "poor"))))
def level_share(spark, sf_dir):
    return G.level_share(E.ingest_stats(res(spark, sf_dir)))


block("patterns", """SELECT CASE WHEN contains(issue, ':') THEN split_part(issue, ':', 1) ELSE 'general' END AS error_type, count(*) AS count
    FROM (SELECT unnest(issues) AS issue FROM results WHERE NOT is_valid) GROUP BY 1""", ["results"])


@query(with_blocks(["patterns"], "SELECT * FROM patterns ORDER BY count DESC, error_type LIMIT 10"))
def error_patterns_topk(spark, sf_dir):
    return G.error_patterns(X.results(spark, sf_dir))


block("rstats", """SELECT count(*) AS total_records, count(*) FILTER (WHERE is_valid) AS valid_records, count(*) FILTER (WHERE NOT is_valid) AS invalid_records,
    count(*) FILTER (WHERE is_valid AND quality_level = 'excellent') AS excellent, count(*) FILTER (WHERE is_valid AND quality_level = 'good') AS good,
    count(*) FILTER (WHERE is_valid AND quality_level = 'poor') AS poor FROM results""", ["results"])


@query(with_blocks(["rstats", "patterns", "jobs"], """
    SELECT unnest(list_filter([
        CASE WHEN valid_records / total_records >= 0.95 THEN 'Excellent data quality with very high success rate' WHEN valid_records / total_records >= 0.85 THEN 'Good data quality with acceptable success rate'
             WHEN valid_records / total_records >= 0.70 THEN 'Fair data quality - consider data source review' ELSE 'Poor data quality - immediate attention required' END,
        CASE WHEN excellent / valid_records >= 0.8 THEN 'Majority of valid records have excellent quality scores'
             WHEN poor / valid_records >= 0.3 THEN 'High percentage of poor quality records - review data collection processes' END,
        CASE WHEN (excellent + good) / valid_records >= 0.9 THEN 'Strong overall data quality suitable for production use' END,
        CASE WHEN speed >= 1000 THEN 'High processing throughput achieved' WHEN speed < 100 THEN 'Low processing throughput - consider optimization' END,
        'Most common validation issue: ' || error_type,
        CASE WHEN count / invalid_records > 0.5 THEN 'Over 50% of errors are related to ' || error_type || ' - focus on fixing this issue' END], lambda x: x IS NOT NULL)) AS insight
    FROM rstats, (SELECT * FROM patterns ORDER BY count DESC, error_type LIMIT 1), (SELECT sum(total_records) / sum(processing_duration_seconds) AS speed FROM jobs)"""))
def report_insights(spark, sf_dir):
    results = X.results(spark, sf_dir)
    top = G.error_patterns(results, 1).select(F.col("error_type").alias("top_error"), F.col("count").alias("top_error_count"))
    speed = X.jobs(spark, sf_dir).agg((F.sum("total_records") / F.sum("processing_duration_seconds")).alias("throughput_records_per_second"))
    return I.report_insights(E.ingest_stats(results).join(top, how="left").crossJoin(speed)).select("insight")  # one row each


@query(with_blocks(["jobs"], "SELECT created_at AS run_at, job_id, round(success_rate, 9) AS success_rate, total_records FROM jobs"))
def quality_trend(spark, sf_dir):
    """Success and volume, one row per run in the order of time."""
    rows = X.jobs(spark, sf_dir).select(F.col("created_at").alias("run_at"), "job_id", "success_rate", "total_records")
    return rounded(rows, "success_rate").orderBy("run_at", "job_id")


@query(with_blocks(["res"], """SELECT cust_key, CASE WHEN is_valid THEN 'Valid' ELSE 'Invalid' END AS status, round(quality_score, 2) AS quality_score,
    issue_count AS errors, warning_count AS warnings FROM res ORDER BY cust_key LIMIT 10"""))
def validation_preview(spark, sf_dir):
    top = res(spark, sf_dir).orderBy("cust_key").limit(10)
    return top.select("cust_key", F.when(F.col("is_valid"), "Valid").otherwise("Invalid").alias("status"), F.round("quality_score", 2).alias("quality_score"),
                      F.size("issues").cast("long").alias("errors"), F.size("warnings").cast("long").alias("warnings"))


@query(with_blocks(["jobs"], """
    SELECT 'wide' AS grouping, CASE WHEN success_rate * 100 >= 90 THEN '90+' WHEN success_rate * 100 >= 75 THEN '75-90' ELSE '<75' END AS bucket, count(*) AS jobs FROM jobs GROUP BY 2
    UNION ALL SELECT 'fine', CASE WHEN success_rate * 100 >= 100 THEN '100' WHEN success_rate * 100 >= 95 THEN '95-100' WHEN success_rate * 100 >= 90 THEN '90-95' ELSE '<90' END, count(*) FROM jobs GROUP BY 2"""))
def success_buckets(spark, sf_dir):
    return G.success_buckets(X.jobs(spark, sf_dir))


@query(with_blocks(["jobs"], "SELECT round(avg(success_rate) * 100, 9) AS avg_success_pct, CAST(sum(total_records) AS BIGINT) AS total_records FROM jobs"))
def overview_cards(spark, sf_dir):
    return X.jobs(spark, sf_dir).agg(F.round(F.avg("success_rate") * 100, 9).alias("avg_success_pct"), F.sum("total_records").alias("total_records"))


@query(with_blocks(["jobs"], """
    (SELECT 'invalid' AS list, job_id, round(invalid_records, 9) AS measure FROM jobs WHERE invalid_records > 0 ORDER BY invalid_records DESC, job_id LIMIT 5)
    UNION ALL (SELECT 'missing_pct', job_id, round(invalid_records / total_records, 9) FROM jobs WHERE total_records > 0 ORDER BY round(invalid_records / total_records, 9) DESC, job_id LIMIT 10)"""))
def top_problem_jobs(spark, sf_dir):
    jobs = X.jobs(spark, sf_dir)
    share = F.round(F.col("invalid_records") / F.col("total_records"), 9)
    a = jobs.filter("invalid_records > 0").select(F.lit("invalid").alias("list"), "job_id", F.col("invalid_records").cast("double").alias("measure"))
    b = jobs.filter("total_records > 0").select(F.lit("missing_pct").alias("list"), "job_id", share.alias("measure"))
    order = (F.desc("measure"), F.col("job_id"))
    return a.orderBy(*order).limit(5).unionByName(b.orderBy(*order).limit(10))


@query(with_blocks(["qjobs"], """SELECT CASE WHEN risk_score >= 80 THEN 'HIGH' WHEN risk_score >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS band, count(*) AS jobs,
    CAST(sum(records) AS BIGINT) AS records, count(*) FILTER (WHERE risk_score >= 80) AS high_risk FROM qjobs GROUP BY 1"""))
def quarantine_bands(spark, sf_dir):
    return G.quarantine_bands(G.quarantined_jobs(X.jobs(spark, sf_dir)))


@query(with_blocks(["jobs"], """SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed,
    count(*) FILTER (WHERE status = 'processing') AS active, round(avg(success_rate), 9) AS avg_success, CAST(sum(invalid_records) AS BIGINT) AS total_issues FROM jobs"""))
def result_cards(spark, sf_dir):
    return rounded(G.result_cards(X.jobs(spark, sf_dir)), "avg_success")


@query(with_blocks(["jobs"], """SELECT job_type, status, count(*) AS jobs, round(count(*) / sum(count(*)) OVER (PARTITION BY job_type) * 100, 9) AS share_pct FROM jobs GROUP BY job_type, status"""))
def share_of_total(spark, sf_dir):
    counts = X.jobs(spark, sf_dir).groupBy("job_type", "status").agg(F.count(F.lit(1)).alias("jobs"))
    return rounded(G.share_of_total(counts, "jobs", ["job_type"]), "share_pct")


@query(with_blocks(["jobs"], "SELECT job_id, status, total_records, valid_records FROM jobs WHERE job_id = (SELECT max(job_id) FROM jobs)"))
def job_status(spark, sf_dir):
    last = X.read_table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    return X.jobs(spark, sf_dir).filter(F.col("job_id") == last).select("job_id", "status", "total_records", "valid_records")


@query(with_blocks(["jobs"], """SELECT job_id, CASE WHEN success_rate * 100 >= 90 THEN 'success' WHEN success_rate * 100 >= 70 THEN 'warning' ELSE 'error' END AS band,
    round(CASE WHEN processing_duration_seconds > 0 THEN total_records / processing_duration_seconds ELSE 0 END, 9) AS records_per_second FROM jobs"""))
def success_band(spark, sf_dir):
    rps = F.coalesce(F.try_divide(F.col("total_records"), F.col("processing_duration_seconds")), F.lit(0.0))
    return X.jobs(spark, sf_dir).select("job_id", G.success_band(F.col("success_rate") * 100).alias("band"), F.round(rps, 9).alias("records_per_second"))
