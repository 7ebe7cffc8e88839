"""Queries: routing, dimensions, facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators import rules as R
from ..operators import validate as E
from ..operators import warehouse as W
from ..operators.allowed import mark_unknown
from ..operators.batch import run_batch
from ..session import work_path
from ..sources.tables import Tables
from . import fixtures as X
from .catalog import query
from .ctes import NOW, block, with_blocks
from .q_profile import rounded as _rounded
from .q_validate import learned, res


def rounded(df, *names):
    """Nine places: averages over a few jobs often end in a 5 at the seventh, where the order of adding would decide."""
    return _rounded(df, *names, places=9)


# most records of RES score above the default, so the routes are split higher
ROUTE = 0.95


@query(with_blocks(["res"], f"SELECT cust_key, round(quality_score, 9) AS quality_score, CASE WHEN is_valid THEN 'completed' ELSE 'pending' END AS status FROM res WHERE quality_score >= {ROUTE}"))
def route_staging(spark, sf_dir):
    return rounded(W.staging(res(spark, sf_dir), ROUTE).select("cust_key", "quality_score", "status"), "quality_score")


@query(with_blocks(["res"], f"""
    SELECT cust_key, round(1 - quality_score, 9) AS severity_score, 'Quality score ' || printf('%.2f', quality_score) || ' below threshold {ROUTE}' AS quarantine_reason
    FROM res WHERE quality_score < {ROUTE}"""))
def route_quarantine(spark, sf_dir):
    return rounded(W.quarantine(res(spark, sf_dir), ROUTE).select("cust_key", "severity_score", "quarantine_reason"), "severity_score")


block("quarantined", "SELECT *, 1.0 - quality_score AS severity_score FROM results WHERE quality_score < 0.8", ["results"])


def quarantined(spark, sf_dir):
    return W.quarantine(X.results(spark, sf_dir)).withColumn("issue_types", W.issue_types(F.col("issues")))


@query(with_blocks(["quarantined"], """
    SELECT job_id, record_id, split_part(issue, ':', 1) AS issue_type, count(*) AS issue_count
    FROM (SELECT job_id, record_id, unnest(issues) AS issue FROM quarantined) GROUP BY 1, 2, 3"""))
def quarantine_issue_types(spark, sf_dir):
    rows = quarantined(spark, sf_dir).select("job_id", "record_id", F.explode("issue_types").alias("issue_type"))
    return rows.groupBy("job_id", "record_id", "issue_type").agg(F.count(F.lit(1)).alias("issue_count"))


# ---- dimensions ------------------------------------------------------------------------------------
@query(with_blocks(["jobs"], """
    SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_id, CAST(d AS DATE) AS date_value, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter,
           CAST(month(d) AS INTEGER) AS month, CAST(weekofyear(d) AS INTEGER) AS week, CAST(day(d) AS INTEGER) AS day, CAST(isodow(d) AS INTEGER) AS day_of_week,
           dayname(d) AS day_name, monthname(d) AS month_name, isodow(d) >= 6 AS is_weekend, coalesce(n, 0) AS jobs_started
    FROM (SELECT unnest(generate_series(make_date(y, 1, 1) - INTERVAL 730 DAY, make_date(y, 12, 31) + INTERVAL 730 DAY, INTERVAL 1 DAY)) AS d
          FROM (SELECT CAST(year(max(created_at)) AS INTEGER) AS y FROM jobs))
    LEFT JOIN (SELECT start_date_id, count(*) AS n FROM jobs GROUP BY start_date_id) ON start_date_id = CAST(strftime(d, '%Y%m%d') AS INTEGER)"""))
def dim_date(spark, sf_dir):
    """The calendar around the newest job, with the jobs started per day."""
    jobs = X.jobs(spark, sf_dir)
    year = F.year(F.max("created_at"))
    spans = jobs.agg(year.alias("y")).select(
        F.date_add(F.make_date("y", F.lit(1), F.lit(1)), -730).alias("first_day"),
        F.date_add(F.make_date("y", F.lit(12), F.lit(31)), 730).alias("last_day"))
    started = jobs.groupBy(F.col("start_date_id").alias("date_id")).agg(F.count(F.lit(1)).alias("jobs_started"))
    return W.date_dimension(spans).join(started, "date_id", "left").withColumn("jobs_started", F.coalesce("jobs_started", F.lit(0)))


@query(with_blocks(["sources"], """
    SELECT c_custkey AS source_id, c_name AS source_name FROM customer WHERE c_custkey NOT IN (SELECT source_id FROM sources)"""))
def dim_source_upsert(spark, sf_dir):
    """Customers offered as sources; only those not known yet are inserted."""
    offered = X.read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("source_name"))
    return W.new_rows(offered, X.sources(spark, sf_dir), ["source_id"])


@query(with_blocks(["tprof"], """
    SELECT 'customers' AS schema_name, '1' AS schema_version, count(*) AS field_count,
           md5(string_agg(field || ':' || detected_type || ':' || CASE WHEN nullable THEN 'false' ELSE 'true' END, '|' ORDER BY field)) AS schema_hash FROM tprof"""))
def dim_schema(spark, sf_dir):
    rows = P.profile(X.train(spark, sf_dir), X.DIRTY_FIELDS)
    entry = F.concat_ws(":", "field", "detected_type", (~F.col("nullable")).cast("string"))
    return rows.agg(F.count(F.lit(1)).alias("field_count"), F.md5(F.array_join(F.sort_array(F.collect_list(entry)), "|")).alias("schema_hash")).select(
        F.lit("customers").alias("schema_name"), F.lit("1").alias("schema_version"), "field_count", "schema_hash")


# ---- facts -------------------------------------------------------------------------------------------
_JOB_COLUMNS = ["job_id", "job_name", "job_type", "status", "source_id", "start_date_id", "started_at", "total_records",
                "valid_records", "invalid_records", "quarantined_records"]


def _stored(spark, **frames):
    """Tables of jobs in buckets: a job has few rows."""
    tables = Tables(spark, work_path(spark, "warehouse"), buckets={name: 16 for name in frames})
    jobs = frames["jobs"].select("job_id")
    tables.replace(frames, jobs)
    return tables


@query(with_blocks(["jobs"], f"SELECT {', '.join(_JOB_COLUMNS)} FROM jobs"))
def fact_job(spark, sf_dir):
    return X.jobs(spark, sf_dir).select(*_JOB_COLUMNS)


@query(with_blocks(["jobs"], f"""
    SELECT job_id, CASE WHEN u THEN CASE WHEN job_id % 2 = 0 THEN 'completed' ELSE 'failed' END ELSE status END AS status,
           CASE WHEN u THEN TIMESTAMP '{NOW}' ELSE completed_at END AS completed_at,
           CASE WHEN u THEN CASE WHEN job_id % 2 = 0 THEN NULL ELSE 'timed out' END ELSE error_message END AS error_message,
           CASE WHEN u AND job_id % 3 = 0 THEN total_records + 5 ELSE total_records END AS total_records, valid_records
    FROM (SELECT *, status = 'processing' AND job_id % 5 = 0 AS u FROM jobs)"""))
def merge_job_status(spark, sf_dir):
    """Every fifth running job ends; every third of those also reports a new total. Merged twice into the stored table, whose other buckets stay."""
    jobs = X.jobs(spark, sf_dir)
    k = F.col("job_id")
    updates = jobs.filter((F.col("status") == "processing") & (k % 5 == 0)).select(
        "job_id", F.when(k % 2 == 0, "completed").otherwise("failed").alias("status"),
        F.when(k % 2 != 0, "timed out").alias("error_message"),
        F.when(k % 3 == 0, F.col("total_records") + 5).alias("total_records"))
    tables = _stored(spark, jobs=jobs)
    for _ in range(2):
        tables.merge("jobs", updates, lambda rows, new: W.merge_job_status(rows, new, X.now()))
    return tables.read("jobs").select(
        "job_id", "status", "completed_at", "error_message", "total_records", "valid_records")


@query(with_blocks(["res"], """SELECT 'job-1' AS job_id, cust_key AS record_id, is_valid, round(quality_score, 9) AS quality_score, quality_level,
    CAST(issue_count AS INTEGER) AS issue_count, CAST(warning_count AS INTEGER) AS warning_count FROM res"""))
def fact_validation(spark, sf_dir):
    return rounded(W.validation_fact(res(spark, sf_dir), F.lit("job-1"), F.col("cust_key")), "quality_score")


@query(with_blocks(["scored", "dprof"], """
    SELECT p.field, p.detected_type, 'comprehensive' AS metric_type, round(avg(s.field_score), 9) AS metric_value, any_value(p.total_values)::BIGINT AS total_values,
           any_value(p.null_count)::BIGINT AS null_count, any_value(p.unique_values) AS unique_values, round(any_value(p.mean_value), 9) AS mean_value
    FROM scored s JOIN dprof p USING (field_id) GROUP BY p.field, p.detected_type"""))
def fact_quality_metric(spark, sf_dir):
    profiled = P.profile(X.cleaned(spark, sf_dir), X.DIRTY_FIELDS)
    fact = W.quality_metric_fact(res(spark, sf_dir), profiled, X.DIRTY_FIELDS)
    return rounded(fact.select("field", "detected_type", "metric_type", "metric_value", "total_values", "null_count", "unique_values", "mean_value"),
                   "metric_value", "mean_value")


_METRIC_ROWS = " UNION ALL ".join(
    f"""SELECT job_id, created_at, '__job__' AS field_name, '{kind}' AS metric_type, CAST(coalesce({source.replace('success_rate_pct', 'success_rate * 100')}, 0) AS DOUBLE) AS metric_value,
        '{{"display_name":"{name}","category":"job_summary"}}' AS metric_details FROM jobs""" for name, kind, source in W.JOB_METRICS)
block("job_metrics", _METRIC_ROWS, ["jobs"])


@query(with_blocks(["job_metrics"], "SELECT job_id, created_at, field_name, metric_type, round(metric_value, 9) AS metric_value, metric_details FROM job_metrics"))
def job_metrics_long(spark, sf_dir):
    return rounded(W.job_metrics(X.jobs(spark, sf_dir)), "metric_value")


@query(with_blocks(["res"], """
    SELECT count(*) AS total_records, count(*) FILTER (WHERE is_valid) AS valid_records, count(*) FILTER (WHERE NOT is_valid) AS invalid_records,
           count(*) FILTER (WHERE quality_score < 0.6) AS poor_records, count(*) FILTER (WHERE quality_score < 0.8) AS quarantined_records,
           round(avg(quality_score), 9) AS avg_quality_score, round(count(*) FILTER (WHERE is_valid) / count(*), 9) AS success_rate FROM res"""))
def processing_metrics(spark, sf_dir):
    return rounded(W.processing_metrics(res(spark, sf_dir)), "avg_quality_score", "success_rate")


_RULES = {"missing_value": E.NULL_REQUIRED, "invalid_format": E.TYPE, "length_violation": E.SHORT | E.LONG,
          "out_of_range": E.BELOW | E.ABOVE, "inconsistent_pattern": E.PATTERN, "unexpected_category": E.CATEGORY}


@query(with_blocks(["checks"], """
    SELECT field, rule, count(*) AS records_checked, count(*) FILTER (WHERE passed) AS records_passed, count(*) FILTER (WHERE NOT passed) AS records_failed,
           round(count(*) FILTER (WHERE passed) / count(*), 9) AS success_rate FROM (
        SELECT field, 'missing_value' AS rule, NOT (blank AND required) AS passed FROM checks
        UNION ALL SELECT field, 'invalid_format', blank OR NOT type_bad FROM checks
        UNION ALL SELECT field, 'length_violation', blank OR NOT (short_bad OR long_bad) FROM checks
        UNION ALL SELECT field, 'out_of_range', blank OR NOT (below_bad OR above_bad) FROM checks
        UNION ALL SELECT field, 'inconsistent_pattern', blank OR NOT (patterned AND type_bad) FROM checks
        UNION ALL SELECT field, 'unexpected_category', blank OR NOT category_bad FROM checks) GROUP BY field, rule"""))
def rule_summary(spark, sf_dir):
    """Outcome of every rule on every field; counted inside each task before the exchange."""
    rules = learned(spark, sf_dir)
    df, unknown = mark_unknown(X.cleaned(spark, sf_dir), rules)
    bits = df.select(F.inline(F.array(*[
        F.struct(F.lit(r.field).alias("field"), E.check_bits(df, r, unknown.get(r.field)).alias("bits")) for r in rules])))
    return rounded(W.rule_summary(bits, _RULES), "success_rate")


@query(with_blocks(["dirty", "cleaned", "ord"], """SELECT 'clean' AS transformation, (SELECT count(*) FROM dirty) AS records_in, (SELECT count(*) FROM cleaned) AS records_out
    UNION ALL SELECT 'validate', (SELECT count(*) FROM ord), (SELECT count(*) FROM ord WHERE "Freight" >= 0)"""))
def lineage_counts(spark, sf_dir):
    orders = X.ord_records(spark, sf_dir)
    a = W.lineage("clean", X.dirty(spark, sf_dir), X.cleaned(spark, sf_dir))
    return a.unionByName(W.lineage("validate", orders, orders.filter("Freight >= 0")))


@query(with_blocks(["jobs"], " UNION ALL ".join(f"""
    SELECT '{name}' AS period_type, CAST(date_trunc('{unit}', created_at) AS DATE) AS period_start, count(*) AS total_jobs,
           count(*) FILTER (WHERE status = 'completed') AS completed_jobs, count(*) FILTER (WHERE status = 'failed') AS failed_jobs,
           CAST(sum(total_records) AS BIGINT) AS total_records, CAST(sum(valid_records) AS BIGINT) AS valid_records,
           CAST(sum(invalid_records) AS BIGINT) AS invalid_records, round(avg(avg_quality_score), 9) AS avg_quality_score
    FROM jobs GROUP BY 2""" for name, unit in (("daily", "day"), ("weekly", "week"), ("monthly", "month")))))
def period_summary(spark, sf_dir):
    return rounded(W.period_summary(X.jobs(spark, sf_dir)), "avg_quality_score")


@query(with_blocks(["jobs"], "SELECT job_id, status, CAST(created_at AS DATE) AS partition_date FROM jobs WHERE year(created_at) = 1997 AND month(created_at) = 5"))
def partitioned_staging(spark, sf_dir):
    """Jobs stored by month; the read touches one partition. Daily folders would make thousands of small files."""
    path = work_path(spark, "staging")
    jobs = X.jobs(spark, sf_dir).select("job_id", "status", F.col("created_at").cast("date").alias("partition_date"),
                                        F.date_format("created_at", "yyyy-MM").alias("partition_month"))
    # one exchange on the month keeps the number of files down; AQE splits a month that is too big
    jobs.hint("rebalance", "partition_month").write.partitionBy("partition_month").parquet(path)
    return spark.read.parquet(path).filter(F.col("partition_month") == "1997-05").drop("partition_month")


@query(with_blocks(["jobs", "results"], """
    SELECT 'jobs' AS table_name, count(*) AS remaining FROM jobs WHERE NOT (status = 'failed' AND job_id % 2 = 0)
    UNION ALL SELECT 'results', count(*) FROM results WHERE job_id NOT IN (SELECT job_id FROM jobs WHERE status = 'failed' AND job_id % 2 = 0)"""))
def delete_job(spark, sf_dir):
    """Deleted twice from the stored tables, in one commit each."""
    jobs = X.jobs(spark, sf_dir)
    tables = _stored(spark, jobs=jobs, results=X.results(spark, sf_dir))
    doomed = jobs.filter((F.col("status") == "failed") & (F.col("job_id") % 2 == 0))
    for _ in range(2):
        tables.delete(doomed)

    def count(name):
        return tables.read(name).agg(F.count(F.lit(1)).alias("remaining")).select(F.lit(name).alias("table_name"), "remaining")

    return count("jobs").unionByName(count("results"))


@query(with_blocks(["jobs"], "SELECT job_id, CASE WHEN status IN ('completed', 'failed') THEN 100 WHEN status = 'processing' THEN 50 ELSE 0 END AS progress FROM jobs"))
def job_progress(spark, sf_dir):
    return X.jobs(spark, sf_dir).select("job_id", W.progress(F.col("status")).alias("progress"))


@query(with_blocks(["res", "issues"], """
    SELECT 'job-1' AS job_id, count(*) AS total_records, count(*) FILTER (WHERE is_valid) AS valid_records,
           count(*) FILTER (WHERE quality_score >= 0.95) AS staged, count(*) FILTER (WHERE quality_score < 0.95) AS quarantined,
           count(*) AS facts, count(*) FILTER (WHERE is_valid) AS summary_valid, (SELECT count(*) FROM issues) AS issues FROM res"""))
def batch_load(spark, sf_dir):
    """A whole load, run twice: the second run leaves no second copy."""
    out = work_path(spark, "batch")
    rules = R.learn_rules(X.train(spark, sf_dir), X.DIRTY_FIELDS)
    for _ in range(2):
        job = run_batch(X.cleaned(spark, sf_dir), out, "job-1", "cust_key", X.DIRTY_FIELDS, X.now(), rules, ROUTE)
    tables = Tables(spark, out)
    counted = {name: tables.read(folder).agg(F.count(F.lit(1)).alias(name))
               for name, folder in (("staged", "staging"), ("quarantined", "quarantine"), ("facts", "validation"))}
    summary = spark.read.json(f"{out}/reports/job-1/summary").select(F.col("valid_records").alias("summary_valid"))
    issues = spark.read.json(f"{out}/reports/job-1/issues").agg(F.sum("issue_count").alias("issues"))
    rows = job.select("job_id", "total_records", "valid_records")
    for part in (*counted.values(), summary, issues):  # one row each
        rows = rows.crossJoin(part)
    return rows


@query(with_blocks(["res"], """SELECT t.table_name, count(r.cust_key) AS records FROM (VALUES ('staging'), ('quarantine'), ('validation')) t(table_name)
    LEFT JOIN res r ON t.table_name <> 'quarantine' GROUP BY t.table_name"""))
def batch_rerun(spark, sf_dir):
    """A load that quarantines records runs again with a floor that none is under: its old quarantined rows are gone."""
    out = work_path(spark, "rerun")
    rules = R.learn_rules(X.train(spark, sf_dir), X.DIRTY_FIELDS)
    for floor in (ROUTE, 0.0):
        run_batch(X.cleaned(spark, sf_dir), out, "job-1", "cust_key", X.DIRTY_FIELDS, X.now(), rules, floor)
    tables, rows = Tables(spark, out), None
    for name in ("staging", "quarantine", "validation"):
        part = tables.read(name).agg(F.count(F.lit(1)).alias("records")).select(F.lit(name).alias("table_name"), "records")
        rows = part if rows is None else rows.unionByName(part)
    return rows
