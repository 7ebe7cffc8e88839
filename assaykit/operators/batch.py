"""A batch load from records to tables: learn, validate, route, facts, reports, job status.

All tables of a job are committed together: a run that dies leaves nothing that a reader sees, and a
job that runs again replaces all its rows, those of outputs that have become empty included. Results
are validated once, written, and read back for everything that follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..sources.sinks import save
from ..sources.tables import Tables
from . import validate as E
from . import warehouse as W
from .profile import field_metrics
from .rules import FieldRule, learn_rules

#: failing records that a report shows
SHOWN = 50


def run_batch(records: DataFrame, out: str, job_id: str, key: str, columns: list[str], now: Column, rules: list[FieldRule] | None = None,
              floor: float = V.ROUTE_SCORE, report_format: str = "json") -> DataFrame:
    """Load ``records`` under ``out`` and return the job's row of the table jobs.

    Writes results, staging, quarantine, validation, quality_metrics and jobs as ``Tables`` under
    ``out``, in one commit, and then under ``reports/<job>`` a summary (one row), the failing records
    shown and the issues by type, in the asked format. Rules are learned from the records unless given.
    """
    spark, job, tables = records.sparkSession, F.lit(job_id), Tables(records.sparkSession, out)
    version = tables.version()
    rules = rules or learn_rules(records, columns)
    staged = {"results": tables.stage("results", E.validate(records, rules, [key]).withColumn("job_id", job))}
    results = tables.staged_rows(*staged["results"])
    outputs = {
        "staging": W.staging(results, floor),
        "quarantine": W.quarantine(results, floor).withColumn("issue_types", W.issue_types(F.transform("issues", lambda i: F.concat_ws(":", i["issue_type"], i["field"])))),
        "validation": W.validation_fact(results, job, F.col(key)),
        "quality_metrics": field_metrics(records, columns).withColumn("job_id", job),
        "jobs": W.processing_metrics(results).withColumns({"job_id": job, "status": F.lit("completed"), "completed_at": now})}
    staged |= {name: tables.stage(name, rows) for name, rows in outputs.items()}
    part = f"={job_id}"
    tables.commit({(name, part): folders.get(part) for name, (folders, _) in staged.items()}, {name: schema for name, (_, schema) in staged.items()}, version)
    folder = f"{out}/reports/{job_id}"
    save(E.ingest_stats(results), f"{folder}/summary", report_format)
    save(E.first_failures(results, [key], SHOWN), f"{folder}/failures", report_format)
    save(E.issues_by_type(results), f"{folder}/issues", report_format)
    return tables.read("jobs", [job_id])
