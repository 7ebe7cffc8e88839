"""Registered queries against their SQL at the smallest scale; check_queries.py compares all of them."""

import duckdb
import pytest

import __spark_entry__ as entry
import check_queries as check
from assaykit.plans import load_all

NAMES = [
    "detect_types", "infer_schema", "profile_rules", "validate_record", "validation_issues", "ingest_stats", "validate_primary_key",
    "disposition_three_way", "validate_custom_rules", "route_quarantine", "merge_job_status", "rule_summary", "report_recent_jobs",
    "dashboard_summary", "quarantine_listing", "schema_evolution", "query_flexible", "scan_auto", "payload_to_records", "stream_validate",
]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    relation = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in relation.description]
    assert sorted(columns) == sorted(df.columns)
    assert check.rows_of(df.columns, [tuple(r) for r in df.collect()]) == check.rows_of(columns, relation.fetchall())


def test_catalogue():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    own = set(load_all())
    assert own <= set(sql)


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row["total_records"] == 150 and row["valid_records"] + row["invalid_records"] == 150
