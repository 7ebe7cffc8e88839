"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once to warm the JVM and then timed; the result is fully computed and dropped.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from assaykit.plans import load_all
from assaykit.session import build_session, clear_work

HEADLINE = [
    "infer_schema", "infer_schema_orders", "infer_schema_events", "validate_record", "sink_split_outputs", "validate_declared_rules",
    "validate_primary_key", "disposition_three_way", "validate_custom_rules", "validate_foreign_key", "duplicate_records", "detect_types",
    "profile_rules", "ingest_stats", "rule_summary", "fact_quality_metric", "report_recent_jobs", "reports_with_counts",
    "missing_by_job", "dashboard_trend", "processing_timeline", "quality_distribution", "period_summary", "schema_evolution",
    "payload_to_records", "kafka_decode", "stream_validate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.checkpoint.dir": tempfile.mkdtemp(prefix="assaykit-"), "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    catalogue, times = load_all(), {}
    for name in names:
        run = catalogue[name].run
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    clear_work(spark)
    spark.stop()


if __name__ == "__main__":
    main()
