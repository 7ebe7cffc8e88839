"""Queries: streams over the events table, run to their end with availableNow."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import rules as R
from ..session import work_path
from ..sources.tables import Tables
from ..sources import messages as M
from ..streaming import pipeline as S
from ..streaming import runs as B
from . import fixtures as X
from .catalog import query
from .ctes import block, with_blocks
from .q_profile import rounded

_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
_RECORD = "event_id long, event_type string, amount string, k string"
_FIELDS = ["event_type", "amount", "k"]

# Messages: the event as JSON; the value turns into a word every 13th, the type is lost every 17th,
# every 9th message is cut off.
_MESSAGE = """CASE WHEN event_id % 9 = 0 THEN concat('{"event_id":', event_id) ELSE
    concat('{"event_id":', event_id, CASE WHEN event_id % 17 = 0 THEN '' ELSE concat(',"event_type":"', event_type, '"') END,
           ',"amount":"', CASE WHEN event_id % 13 = 0 THEN 'n/a' ELSE CAST(CAST(value AS DECIMAL(18,2)) AS STRING) END, '","k":"', event_id % 7, '"}') END"""


def _path(sf_dir):
    """The table as a pattern: a file stream takes a plain path for a folder, a pattern fits a file or a folder."""
    return f"{sf_dir}/{{events.parquet}}"


def _stream(spark, sf_dir):
    return S.read_files(spark, _path(sf_dir), _EVENTS)


def _messages(df):
    return df.select(F.col("event_id").cast("string").alias("key"), F.expr(_MESSAGE).alias("value"))


def _rules(spark, sf_dir):
    """Rules from the sound events, learned once before the stream starts."""
    k = F.col("event_id")
    sound = X.read_table(spark, sf_dir, "events").filter((k % 9 != 0) & (k % 13 != 0) & (k % 17 != 0))
    return R.learn_rules(M.decode(_messages(sound), _RECORD).select(*_FIELDS), _FIELDS)


def _validated(spark, sf_dir, rules):
    return S.validate_stream(_messages(_stream(spark, sf_dir)), _RECORD, rules, ["event_id"])


# every sound amount is a plain number, so it resolves to currency unless some are negative
block("stream_res", """
    SELECT event_id, NOT (event_id % 17 = 0 OR event_id % 13 = 0) AS is_valid,
           ((CASE WHEN event_id % 17 = 0 THEN 0 ELSE 1 END) + (CASE WHEN event_id % 13 = 0 THEN 0.3 ELSE 1 END) + 1.0) / 3 AS quality_score
    FROM events WHERE event_id % 9 <> 0""")


@query(with_blocks(["stream_res"], "SELECT event_id, is_valid, round(CAST(quality_score AS DOUBLE), 6) AS quality_score FROM stream_res"))
def stream_validate(spark, sf_dir):
    out = work_path(spark, "stream")
    S.run_available(_validated(spark, sf_dir, _rules(spark, sf_dir)).select("event_id", "is_valid", "quality_score"), out + "/data", out + "/checkpoint")
    return rounded(spark.read.parquet(out + "/data"), "quality_score")


@query("SELECT event_id FROM events")
def stream_bounded(spark, sf_dir):
    """A bounded run: few files per batch, a limit on the time."""
    out = work_path(spark, "bounded")
    stream = S.read_files(spark, _path(sf_dir), _EVENTS, per_trigger=2)
    S.run_available(stream.select("event_id"), out + "/data", out + "/checkpoint", timeout=300)
    return spark.read.parquet(out + "/data")


@query("""SELECT CAST(event_id AS VARCHAR) AS key, '{"event_id":' || event_id AS value FROM events WHERE event_id % 9 = 0""")
def stream_dead_letter(spark, sf_dir):
    out = work_path(spark, "dead")
    S.run_available(M.dead_letters(_messages(_stream(spark, sf_dir)), _RECORD), out + "/data", out + "/checkpoint")
    return spark.read.parquet(out + "/data")


@query(with_blocks(["stream_res"], "SELECT CASE WHEN NOT is_valid THEN 'bad' WHEN quality_score >= 0.8 THEN 'high_quality' ELSE 'good' END AS disposition, count(*) AS record_count FROM stream_res GROUP BY 1"))
def stream_split(spark, sf_dir):
    out = work_path(spark, "split")
    S.run_batches(_validated(spark, sf_dir, _rules(spark, sf_dir)), out + "/checkpoint", S.split_writer(out + "/data", 0.8))
    return spark.read.parquet(out + "/data").groupBy("disposition").agg(F.count(F.lit(1)).alias("record_count"))


@query(with_blocks(["stream_res"], """SELECT count(*) AS total_processed, count(*) FILTER (WHERE is_valid) AS valid_records, count(*) FILTER (WHERE NOT is_valid) AS invalid_records,
    round(count(*) FILTER (WHERE is_valid) / count(*) * 100, 6) AS success_rate_pct FROM stream_res"""))
def stream_stats(spark, sf_dir):
    """The running counters as of the last batch."""
    out = work_path(spark, "stats")
    stats = S.running_stats(_validated(spark, sf_dir, _rules(spark, sf_dir)))

    def latest(batch, number):
        batch.write.mode("overwrite").parquet(out + "/data")

    query_ = (stats.writeStream.outputMode("complete").option("checkpointLocation", out + "/checkpoint")
              .foreachBatch(latest).trigger(availableNow=True).start())
    S.finish(query_)
    return rounded(spark.read.parquet(out + "/data"), "success_rate_pct")


@query(with_blocks(["stream_res"], "SELECT is_valid, count(*) AS record_count FROM stream_res GROUP BY is_valid"))
def stream_learn_apply(spark, sf_dir):
    """Learn on a bounded read, apply to the stream; learning again is a step of its own."""
    out = work_path(spark, "learn")
    rules = _rules(spark, sf_dir)
    S.run_available(_validated(spark, sf_dir, rules).select("event_id", "is_valid"), out + "/data", out + "/checkpoint")
    return spark.read.parquet(out + "/data").groupBy("is_valid").agg(F.count(F.lit(1)).alias("record_count"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS count FROM events GROUP BY 1, 2")
def stream_hourly_timeline(spark, sf_dir):
    """Hours as the live view shows them: every batch updates the hours it touched, the last update counts."""
    out = work_path(spark, "hourly")
    # three files, the newest first: a replay has no watermark that could drop the older ones
    source = work_path(spark, "reversed")
    third = F.ntile(3).over(Window.orderBy(F.col("hour").desc()))
    hours = X.read_table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").alias("hour")).distinct().withColumn("file", third)
    events = X.read_table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts")).join(hours, "hour").drop("hour")
    for part in (1, 2, 3):
        events.filter(F.col("file") == part).drop("file").write.mode("append").parquet(source)
    stream = S.read_files(spark, source, _EVENTS, per_trigger=8)
    rows = S.hourly(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"])

    def keep(batch, number):
        batch.withColumn("batch_no", F.lit(number)).write.mode("overwrite").parquet(f"{out}/data/batch={number}")

    query_ = (rows.writeStream.outputMode("update").option("checkpointLocation", out + "/checkpoint")
              .foreachBatch(keep).trigger(availableNow=True).start())
    S.finish(query_)
    updates = spark.read.parquet(out + "/data").groupBy("hour", "event_type").agg(F.max_by("count", "batch_no").alias("count"))
    return updates.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "count")


@query(with_blocks(["stream_res"], """
    SELECT (SELECT count(*) FROM stream_res) AS fact_rows, count(*) AS total_records, count(*) FILTER (WHERE is_valid) AS valid_records, count(*) FILTER (WHERE NOT is_valid) AS invalid_records,
           count(*) FILTER (WHERE quality_score < 0.8) AS quarantined_records FROM stream_res"""))
def stream_etl_facts(spark, sf_dir):
    """Facts of every batch, summed over the run."""
    out = work_path(spark, "facts")
    validated = _validated(spark, sf_dir, _rules(spark, sf_dir)).withColumn("record_key", F.col("event_id"))
    S.run_batches(validated, out + "/checkpoint", S.fact_writer(out + "/data", "events"))
    facts = spark.read.parquet(out + "/data/results").agg(F.count(F.lit(1)).alias("fact_rows"))
    names = ["total_records", "valid_records", "invalid_records", "quarantined_records"]
    runs = spark.read.parquet(out + "/data/jobs").agg(*[F.sum(c).alias(c) for c in names])
    return facts.crossJoin(runs)  # one row each


# ---- runs into stored tables -----------------------------------------------------------------------
def _in_files(spark, sf_dir, files):
    """The events as a folder of a stated number of files, cut by id."""
    path = work_path(spark, "files")
    X.read_table(spark, sf_dir, "events").repartitionByRange(files, "event_id").write.parquet(path)
    return path


@query("SELECT count(*) AS records, count(DISTINCT event_id) AS events, CAST(sum(event_id) AS BIGINT) AS id_sum, 'records' AS first_end, true AS first_stopped_early, 'idle' AS second_end FROM events")
def stream_bounded_records(spark, sf_dir):
    """A run that ends with the batch that brings it to a third of the records, and one that goes on until nothing more comes."""
    out = work_path(spark, "bounded-records")
    tables = Tables(spark, out + "/tables", key=B.SLICE)
    stream = S.read_files(spark, _in_files(spark, sf_dir, 6), _EVENTS, per_trigger=1)
    write = B.batch_writer(tables, lambda batch: {"events": batch.select("event_id", "event_type")})
    total = X.read_table(spark, sf_dir, "events").count()
    first = B.run_bounded(stream, out + "/checkpoint", write, records=max(total // 3, 1))
    early = tables.read(B.BATCHES).agg(F.sum("records")).first()[0]
    second = B.run_bounded(stream, out + "/checkpoint", write, empty_polls=2)
    ends = [F.lit(first).alias("first_end"), F.lit(total // 3 <= early < total).alias("first_stopped_early"), F.lit(second).alias("second_end")]
    return tables.read("events").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("event_id").alias("events"), F.sum("event_id").alias("id_sum")).select("*", *ends)


class _DiesOnce(Tables):
    """Tables whose third commit fails when everything is written."""

    commits = 0

    def commit(self, changes, schemas, based_on=None):
        self.commits += 1
        if self.commits == 3:
            raise OSError("the driver dies before the commit")
        return super().commit(changes, schemas, based_on)


@query(with_blocks(["stream_res"], """SELECT event_id, is_valid, round(CAST(quality_score AS DOUBLE), 6) AS quality_score,
    (SELECT count(*) FROM stream_res) AS total_records, (SELECT count(*) FILTER (WHERE is_valid) FROM stream_res) AS valid_records FROM stream_res"""))
def stream_restart(spark, sf_dir):
    """Six batches, killed between write and commit of the third and started again: the facts of a run that nothing disturbed."""
    out = work_path(spark, "restart")
    tables = _DiesOnce(spark, out + "/tables", key=B.SLICE)
    files, rules = _in_files(spark, sf_dir, 6), _rules(spark, sf_dir)
    validated = S.validate_stream(_messages(S.read_files(spark, files, _EVENTS, per_trigger=1)), _RECORD, rules, ["event_id"])
    write = B.batch_writer(tables, lambda batch: {
        "facts": batch.select("event_id", "is_valid", "quality_score"),
        "counts": batch.agg(F.count(F.lit(1)).alias("total_records"), F.count_if("is_valid").alias("valid_records"))})
    try:
        B.run_bounded(validated, out + "/checkpoint", write)
        raise AssertionError("the stream should have died")
    except StreamingQueryException:
        pass
    B.run_bounded(validated, out + "/checkpoint", write)
    counts = tables.read("counts").agg(F.sum("total_records").alias("total_records"), F.sum("valid_records").alias("valid_records"))
    return rounded(tables.read("facts").drop(B.SLICE), "quality_score").crossJoin(counts)  # one row


@query("""
    WITH thirds AS (SELECT hour, ntile(3) OVER (ORDER BY hour DESC) AS file FROM (SELECT DISTINCT date_trunc('hour', ts) AS hour FROM events)),
    latest AS (SELECT max(ts) AS ts FROM events)
    SELECT date_trunc('hour', e.ts) AS hour, event_type, count(*) AS count,
           count(*) FILTER (WHERE file > 1 AND date_trunc('hour', e.ts) + INTERVAL 1 HOUR <= l.ts - INTERVAL 2 HOUR) AS late
    FROM events e JOIN thirds t ON t.hour = date_trunc('hour', e.ts) CROSS JOIN latest l GROUP BY 1, 2""")
def stream_hourly_late(spark, sf_dir):
    """A replay in three runs, the newest third first: hours that had closed are counted in full, and their late rows told."""
    out = work_path(spark, "late")
    source, tables = out + "/in", Tables(spark, out + "/tables", key=B.SLICE)
    events = X.read_table(spark, sf_dir, "events")
    third = F.ntile(3).over(Window.orderBy(F.col("hour").desc()))  # over the hours, not the rows
    hours = events.select(F.date_trunc("hour", "ts").alias("hour")).distinct().withColumn("file", third)
    filed = events.withColumn("hour", F.date_trunc("hour", "ts")).join(hours, "hour").drop("hour")
    for part in (1, 2, 3):
        filed.filter(F.col("file") == part).drop("file").write.mode("append").parquet(source)
        stream = S.read_files(spark, source, _EVENTS, per_trigger=1_000_000)
        B.run_bounded(stream, out + "/checkpoint", B.hour_writer(tables, "ts", ["event_type"], "2 hours"))
    late = B.late_by_hour(tables, "ts", ["event_type"])
    rows = tables.read("hours").drop(B.SLICE).join(late, ["hour", "event_type"], "left")
    return rows.withColumn("late", F.coalesce("late", F.lit(0).cast("long")))
