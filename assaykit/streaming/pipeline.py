"""Streams: decode, validate, split and count with Structured Streaming.

Rules are learned beforehand on a bounded read, so validation is stateless and a restart or a lost
executor only repeats the batch in hand. Offsets and batch numbers live in the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.rules import FieldRule
from ..operators.validate import validate
from ..operators.warehouse import processing_metrics, ratio, validation_fact
from ..sources import messages as M
from ..sources.sinks import disposition


#: files of a micro-batch unless the caller says otherwise
FILES_PER_TRIGGER = 1000


def read_files(spark: SparkSession, path: str, schema: str | T.StructType, fmt: str = "parquet", per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """Stream of the files under a path, a bounded number of them in each micro-batch."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)


def validate_stream(messages: DataFrame, schema: str | T.StructType, rules: list[FieldRule], keys: list[str]) -> DataFrame:
    """Decoded and validated records of a message stream."""
    return validate(M.decode(messages, schema), rules, keys)


def run_available(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", timeout: int | None = None) -> None:
    """Process what is there and stop; the file sink commits each batch once."""
    query = df.writeStream.format(fmt).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
    finish(query, timeout)


def finish(query: StreamingQuery, timeout: int | None = None) -> None:
    """Wait for the end. A query over its time is stopped and raises: what it has written is a part, which the
    next run completes from the checkpoint."""
    done = query.awaitTermination(timeout) if timeout else (query.awaitTermination() or True)
    if not done:
        query.stop()
        raise TimeoutError(f"the stream was not done after {timeout} s; run it again to go on from its checkpoint")


def run_batches(df: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    """Hand each micro-batch to ``write``, which has to be idempotent in the batch number."""
    query = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    finish(query)


def split_writer(path: str, floor: float) -> Callable[[DataFrame, int], None]:
    """Writes a validated batch to one folder per disposition.

    A batch has its own folder and replaces it when it runs again, so a repeated batch leaves no
    second copy.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("disposition", disposition(floor)).write.mode("overwrite").partitionBy("disposition").parquet(
            f"{path}/batch={number}")

    return write


def fact_writer(path: str, job_name: str) -> Callable[[DataFrame, int], None]:
    """Writes the validation fact of a batch and its counters, each under the batch number."""
    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()  # read twice; rebuilt from the source if an executor is lost
        job = F.lit(f"{job_name}-{number}")
        validation_fact(kept, job, F.col("record_key")).write.mode("overwrite").parquet(f"{path}/results/batch={number}")
        processing_metrics(kept).withColumn("job_id", job).write.mode("overwrite").parquet(f"{path}/jobs/batch={number}")
        kept.unpersist()

    return write


def running_stats(validated: DataFrame) -> DataFrame:
    """Counters since the start of the stream."""
    n = F.count(F.lit(1))
    return validated.agg(
        n.alias("total_processed"), F.count_if("is_valid").alias("valid_records"), F.count_if(~F.col("is_valid")).alias("invalid_records"),
        (ratio(F.count_if("is_valid"), n) * 100).alias("success_rate_pct"))


def hourly(df: DataFrame, stamp: str, by: list[str | Column], late: str | None = None) -> DataFrame:
    """Counts per hour and group.

    With ``late`` the state of an hour is dropped once the watermark has passed it, and rows that come
    later still are not counted; a replay of files in any order must not set it.
    """
    rows = df.withWatermark(stamp, late) if late else df
    windowed = rows.groupBy(F.window(stamp, "1 hour").alias("w"), *by).agg(F.count(F.lit(1)).alias("count"))
    return windowed.select(F.col("w.start").alias("hour"), *[c for c in windowed.columns if c != "w"])
