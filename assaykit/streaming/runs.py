"""Streams into stored tables: bounded runs, restarts without loss or doubles, hours with late rows.

A micro-batch is one commit of ``Tables``. A batch that dies before its commit leaves nothing that a
reader sees, one that runs again after it replaces itself, and readers never meet half a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Tables

#: key of the tables that a stream writes: the batch number, or the day of an hour
SLICE = "slice"
#: one row per batch with its records
BATCHES = "batches"

Outputs = Callable[[DataFrame], dict[str, DataFrame]]
Write = Callable[[DataFrame, int], None]


def batch_writer(tables: Tables, outputs: Outputs) -> Write:
    """Commits what ``outputs`` makes of a batch, and its number of records, as one step.

    The tables have the key ``slice``, which holds the batch number. A batch without records commits
    its zero.
    """

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()  # read once per output; rebuilt from the source if an executor is lost
        try:
            frames = {**outputs(kept), BATCHES: kept.agg(F.count(F.lit(1)).alias("records"))}
            tables.replace({name: rows.withColumn(SLICE, F.lit(number)) for name, rows in frames.items()}, [number])
        finally:
            kept.unpersist()

    return write


class _Gate:
    """Counts the records of the batches of one run and refuses those beyond a bound."""

    def __init__(self, write: Write, records: int | None) -> None:
        self.write, self.records, self.seen, self.batches, self.closed = write, records, 0, 0, False

    def __call__(self, batch: DataFrame, number: int) -> None:
        if self.records is not None and self.seen >= self.records:
            self.closed = True
            raise RuntimeError("the run has its records")  # before anything of the batch is written
        if self.records is None:
            self.write(batch, number)
        else:
            kept = batch.persist()
            try:
                n = kept.count()
                self.write(kept, number)
                self.seen += n
            finally:
                kept.unpersist()
        self.batches += 1


def run_bounded(df: DataFrame, checkpoint: str, write: Write, records: int | None = None, empty_polls: int | None = None,
                poll: float = 1.0, timeout: float | None = None) -> str:
    """Runs a stream to its bound and says which one ended it: ``records``, ``idle`` or ``end``.

    * ``records``: no batch starts once the batches of this run hold that many; the last one is kept
      whole, so the source's own limit per batch is how far a run can go beyond.
    * ``empty_polls``: the run waits for more, and ends when so many looks at the source in a row, one
      every ``poll`` seconds, found nothing. Without it the run ends with what there was at its start.
    * ``timeout``: seconds after which the run is stopped and TimeoutError raised.

    The next run on the same checkpoint goes on where this one stopped; a batch that was refused or cut
    off comes again as it was. A failure of the batches' own is raised.
    """
    gate = _Gate(write, records)
    trigger = {"availableNow": True} if empty_polls is None else {"processingTime": f"{int(poll * 1000)} milliseconds"}
    query = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(gate).trigger(**trigger).start()
    idle, batches, waited = 0, 0, 0.0
    try:
        while not query.awaitTermination(poll):
            waited += poll
            status = query.status
            quiet = status["message"].startswith("Waiting") and not status["isDataAvailable"] and gate.batches == batches
            idle, batches = idle + 1 if quiet else 0, gate.batches
            if empty_polls is not None and idle >= empty_polls:
                return "idle"
            if timeout is not None and waited >= timeout:
                raise TimeoutError(f"the stream was not done after {timeout} s; run it again to go on from its checkpoint")
    except StreamingQueryException:
        if not gate.closed:
            raise
        return "records"
    finally:
        query.stop()
    return "end"


# ---- hours ------------------------------------------------------------------------------------------
_STATE = "only"  # the slice of the state's single row


def _hour(df: DataFrame, stamp: str) -> Column:
    return F.date_trunc("hour", F.col(stamp)).cast(df.schema[stamp].dataType)


def hour_writer(tables: Tables, stamp: str, by: list[str], delay: str) -> Write:
    """Counts per hour and group, kept in tables instead of the stream's memory; late rows are counted and kept.

    The tables have the key ``slice``:

    * ``hours``: ``hour, *by, count``, a slice per day. A batch rewrites the days that it has rows of.
    * ``late``: the rows of a batch whose hour had closed, that is, ended ``delay`` (an interval, such
      as ``2 hours``) or more before the latest time of the batches before; a slice per batch. They are
      in ``hours`` all the same.
    * ``state``: one row: last batch, latest time, records, late records.

    All three change in one commit. A batch that comes again after its commit changes nothing. What a
    batch holds in memory is its own groups; nothing grows with the stream. Rows without a time have no
    hour: they count as records and go to ``late``.
    """

    def write(batch: DataFrame, number: int) -> None:
        version = tables.version()
        known = version > 0
        last = tables.read("state", [_STATE]).first() if known else None
        if last and last["batch"] >= number:
            return
        hour, mark = _hour(batch, stamp), F.lit(last["latest"] if last else None).cast(batch.schema[stamp].dataType)
        ended = hour + F.expr("INTERVAL 1 HOUR") <= mark - F.expr(f"INTERVAL {delay}")
        closed = F.col(stamp).isNull() | F.coalesce(ended, F.lit(False))
        kept = batch.persist()
        try:
            counts = kept.filter(F.col(stamp).isNotNull()).groupBy(hour.alias("hour"), *by).agg(F.count(F.lit(1)).alias("count"))
            fresh = counts.withColumn(SLICE, F.date_format("hour", "yyyy-MM-dd"))
            days = [r[0] for r in fresh.select(SLICE).distinct().collect()]  # one per day of the batch
            merged = fresh.unionByName(tables.read("hours", days)) if known else fresh
            totals = merged.groupBy("hour", *by, SLICE).agg(F.sum("count").alias("count"))
            late = kept.filter(closed).withColumn(SLICE, F.lit(str(number)))
            base = last.asDict() if last else {"records": 0, "late_records": 0}
            state = kept.agg(
                F.lit(number).cast("long").alias("batch"), F.greatest(F.max(stamp), mark).alias("latest"),
                (F.count(F.lit(1)) + base["records"]).alias("records"), (F.count_if(closed) + base["late_records"]).alias("late_records")).withColumn(SLICE, F.lit(_STATE))
            staged = {"hours": tables.stage("hours", totals), "late": tables.stage("late", late), "state": tables.stage("state", state)}
            slices = {"hours": days, "late": [str(number)], "state": [_STATE]}
            tables.commit({(t, f"={s}"): staged[t][0].get(f"={s}") for t, ss in slices.items() for s in ss}, {t: schema for t, (_, schema) in staged.items()}, version)
        finally:
            kept.unpersist()

    return write


def late_by_hour(tables: Tables, stamp: str, by: list[str | Column]) -> DataFrame:
    """Late rows per hour and group."""
    late = tables.read("late")
    return late.groupBy(_hour(late, stamp).alias("hour"), *by).agg(F.count(F.lit(1)).alias("late"))
