"""Streams into stored tables: bounds, restarts, late rows."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from assaykit.sources.tables import Tables
from assaykit.streaming import runs as B

SCHEMA = "id long, ts timestamp, kind string, slice_of string"


def drop(spark, folder, rows):
    """One more file of (id, ts, kind)."""
    spark.createDataFrame([(i, t, k, "x") for i, t, k in rows], "id long, ts string, kind string, slice_of string").withColumn(
        "ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.fixture
def place(spark, tmp_path):
    folder = str(tmp_path / "in")
    for n in range(4):
        drop(spark, folder, [(10 * n + i, "2024-01-01 00:10:00", "a") for i in range(10)])
    return folder, str(tmp_path / "checkpoint"), Tables(spark, str(tmp_path / "tables"), key=B.SLICE)


def ids(tables):
    return sorted(r["id"] for r in tables.read("rows").collect())


def test_a_run_ends_with_its_records_and_goes_on(spark, place):
    folder, checkpoint, tables = place
    write = B.batch_writer(tables, lambda b: {"rows": b.select("id")})
    assert B.run_bounded(stream(spark, folder), checkpoint, write, records=15) == "records"
    assert len(ids(tables)) == 20  # two whole batches
    assert B.run_bounded(stream(spark, folder), checkpoint, write, records=1) == "records" and len(ids(tables)) == 30
    assert B.run_bounded(stream(spark, folder), checkpoint, write, records=10_000) == "end"
    assert ids(tables) == list(range(40))
    assert sorted((r["slice"], r["records"]) for r in tables.read(B.BATCHES).collect()) == [(0, 10), (1, 10), (2, 10), (3, 10)]


def test_empty_polls_and_time(spark, place):
    folder, checkpoint, tables = place
    write = B.batch_writer(tables, lambda b: {"rows": b.select("id")})
    assert B.run_bounded(stream(spark, folder), checkpoint, write, empty_polls=2, poll=0.5) == "idle"
    assert ids(tables) == list(range(40))
    with pytest.raises(TimeoutError):
        B.run_bounded(stream(spark, folder), checkpoint, write, empty_polls=1000, poll=0.5, timeout=2)


@pytest.mark.parametrize("moment", ["before", "after"])
def test_a_batch_that_dies_comes_again_once(spark, place, monkeypatch, moment):
    """Killed before its commit, or after it but before the stream has noted the batch."""
    folder, checkpoint, tables = place
    write, commit, calls = B.batch_writer(tables, lambda b: {"rows": b.select("id")}), tables.commit, []

    def dies(*args):
        calls.append(1)
        if len(calls) != 3:
            return commit(*args)
        if moment == "after":
            commit(*args)
        raise OSError("dies")

    monkeypatch.setattr(tables, "commit", dies)
    with pytest.raises(StreamingQueryException, match="dies"):
        B.run_bounded(stream(spark, folder), checkpoint, write)
    assert len(ids(tables)) == (20 if moment == "before" else 30)
    assert B.run_bounded(stream(spark, folder), checkpoint, write) == "end"
    assert ids(tables) == list(range(40))


@pytest.mark.parametrize("moment", [None, "before", "after"])
def test_hours(spark, tmp_path, monkeypatch, moment):
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    tables = Tables(spark, str(tmp_path / "tables"), key=B.SLICE)
    batches = [
        [(1, "2024-01-02 10:30:00", "a"), (2, "2024-01-02 08:00:00", "a"), (3, None, "a")],     # nothing is late in the first batch, but no time is no hour
        [(4, "2024-01-02 08:59:59", "a"), (5, "2024-01-02 09:30:00", "a"), (6, "2024-01-01 23:00:00", None), (6, "2024-01-01 23:00:00", None)],
        [(7, "2024-01-03 00:00:00", "b")],
        [(8, "2024-01-02 10:59:59", "a")],
        []]
    commit, calls = tables.commit, []

    def dies(*args):
        calls.append(1)
        if len(calls) != 2 or moment is None:
            return commit(*args)
        if moment == "after":
            commit(*args)
        raise OSError("dies")

    monkeypatch.setattr(tables, "commit", dies)
    write = B.hour_writer(tables, "ts", ["kind"], "1 hour")
    for rows in batches:
        drop(spark, folder, rows)
        try:
            B.run_bounded(stream(spark, folder), checkpoint, write)
        except StreamingQueryException:
            B.run_bounded(stream(spark, folder), checkpoint, write)
    hours = sorted((str(r["hour"]), str(r["kind"]), r["count"]) for r in tables.read("hours").collect())
    assert hours == [("2024-01-01 23:00:00", "None", 2), ("2024-01-02 08:00:00", "a", 2), ("2024-01-02 09:00:00", "a", 1),
                     ("2024-01-02 10:00:00", "a", 2), ("2024-01-03 00:00:00", "b", 1)]
    # of batch 2, the mark is 9:30: hours that ended by then are closed
    assert sorted(r["id"] for r in tables.read("late").collect()) == [3, 4, 6, 6, 8]
    state = tables.read("state").collect()
    assert len(state) == 1 and state[0]["records"] == 9 and state[0]["late_records"] == 5 and str(state[0]["latest"]) == "2024-01-03 00:00:00"
    late = B.late_by_hour(tables, "ts", ["kind"])
    assert late.filter("hour is not null").agg(F.sum("late")).first()[0] == 4
