"""Stored tables: replace, merge and delete as one step, whatever dies in between."""

import pytest
from pyspark.sql import functions as F

from assaykit.operators import warehouse as W
from assaykit.sources.tables import ConflictError, Tables

SCHEMA = "job_id string, v int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("buckets", [None, {"facts": 3, "bad": 3}])
def test_replace_empties_what_has_no_rows_any_more(spark, tmp_path, buckets):
    tables = Tables(spark, str(tmp_path / "w"), buckets=buckets)
    odd = "a/b=c %7B{[*?"
    tables.replace({"facts": frame(spark, [("j1", 1), ("j1", 2), (odd, 3), (None, 4)]), "bad": frame(spark, [("j1", 9), (odd, 8)])}, ["j1", odd, None])
    tables.replace({"facts": frame(spark, [("j1", 5)]), "bad": frame(spark, [])}, ["j1"])
    assert rows(tables.read("facts")) == rows(frame(spark, [("j1", 5), (odd, 3), (None, 4)]))
    assert rows(tables.read("bad")) == [(odd, 8)] and rows(tables.read("bad", ["j1"])) == []
    assert rows(tables.read("facts", [odd, "unknown"])) == [(odd, 3)]
    tables.delete([odd, None])
    tables.delete([odd, None])
    assert rows(tables.read("facts")) == [("j1", 5)] and rows(tables.read("bad")) == []
    assert tables.tables() == ["bad", "facts"] and tables.read("bad").schema.simpleString() == "struct<job_id:string,v:int>"
    with pytest.raises(ValueError, match="no table"):
        tables.read("other")


@pytest.mark.parametrize("buckets", [None, {"facts": 2}])
def test_rows_of_other_keys_are_refused(spark, tmp_path, buckets):
    tables = Tables(spark, str(tmp_path / "w"), buckets=buckets)
    tables.replace({"facts": frame(spark, [("j1", 1)])}, ["j1"])
    with pytest.raises(ValueError, match="another job_id"):
        tables.replace({"facts": frame(spark, [("j1", 2), ("j2", 2)])}, ["j1"])
    assert rows(tables.read("facts")) == [("j1", 1)]


def test_a_write_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    tables = Tables(spark, str(tmp_path / "w"))
    both = {"facts": frame(spark, [("j1", 1)]), "jobs": frame(spark, [("j1", 0)])}
    tables.replace(both, ["j1"])
    poison = frame(spark, [("j1", 7)]).withColumn("v", F.when(F.col("v") == 7, F.raise_error(F.lit("dies"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="dies"):  # the first table is written, the second is not
        tables.replace({"facts": frame(spark, [("j1", 2)]), "jobs": poison}, ["j1"])
    assert (rows(tables.read("facts")), rows(tables.read("jobs")), tables.version()) == ([("j1", 1)], [("j1", 0)], 1)
    with monkeypatch.context() as m:  # all is written, the commit file is not
        m.setattr(Tables, "_write", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            tables.replace({"facts": frame(spark, [("j1", 3)])}, ["j1"])
    assert rows(Tables(spark, str(tmp_path / "w")).read("facts")) == [("j1", 1)]
    assert tables.vacuum(hours=0) >= 2 and rows(tables.read("facts")) == [("j1", 1)]


def test_two_writers(spark, tmp_path):
    one, two = (Tables(spark, str(tmp_path / "w")) for _ in range(2))
    one.replace({"facts": frame(spark, [("j1", 1), ("j2", 1)])}, ["j1", "j2"])
    version = two.version()
    one.replace({"facts": frame(spark, [("j1", 2)])}, ["j1"])
    folders, schema = two.stage("facts", frame(spark, [("j2", 3)]))
    two.commit({("facts", "=j2"): folders["=j2"]}, {"facts": schema}, version)  # another partition: both count
    with pytest.raises(ConflictError):
        two.commit({("facts", "=j1"): None}, {}, version)
    assert rows(one.read("facts")) == [("j1", 2), ("j2", 3)]


def test_merge_writes_only_the_buckets_concerned(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "w"), buckets={"jobs": 8})
    schema = "job_id long, status string, completed_at timestamp, error_message string, total_records long"
    jobs = spark.createDataFrame([(i, "processing", None, "old" if i == 2 else None, i) for i in range(40)], schema)
    tables.replace({"jobs": jobs}, jobs)
    before = {r["part"]: r["folder"] for r in tables._live().filter("part is not null").collect()}
    updates = spark.createDataFrame([(2, "completed"), (99, "failed")], "job_id long, status string")  # no error_message in the update
    for _ in range(2):
        tables.merge("jobs", updates, lambda old, new: W.merge_job_status(old, new, F.current_timestamp()))
    after = {r["part"]: r["folder"] for r in tables._live().filter("part is not null").collect()}
    assert 1 <= sum(before[p] != after.get(p) for p in before) <= 2
    got = {r["job_id"]: (r["status"], r["error_message"]) for r in tables.read("jobs").collect()}
    assert len(got) == 40 and got[2] == ("completed", "old") and got[3] == ("processing", None)


def test_many_commits_fold_into_snapshots(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("assaykit.sources.tables.SNAPSHOT", 3)
    tables = Tables(spark, str(tmp_path / "w"))
    for i in range(5):
        tables.replace({"facts": frame(spark, [(f"j{i % 2}", i)])}, [f"j{i % 2}"])
    tables.delete(["j1"])
    assert rows(tables.read("facts")) == [("j0", 4)]
    assert tables._lines().filter("folder like '%facts%'").count() == 1  # the snapshot of version 6 alone
    with pytest.raises(ConflictError):
        tables.commit({("facts", "=j0"): None}, {}, 2)  # the single commits tell what changed


def test_delete_writes_only_buckets_in_which_rows_go(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "w"), buckets={"facts": 8, "jobs": 8})
    jobs = spark.createDataFrame([(i, [f"v{i}", None], None) for i in (None, *range(60))], "job_id long, v array<string>, `a.b` int")
    facts = jobs.unionByName(jobs).filter("job_id is null or job_id <> 7")
    tables.replace({"jobs": jobs, "facts": facts}, jobs)

    def folders():
        return {(r["table"], r["part"]): r["folder"] for r in tables._live().filter("part is not null").collect()}

    def left(name):
        return sorted((str(r["job_id"]), str(r["v"])) for r in tables.read(name).collect())

    doomed, before = spark.createDataFrame([(7,), (8,), (8,), (None,), (777,)], "job_id int"), folders()
    tables.delete(doomed)
    after = folders()
    want = sorted((str(i), str([f"v{i}", None])) for i in range(60) if i not in (7, 8))
    assert left("jobs") == want and left("facts") == sorted(want * 2)
    changed = {t: sum(before[k] != after[k] for k in before if k[0] == t) for t in ("jobs", "facts")}
    assert 1 <= changed["facts"] <= 2 and 1 <= changed["jobs"] <= 3  # 777 is in no bucket, 7 in none of facts
    assert tables.delete(doomed) == 3 and folders() == after  # nothing is left to go, so nothing is written
    kept = tables._without("facts", tables.read("facts"), tables._keys(doomed))
    assert str(kept._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning(pmod(") == 1
    moved = [line for line in str(kept._jdf.queryExecution().executedPlan()).splitlines() if "Exchange" in line]
    assert len(moved) <= 2  # rows and keys together once; the keys before that to be distinct
