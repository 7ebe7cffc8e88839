"""Nothing is cut, dropped or doubled in silence."""

import pytest
from pyspark.sql import functions as F

from assaykit.functions import fixed_values as V
from assaykit.operators import checks as K
from assaykit.operators import profile as P
from assaykit.operators import registry as S
from assaykit.operators import reports as G
from assaykit.operators import rules as R
from assaykit.operators import validate as E
from assaykit.operators import warehouse as W
from assaykit.operators.clean import flatten
from assaykit.sources import messages as M
from assaykit.sources import payloads as L
from assaykit.sources import readers as D
from assaykit.sources import sinks as Z
from assaykit.streaming import pipeline as T


def test_json_lines_under_the_extension_of_documents(spark, tmp_path):
    path = str(tmp_path / "out.json")
    Z.save(spark.range(1000).withColumn("v", F.lit(None).cast("string")), path, "json")
    assert D.load(spark, path, schema="id long, v string").count() == 1000
    (tmp_path / "doc.json").write_text('[\n {"id": 1},\n {"id": 2}\n]\n')
    assert D.load(spark, str(tmp_path / "doc.json")).count() == 2
    (tmp_path / "pretty.json").write_text('{\n "id": 1\n}\n')
    assert D.load(spark, str(tmp_path / "pretty.json")).first()["id"] == 1
    (tmp_path / "mixed.json").write_text('{"id": 1}\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        D.load(spark, str(tmp_path / "mixed.json"), schema="id long").collect()


def test_json_layout_is_decided_for_each_file(spark, tmp_path):
    lines = "\n".join(f'{{"a": {i}}}' for i in range(1000))
    (tmp_path / "m.json").mkdir()
    (tmp_path / "m.json" / "lines.json").write_text(lines)
    (tmp_path / "m.json" / "arrays.json").write_text('[{"a": 5}]\n[{"a": 6}, {"a": 7}]\n')
    (tmp_path / "m.json" / "doc b%20.json").write_text('[\n {"a": 2000},\n {"a": 2001}\n]\n')
    (tmp_path / "m.json" / "pretty.json").write_text('{\n "a": 2002\n}\n')
    (tmp_path / "m.json" / "empty.json").write_text("")
    assert D.load(spark, str(tmp_path / "m.json")).agg(F.count("a"), F.max("a")).first()[:] == (1003 + 3, 2002)
    (tmp_path / "m.json" / "doc [2].json").write_text('[\n {"a": 2003}\n]\n')
    assert D.load(spark, str(tmp_path / "m.json"), schema="a long").agg(F.count("a"), F.max("a")).first()[:] == (1007, 2003)


@pytest.mark.parametrize("text", [
    '{"a": 1\n' + '{"a": 2}\n' * 1000, "[]\n" + '{"a": 2}\n' * 1000 + "x", '{\n"a": 1\n}\n{\n"a": 2\n}\n', '{"a": 1}{"a": 2}\n{"a": 3}\n', '[\n{"a": 1}\n',
])
def test_broken_json_raises(spark, tmp_path, text):
    (tmp_path / "b.json").write_text(text)
    with pytest.raises(ValueError, match="malformed.*b.json"):
        D.load(spark, str(tmp_path / "b.json"), schema="a long")


@pytest.mark.parametrize("sep", [";", "|", "\t"])
def test_separator_is_found(spark, tmp_path, sep):
    (tmp_path / "a.csv").write_text(f"a{sep}b\n1{sep}x, y\n2{sep}z\n")
    assert sorted(map(tuple, D.load(spark, str(tmp_path / "a.csv")).collect())) == [("1", "x, y"), ("2", "z")]


@pytest.mark.parametrize("encoding", ["utf-8", "latin-1", "utf-16"])
def test_encoding_is_found(spark, tmp_path, encoding):
    (tmp_path / "a.csv").write_bytes("name,city\nJosé,Málaga\nMaría,Añover\n".encode(encoding))
    rows = D.load(spark, str(tmp_path / "a.csv"), encoding=None)
    assert rows.columns == ["name", "city"]
    assert sorted(map(tuple, rows.collect())) == [("José", "Málaga"), ("María", "Añover")]


def test_malformed_lines_are_told(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,city,n\n1,Oslo,5\n2,Rua, 67,3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        D.load(spark, str(tmp_path / "a.csv"), schema="id long, city string, n long").collect()
    kept = D.load(spark, str(tmp_path / "a.csv"), schema="id long, city string, n long", malformed="keep").collect()
    assert [r[D.CORRUPT] for r in kept] == [None, "2,Rua, 67,3"]


def test_a_rule_lists_all_values_or_none(spark):
    df = spark.range(1000).select((F.col("id") % 30).cast("string").alias("c"), F.concat(F.lit("k"), F.col("id") % 90).alias("d"))
    c, d = R.learn_rules(df, ["c", "d"])
    assert len(c.allowed) == 30 and len(d.allowed) == 90
    warned = E.validate(df.withColumn("id", F.lit(1)), [c, d], ["id"]).filter(F.size("warnings") > 0)
    assert warned.count() == 0
    assert [r.allowed for r in R.learn_rules(df, ["c", "d"], max_categories=50)] == [c.allowed, None]
    assert P.top_categories(df, ["c"]).count() == V.TOP_CATEGORIES


def test_values_are_not_taken_from_hashes(spark):
    hist = P.histogram(spark.createDataFrame([("x" * 100,)], "t string"), ["t"], compact_over=10)
    with pytest.raises(ValueError):
        P.top_values(hist, 3)


def test_a_stream_cut_short_raises(spark, tmp_path):
    for i in range(6):
        spark.range(10).write.mode("append").parquet(str(tmp_path / "in"))
    stream = T.read_files(spark, str(tmp_path / "in"), "id long", per_trigger=1).filter("reflect('java.lang.Thread', 'sleep', 1500L) is null or true")
    with pytest.raises(TimeoutError):
        T.run_available(stream, str(tmp_path / "out"), str(tmp_path / "check"), timeout=1)
    T.run_available(T.read_files(spark, str(tmp_path / "in"), "id long"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60


def test_jobs_without_issues_have_no_missing_values(spark):
    rows = spark.createDataFrame([("a", ["missing_value: x", "other: y"]), ("a", ["null_value: z"]), ("b", []), ("c", None)], "job_id string, issues array<string>")
    assert dict(map(tuple, G.missing_by_job(rows).collect())) == {"a": 2, "b": 0, "c": 0}
    assert dict(map(tuple, G.missing_pct(rows, 4).collect())) == {"a": 25.0, "b": 0.0, "c": 0.0}


def test_repeated_keys_and_loads(spark, tmp_path):
    offered = spark.createDataFrame([("k", 2), ("k", 1), ("old", 3)], "key string, v int")
    assert [tuple(r) for r in W.new_rows(offered, offered.filter("key = 'old'"), ["key"]).collect()] == [("k", 1)]
    jobs = spark.createDataFrame([("j", "processing", None, None, 0)], "job_id string, status string, completed_at timestamp, error_message string, total_records int")
    twice = spark.createDataFrame([("j", "failed", "late", 2), ("j", "processing", None, 1)], "job_id string, status string, error_message string, updated_at int")
    merged = W.merge_job_status(jobs, twice, F.current_timestamp()).collect()
    assert [(r["status"], r["error_message"]) for r in merged] == [("failed", "late")]
    with pytest.raises(Exception, match="several updates"):
        W.merge_job_status(jobs, twice.drop("updated_at"), F.current_timestamp()).collect()
    fact = spark.createDataFrame([("j1", 1), ("j1", 2), ("j2", 3)], "job_id string, v int")
    for part in (fact, fact.filter("job_id = 'j1'")):
        Z.append_fact(part, str(tmp_path / "fact"), "job_id")
    assert spark.read.parquet(str(tmp_path / "fact")).count() == 3
    W.rewrite(fact.filter("v = 1"), str(tmp_path / "fact"), "job_id")
    assert sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "fact")).collect()) == [1, 3]


def test_nulls_are_no_copies(spark):
    df = spark.createDataFrame([(None,), (None,), ("a",), ("a",), ("b",)], "k string")
    failed = {r["k"]: len(r["failures"]) for r in K.validate_custom(df, [K.CustomRule("k", "unique")]).collect()}
    assert failed == {None: 0, "a": 1, "b": 0}


def test_dotted_names(spark):
    df = flatten(spark.createDataFrame([(1, ("Oslo", 5)), (1, ("Oslo", 5)), (2, ("Bonn", None))], "id int, place struct<city:string,zip:int>"))
    assert "place.city" in df.columns
    assert K.duplicate_records(df).count() == 1
    assert K.mark_duplicates(df, ["place.city"]).columns == [*df.columns, "copies"]
    assert K.uniqueness(df).first()["distinct_records"] == 2
    assert M.encode(df, "id").count() == 3


def test_reserved_names_in_any_case(spark):
    df = spark.createDataFrame([("1", "x")], "ID string, v string")
    out = S.structured(df, {"ID": "string", "Job_ID": "string", "v": "string"}, row_index=F.lit(0), job_id="j", source_file="f",
                       ingestion_time=F.current_timestamp(), status=F.lit("valid"), score=F.lit(1.0))
    assert out.columns == [*V.SYSTEM_COLUMNS, "v"]


def test_csv_payload_by_its_own_header(spark):
    df = spark.createDataFrame([(1, 'b,a\r\n"x, ""y""\nz",2\r\n,3\r\n'), (2, "a,zz\n7,8\n"), (3, ""), (4, None)], "k int, p string")
    rows = [tuple(r) for r in L.csv_records(df, "p", "a long, b string", ["k"]).orderBy("k", "record_index").collect()]
    assert rows == [(1, 0, 2, 'x, "y"\nz'), (1, 1, 3, None), (2, 0, 7, None)]


def test_share_of_all_rows(spark):
    rows = G.share_of_total(spark.createDataFrame([(1,), (3,)], "v int"), "v").collect()
    assert sorted(r["share_pct"] for r in rows) == [25.0, 75.0]


def test_a_hot_key_is_split(spark):
    """A third of the rows share a key: the join back splits them over tasks."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
        marked = K.mark_duplicates(rows, ["k"])
        assert marked.filter("copies = 20000").count() == 20_000
        marked.write.format("noop").mode("overwrite").save()
        counted = marked.groupBy().agg(F.sum("copies"), F.max(F.length("text")))
        counted.collect()
        assert "skew=true" in counted._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_work_tables_are_removed(spark):
    from assaykit import session

    other = spark.newSession()
    before = session._own_folder
    try:
        session._own_folder = lambda s: f"{session.shared_dir(s)}/assaykit/test-only"
        path = session.work_path(other, "x")
        other.range(3).write.parquet(path)
        session.clear_work(other)
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            other.read.parquet(path)
    finally:
        session._own_folder = before
