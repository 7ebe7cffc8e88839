"""Readers, payloads, messages, sinks and streams over files."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.operators.rules import FieldRule
from assaykit.operators.validate import validate
from assaykit.sources import messages as M
from assaykit.sources import payloads as L
from assaykit.sources import readers as D
from assaykit.sources import sinks as Z
from assaykit.streaming import pipeline as S


def put(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv_null_tokens(spark, tmp_path):
    p = put(tmp_path / "a.csv", "a,b\nx,N/A\nNULL,\n <NA>,#N/A\n")
    assert [tuple(r) for r in D.load(spark, p).collect()] == [("x", None), (None, None), (" <NA>", None)]


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_separator(spark, tmp_path, sep):
    p = put(tmp_path / "a.csv", sep.join(["a", "b", "c"]) + "\n" + sep.join(["1", '"x,y;z|w"', "3"]) + "\n")
    assert D.sniff_separator(spark, p) == sep
    assert D.read_csv_sniffed(spark, p).first()["b"] == "x,y;z|w"


def test_unknown_extension_fails_early(spark):
    with pytest.raises(ValueError):
        D.load(spark, "/nowhere/data.xlsx")


def test_encodings(spark, tmp_path):
    for name, encoding in (("u8", "utf-8"), ("latin", "latin-1"), ("u16", "utf-16")):
        put(tmp_path / f"{name}.txt", "un café\nà côté\n", encoding)
    put(tmp_path / "win.txt", "a “quote”\n", "cp1252")
    got = {r["file"].rsplit("/", 1)[1]: (r["encoding"], r["encoding_issue"]) for r in D.encoding_audit(spark, str(tmp_path)).collect()}
    assert got == {"u8.txt": ("utf-8", False), "latin.txt": ("latin-1", True), "u16.txt": ("utf-16", False), "win.txt": ("cp1252", True)}


def test_malformed_lines_are_kept(spark, tmp_path):
    p = put(tmp_path / "a.csv", "id,city,n\n1,Oslo,2\n2,Rua, 67,3\n3,Rome,many\n")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("city", T.StringType()), T.StructField("n", T.LongType())])
    rows = D.read_csv_marked(spark, p, schema)
    assert rows.filter(F.col(D.CORRUPT).isNotNull()).count() == 2
    assert rows.select("id").count() == 3


def test_json_layouts(spark, tmp_path):
    assert D.load(spark, put(tmp_path / "a.json", '[{"a": 1},\n {"a": 2}]')).count() == 2
    assert D.load(spark, put(tmp_path / "b.json", '{"a":\n 1}')).first()["a"] == 1
    assert D.load(spark, put(tmp_path / "c.jsonl", '{"a": 1}\n{"a": 2}\n')).count() == 2


def test_many_files_are_tagged(spark, tmp_path):
    paths = [put(tmp_path / "one.csv", "a,b\n1,2\n"), put(tmp_path / "two.csv", "a\n3\n")]
    assert sorted(tuple(r) for r in D.load_many(spark, paths).collect()) == [("1", "2", "one.csv"), ("3", None, "two.csv")]


def test_payload_shapes(spark):
    payloads = ['[{"v": 1}, {"v": 2}]', '{"data": [{"v": 3}]}', '{"z": [{"v": 4}], "a": [{"v": 0}]}', '{"v": 5}', "oops", '{"meta": {}, "results": []}']
    df = spark.createDataFrame(list(enumerate(payloads)), "k int, p string")
    rows = L.json_records(df, "p", ["k"]).select("k", F.try_variant_get("record", "$.v", "int").alias("v")).collect()
    assert sorted(tuple(r) for r in rows) == [(0, 1), (0, 2), (1, 3), (2, 4), (3, 5)]


def test_csv_payload(spark):
    df = spark.createDataFrame([(1, 'a,b\n1,"x, y"\n2,z\n'), (2, "a,b\n")], "k int, p string")
    assert [tuple(r) for r in L.csv_records(df, "p", "a int, b string", ["k"]).collect()] == [(1, 0, 1, "x, y"), (1, 1, 2, "z")]


SCHEMA = "id long, name string, amount string"


def test_messages_round_trip(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, "2.5")], SCHEMA)
    messages = M.encode(df, "id")
    assert [r["key"] for r in messages.collect()] == ["1", "2"]
    assert sorted(tuple(r) for r in M.decode(messages, SCHEMA).collect()) == [(1, "a", None), (2, None, "2.5")]


def test_dead_letters_and_records_are_all_messages(spark):
    df = spark.createDataFrame([("k", v) for v in ['{"id": 1}', "{", "text", "[1]", None, "7"]], "key string, value string")
    assert M.decode(df, SCHEMA).count() == 1
    assert M.dead_letters(df, SCHEMA).count() == 5


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_save(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "  a ", None), (2, 'quo"te, x', "2.5")], SCHEMA)
    Z.save(df, str(tmp_path / "out"), fmt)
    back = D.load(spark, str(tmp_path / "out"), "jsonl" if fmt == "json" else fmt, SCHEMA)
    assert sorted(tuple(r) for r in back.collect()) == [(1, "  a ", None), (2, 'quo"te, x', "2.5")]


RULES = [FieldRule("name", "string", True, 1, 5), FieldRule("amount", "float", True, None, None, 0.0, 10.0)]


def records(spark):
    return spark.createDataFrame([(i, "abcdefg" if i % 4 == 0 else "abc", "1.5" if i % 3 else "99.5") for i in range(40)], SCHEMA)


def test_split_outputs(spark, tmp_path):
    Z.save_split(validate(records(spark), RULES, ["id"]), str(tmp_path / "out"))
    good, bad, high = (f(spark, str(tmp_path / "out")).count() for f in (Z.read_good, Z.read_bad, Z.read_high_quality))
    assert good + bad == 40 and high <= good


def test_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    M.encode(records(spark).repartition(3), "id").write.parquet(source)
    messages = S.read_files(spark, source, "key string, value string", per_trigger=1)
    S.run_available(S.validate_stream(messages, SCHEMA, RULES, ["id"]), str(tmp_path / "out"), str(tmp_path / "check"))
    columns = ["id", "is_valid", "quality_score"]
    batch = validate(records(spark), RULES, ["id"]).select(*columns)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*columns).collect())) == sorted(map(tuple, batch.collect()))


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for _ in range(2):
        records(spark).write.mode("append").parquet(source)
        S.run_available(S.read_files(spark, source, SCHEMA), out, check)
    assert spark.read.parquet(out).count() == 80


def test_repeated_batch_leaves_no_second_copy(spark, tmp_path):
    write = S.split_writer(str(tmp_path / "out"), 0.8)
    batch = validate(records(spark), RULES, ["id"])
    write(batch, 0)
    write(batch, 0)
    write(batch, 1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 80
