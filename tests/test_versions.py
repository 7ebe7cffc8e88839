"""Deep pages, versions with changed types, profiles merged over loads."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from assaykit.operators import paging as P
from assaykit.operators import profile
from assaykit.operators import registry as S
from assaykit.operators import stored_profile as T
from assaykit.operators import versions as N
from assaykit.sources.tables import Tables


# ---- pages
@pytest.mark.parametrize("order", [["a", "id"], ["-a", "id"], ["a", "-id"], ["-b.c", "-a", "id"]])
def test_all_pages_are_the_sorted_table(spark, order):
    rows = [(i, None if i % 5 == 0 else i % 3, None if i % 7 == 0 else f"x{i % 4}") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a int, `b.c` string").repartition(4)
    got = [r["id"] for page in P.pages(df, order, 7) for r in page]

    def place(row):
        out = []
        for name in order:
            value = row[{"id": 0, "a": 1, "b.c": 2}[name.lstrip("-")]]
            out.append((value is not None, value))
        return out

    expected = sorted(rows, key=lambda r: r[0])
    for i in reversed(range(len(order))):  # stable sorts, the last key first
        expected.sort(key=lambda r: (place(r)[i][0], place(r)[i][1] if place(r)[i][0] else 0), reverse=False) if not order[i].startswith("-") else \
            expected.sort(key=lambda r: (place(r)[i][0], place(r)[i][1] if place(r)[i][0] else ("" if order[i] == "-b.c" else 0)), reverse=True)
    assert got == [r[0] for r in expected]


def test_a_deep_page_is_a_filtered_scan_and_a_top_k(spark, tmp_path):
    spark.range(100_000).repartition(4).write.parquet(str(tmp_path / "t"))
    page = P.seek(spark.read.parquet(str(tmp_path / "t")), ["id"], 50, {"id": 49_999})
    assert [r[0] for r in page.collect()] == list(range(50_000, 50_050))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "GreaterThan(id,49999)" in plan and "Exchange" not in plan
    assert list(P.pages(spark.range(0), ["id"], 5)) == []


def test_json_keys_of_any_kind(spark):
    df = spark.createDataFrame([(1, '{"a.b": "x", "it\'s": 2, "a": {"b": "no"}, "q?": true}'), (2, '{"a": 1}'), (3, None)], "id int, `pay.load` string")
    for key, value in (("a.b", "x"), ("it's", 2), ("q?", "true")):
        assert [r["id"] for r in S.query_flexible(df, "pay.load", {key: value}, ["id"]).collect()] == [1]
    assert [r["id"] for r in S.query_flexible(df, "pay.load", {"a": 1}, ["id"]).collect()] == [2]


# ---- versions
def test_types_widen_and_rows_stay(spark, tmp_path):
    spark.sql("SELECT 1 AS id, 7 AS n, date'2024-02-01' AS d, 5 AS s, named_struct('x', 1) AS r, array(1, 2) AS l, CAST(1.5 AS decimal(4,2)) AS m, 1 AS gone").write.parquet(str(tmp_path / "version=1"))
    spark.sql("SELECT 2L AS id, 2.5D AS n, timestamp_ntz'2024-02-01 10:00:00' AS d, 'five' AS s, named_struct('x', 2.5D, 'y', 'z') AS r, array(1.5D) AS l, 3L AS m, map('k', 1) AS o").write.parquet(str(tmp_path / "version=2"))
    spark.sql("SELECT 3L AS id, CAST(NULL AS int) AS n, CAST(NULL AS date) AS d, array(1) AS s, CAST(NULL AS struct<x:int>) AS r, CAST(NULL AS array<int>) AS l, CAST(12 AS decimal(5,0)) AS m, 'text' AS o").write.parquet(str(tmp_path / "version=3"))
    got = N.read_versions(spark, str(tmp_path), [1, 2, 3]).orderBy("version")
    one, two, three = got.collect()
    assert dict(got.dtypes)["id"] == "bigint" and dict(got.dtypes)["m"] == "decimal(21,2)"
    assert (one["n"], one["d"], one["s"], tuple(one["r"]), one["l"], one["m"], one["gone"], one["o"]) == (7.0, dt.datetime(2024, 2, 1), "5", (1.0, None), [1.0, 2.0], Decimal("1.50"), 1, None)
    assert (two["n"], two["d"], two["s"], tuple(two["r"]), two["l"], two["m"], two["gone"], two["o"]) == (2.5, dt.datetime(2024, 2, 1, 10), "five", (2.5, "z"), [1.5], Decimal("3.00"), None, '{"k":1}')
    assert (three["n"], three["s"], three["r"], three["l"], three["m"], three["o"], three["version"]) == (None, "[1]", None, None, Decimal("12.00"), "text", 3)
    with pytest.raises(ValueError, match="no version"):
        N.read_versions(spark, str(tmp_path), [])


def test_unchanged_fields_keep_their_pushed_filters(spark, tmp_path):
    for n, kind in ((1, "bigint"), (2, "string")):
        spark.range(100).select("id", F.col("id").cast(kind).alias("v"), F.lit("w").alias("wide")).write.parquet(str(tmp_path / f"version={n}"))
    plan = N.read_versions(spark, str(tmp_path), [1, 2]).filter("id > 90").select("id", "v")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("GreaterThan(id,90)") == 2 and "wide" not in plan


# ---- profiles over loads
EXACT = ["field", "detected_type", "total_values", "null_count", "nullable", "min_length", "max_length", "is_categorical"]
NEAR = ["avg_length", "min_value", "max_value", "mean_value", "std_value", "completeness", "consistency", "validity", "overall_quality"]


def test_loads_merge_to_the_profile_of_all_rows(spark, tmp_path):
    df = spark.range(6000).select(
        "id", (F.lit(1e9) + F.col("id") / 7).alias("far"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("k"), F.col("id") % 9)).alias("a.kind"),
        F.lit(None).cast("string").alias("none"), F.when(F.col("id") < 2000, F.lit("2024-01-05")).alias("first_only"))
    tables = Tables(spark, str(tmp_path / "t"), key=T.LOAD)
    T.add_load(tables, df.filter("id >= 4000").limit(10), "c")  # replaced below
    for load, cond in (("a", "id < 2000"), ("b", "id >= 2000 AND id < 4000"), ("c", "id >= 4000"), ("d", "false")):
        T.add_load(tables, df.filter(cond), load)
    assert tables.read(T.TABLE).filter("load_id = 'c'").count() == 5
    got, want = T.stored_profile(tables).orderBy("field_id").collect(), profile.profile(df).orderBy("field_id").collect()
    assert [r["field"] for r in got] == df.columns
    for g, w in zip(got, want):
        assert [g[c] for c in EXACT] == [w[c] for c in EXACT]
        assert {c: g[c] is None for c in NEAR} == {c: w[c] is None for c in NEAR}
        assert [g[c] or 0 for c in NEAR] == pytest.approx([w[c] or 0 for c in NEAR], rel=1e-7)  # sums of 10^12 leave eight digits of the spread
        assert abs(g["unique_values"] - w["unique_values"]) <= 0.04 * w["unique_values"]
    some, first = T.stored_profile(tables, ["a"]).orderBy("field_id"), profile.profile(df.filter("id < 2000")).orderBy("field_id")
    assert [[r[c] for c in EXACT] for r in some.collect()] == [[r[c] for c in EXACT] for r in first.collect()]


def test_a_column_that_a_load_lacks(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "t"), key=T.LOAD)
    T.add_load(tables, spark.createDataFrame([(-1001, "x"), (-2002, "y")], "v int, w string"), "a")
    T.add_load(tables, spark.createDataFrame([("-3003",)], "v string"), "b")
    got = {r["field"]: r for r in T.stored_profile(tables).collect()}
    assert (got["v"]["total_values"], got["v"]["max_value"], got["w"]["total_values"]) == (3, -1001.0, 2)
