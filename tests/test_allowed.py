"""Allowed values as a table: the same verdicts as with a list, whatever their number."""

import pytest
from pyspark.sql import functions as F

from assaykit.operators import checks as K
from assaykit.operators.allowed import mark_unknown, store_values
from assaykit.operators.rules import FieldRule, learn_definition, learn_rules
from assaykit.operators.validate import check_bits, validate


def judged(df, keys=("id",)):
    return sorted((r["id"], r["quality_score"], tuple(r["warnings"])) for r in df.collect())


@pytest.fixture
def codes(spark):
    """12,000 rows with 1,100 codes in one column, 40 in another; a column is named with a dot."""
    return spark.range(12000).select(
        F.col("id"), F.concat(F.lit("code "), F.col("id") % 1100, F.lit(".")).alias("a.code"), F.concat(F.lit("kind "), F.col("id") % 40, F.lit(".")).alias("kind"))


def dirty(codes):
    i = F.col("id")
    return codes.select(
        "id", F.when(i % 1000 == 7, "code x.").when(i % 1000 == 8, F.lit(None)).when(i % 1000 == 9, "").otherwise(F.col("`a.code`")).alias("a.code"),
        F.when(i % 500 == 3, "kind x.").otherwise(F.col("kind")).alias("kind"), F.lit(1).alias("value"), F.lit("z").alias("field_id"))


@pytest.mark.parametrize("learn, judge", [(learn_rules, lambda d, r: validate(d, r, ["id"])), (learn_definition, K.validate_constraints)])
def test_table_and_list_agree(spark, codes, learn, judge):
    fields = ["a.code", "kind"]
    short, long = learn(codes, fields, 10), learn(codes, fields, 5000)
    assert all(r.listed and not r.allowed for r in short) and all(r.allowed and not r.listed for r in long)
    assert len(long[0].allowed) == 1100
    data = dirty(codes)
    results = judge(data, short)
    assert judged(results) == judged(judge(data, long))
    assert results.columns == judge(data, long).columns and results.count() == 12000


def test_a_hundred_thousand_values(spark):
    """All planted unknown values are flagged, and no other."""
    rows = spark.range(1_200_000).select("id", F.concat(F.lit("c"), F.col("id") % 100_000, F.lit("!")).alias("code"))
    rules = learn_rules(rows, ["code"])
    assert rules[0].listed and not rules[0].allowed
    planted = F.col("id") % 10_007 == 5
    results = validate(rows.withColumn("code", F.when(planted, F.concat(F.lit("new"), F.col("id") % 3)).otherwise(F.col("code"))), rules, ["id"])
    flagged = F.size("warnings") > 0
    row = results.agg(F.count_if(planted & flagged).alias("hit"), F.count_if(planted).alias("planted"), F.count_if(flagged & ~planted).alias("wrong")).first()
    assert row["hit"] == row["planted"] == 120 and row["wrong"] == 0


def test_streams_join_the_table(spark, codes, tmp_path):
    rules = learn_rules(codes, ["a.code", "kind"], 10)
    data = dirty(codes).drop("value", "field_id")
    data.write.parquet(str(tmp_path / "in"))
    stream = validate(spark.readStream.schema(data.schema).parquet(str(tmp_path / "in")), rules, ["id"])
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert judged(spark.read.parquet(str(tmp_path / "out"))) == judged(validate(data, rules, ["id"]))


def test_edges(spark, codes, tmp_path):
    listed = store_values(codes, ["kind"], str(tmp_path / "v"))["kind"]
    rule = FieldRule("kind", listed=listed)
    empty = validate(codes.limit(0), [rule], ["id"])
    assert empty.count() == 0
    with pytest.raises(ValueError, match="mark the rows"):
        check_bits(codes, rule)
    clean = validate(codes, [rule], ["id", "a.code"])
    assert clean.filter(F.size("warnings") > 0).count() == 0
    assert validate(codes.drop("kind"), [rule], ["id", "a.code"]).filter(F.size("warnings") == 1).count() == 12000  # absent, not unknown
    plan = mark_unknown(codes, [rule])[0]._jdf.queryExecution().toString()
    assert "Join" not in plan  # no unknown value, no join
