"""Per-value functions against plain Python."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from assaykit.functions import fixed_values as V
from assaykit.functions import normalise as N
from assaykit.functions.detectors import DETECTORS, number, quality_level
from assaykit.functions.settle import note_failures, sql_text

VALUES = [
    "a@b.co", "a@b", "555-123-4567", "+15551234567", "0123", "25", "-5", "7", "32.38", ".5", "5.", "1e5", "1.5e3", "1_000", "12a",
    "https://x.example.com/a?b=1", "ftp://x", "$1,000.50", "12 USD", "12 XYZ", "12.5%", "%", "12345-6789", "K1A 0B1", "192.168.1.1",
    "256.1.1.1", "4111 1111 1111 1111", "123-45-6789", "true", "No", "y", "maybe", "2024-02-29", "2023-02-29", "13/01/2024", "01/13/2024",
    "2024/1/5", "March 5, 2024", "5 march 2024", "2024-01-01 10:00:00", "2024-01-01T10:00:00Z", "2024-01-01T10:00:00.5", "[1, 2]",
    '{"a": 1}', "{'a': 1}", "{bad", "[1] [2]", "1],[2", "1 2", "null", "nan", "007", '"text"', "",
]


def parses(value, formats):
    for f in formats:
        try:
            datetime.strptime(value, f)
            return True
        except ValueError:
            pass
    return False


def is_json(value):
    try:
        json.loads(value)
        return True
    except ValueError:
        return False


def is_int(value):
    try:
        int(value)
        return True
    except ValueError:
        return False


def is_float(value):
    try:
        float(value)
        return "." in value
    except ValueError:
        return False


PLAIN = {
    "integer": is_int,
    "float": is_float,
    "boolean": lambda v: v.lower() in V.BOOLEAN_WORDS,
    "date": lambda v: parses(v, ["%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%Y/%m/%d", "%d-%m-%Y", "%m-%d-%Y", "%B %d, %Y", "%d %B %Y"]),
    "datetime": lambda v: parses(v, ["%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f",
                                     "%Y-%m-%dT%H:%M:%SZ", "%m/%d/%Y %H:%M:%S"]),
    "json": is_json,
}


@pytest.fixture(scope="module")
def detected(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "v string")
    rows = df.select("v", *[fn(F.col("v")).alias(k) for k, fn in DETECTORS.items()]).collect()
    return {r["v"]: r for r in rows}


@pytest.mark.parametrize("kind", list(PLAIN))
def test_parsed_types_agree_with_python(detected, kind):
    assert {v: bool(detected[v][kind]) for v in VALUES} == {v: PLAIN[kind](v) for v in VALUES}


@pytest.mark.parametrize("kind, good, bad", [
    ("email", "a@b.co", "a@b"), ("phone", "555-123-4567", "0123"), ("url", "https://x.example.com/a?b=1", "ftp://x"), ("currency", "12 USD", "12 XYZ"),
    ("percentage", "12.5%", "%"), ("postal_code", "K1A 0B1", "12a"), ("ip_address", "192.168.1.1", "256.1.1.1"),
    ("credit_card", "4111 1111 1111 1111", "123-45-6789"), ("social_security", "123-45-6789", "25"),
])
def test_pattern_types(detected, kind, good, bad):
    assert detected[good][kind] and not detected[bad][kind]


def test_gates_never_change_a_result(spark):
    """Every gate lets through whatever its patterns match, line end included."""
    from assaykit.functions.detectors import matches_any

    longest = ["+1-(555)-123-4567", "+123456789012345", "K1A 0B1", "12345-6789", "255.255.255.255", "4111-1111-1111-1111", "123-45-6789",
               "01234567-89ab-1cde-8f01-23456789abcd", "0123-4", "http://a", "HTTPS://A.B", "9%"]
    values = [v + end for v in VALUES + longest for end in ("", "\n", "\r\n")]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for kind, patterns in V.PATTERNS.items():
        assert df.filter(DETECTORS[kind](F.col("v")) != matches_any(F.col("v"), patterns)).count() == 0, kind


def test_number_rejects_java_suffixes(spark):
    df = spark.createDataFrame([("1d",), ("1.5f",), (" 2.5 ",), ("1e3",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(number(F.col("v"))).collect()] == [None, None, 2.5, 1000.0, None, None]


@pytest.mark.parametrize("score, level", [(1.0, "excellent"), (0.9, "excellent"), (0.8999, "good"), (0.8, "good"), (0.7999, "fair"), (0.6, "fair"), (0.5999, "poor")])
def test_level_edges(spark, score, level):
    assert spark.range(1).select(quality_level(F.lit(score))).first()[0] == level


def test_normalisers(spark):
    df = spark.createDataFrame([(" ab ", " Yes ", " retail goods"), ("  ", "perhaps", "FINANCE")], "i string, b string, s string")
    rows = df.select(N.identifier(F.col("i")), N.boolean_like(F.col("b")), N.segment(F.col("s")), N.segment_known(F.col("s"))).collect()
    assert [tuple(r) for r in rows] == [("AB", "true", "Retail Goods", False), (None, "perhaps", "Finance", True)]


def test_sql_text_round_trips(spark):
    for text in ["it's", "a\\b", "quote ' and \\' both", "new\nline"]:
        assert spark.range(1).select(F.expr(sql_text(text))).first()[0] == text


def test_more_failures_than_one_word_holds(spark):
    df = spark.range(3)
    checks = [(F.col("id") == 1, f"check {i}") for i in range(70)] + [(F.col("id") == 2, "last")]
    rows = {r["id"]: r for r in note_failures(df, checks, "failures", "fine").collect()}
    assert rows[0]["failures"] == [] and rows[0]["fine"]
    assert len(rows[1]["failures"]) == 70 and not rows[1]["fine"]
    assert rows[2]["failures"] == ["last"]
