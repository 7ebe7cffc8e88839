"""Checks beyond learned rules: constraints, declared and custom rules, keys, references."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as V
from ..functions.detectors import always_fits, as_text, fits_loosely, fits_type, number_of
from ..functions.settle import note_failures, settle
from .allowed import mark_unknown
from .rules import FieldRule
from .warehouse import ratio


# ---- constraint check of an inferred definition ----------------------------------------------
def constraint_score(value: Column, amount: Column, rule: FieldRule, unknown: Column | None = None) -> Column:
    """Product of the constraint factors of one present value and its number; missing bounds are not checked."""
    score, w = F.lit(1.0), V.CONSTRAINT_FACTORS
    if rule.min_length is not None:
        score = score * F.when(F.length(value) < rule.min_length, w["length"]).otherwise(1.0)
    if rule.max_length is not None:
        score = score * F.when(F.length(value) > rule.max_length, w["length"]).otherwise(1.0)
    if rule.min_value is not None:
        score = score * F.when(amount < rule.min_value, w["range"]).otherwise(1.0)
    if rule.max_value is not None:
        score = score * F.when(amount > rule.max_value, w["range"]).otherwise(1.0)
    if rule.allowed:
        score = score * F.when(~value.isin(list(rule.allowed)), w["category"]).otherwise(1.0)
    elif unknown is not None:
        score = score * F.when(unknown, w["category"]).otherwise(1.0)
    return score


def validate_constraints(df: DataFrame, definition: list[FieldRule]) -> DataFrame:
    """Judge records by an inferred definition: only a missing required value makes one invalid."""
    scores, errors, warnings, columns = [], [], [], df.columns
    df, unknown = mark_unknown(df, definition)
    for rule in definition:
        here = rule.field in df.columns
        value = as_text(df, rule.field) if here else F.lit(None).cast("string")
        amount = number_of(df, rule.field) if here else F.lit(None).cast("double")
        missing = (value.isNull() | (value == "")) if rule.required else F.lit(False)
        mismatch = value.isNotNull() & ~fits_loosely(value, rule.kind)
        if rule.required:
            errors.append((missing, f"Required field '{rule.field}' is missing"))
        warnings.append((mismatch, f"Field '{rule.field}' type mismatch: expected {rule.kind}"))
        scores.append(
            F.when(missing, 0.0)
            .when(value.isNull(), 1.0)
            .otherwise(F.when(mismatch, V.CONSTRAINT_FACTORS["type"]).otherwise(1.0) * constraint_score(value, amount, rule, unknown.get(rule.field)))
        )
    scored = settle(df, {"quality_score": reduce(lambda a, b: a + b, scores) / len(scores)}).select(
        *[F.col(f"`{c}`") for c in columns], "quality_score")
    noted = note_failures(note_failures(scored, errors, "errors", "is_valid"), warnings, "warnings", "__calm")
    return noted.withColumn(
        "status", F.when(~F.col("is_valid"), "invalid").when(~F.col("__calm"), "warning").otherwise("valid")).drop("__calm")


def dynamic_metrics(checked: DataFrame, fields: list[str]) -> DataFrame:
    """Dataset metrics of a constraint check, one pass."""
    n = F.count(F.lit(1))
    covered = reduce(lambda a, b: a + b, [F.coalesce(F.max(F.col(f"`{f}`").isNotNull().cast("int")), F.lit(0)) for f in fields])
    return checked.agg(
        ratio(F.sum("quality_score"), n).alias("overall_quality_score"),
        ratio(F.count_if("is_valid"), n).alias("data_completeness"),
        (covered / len(fields)).alias("schema_coverage"),
        ratio(F.count_if(F.size("errors") > 0), n).alias("error_rate"),
        ratio(F.count_if(F.size("warnings") > 0), n).alias("warning_rate"))


# ---- declared rules ---------------------------------------------------------------------------
@dataclass(frozen=True)
class DeclaredField:
    dtype: str
    nullable: bool = True
    regex: str | None = None


def declared_failures(df: DataFrame, fields: dict[str, DeclaredField]) -> list[tuple[Column, str]]:
    """Failure condition and ``field: reason`` text of every check."""
    out = []
    for name, spec in fields.items():
        value = as_text(df, name)
        blank = value.isNull() | (value == "") if isinstance(df.schema[name].dataType, T.StringType) else value.isNull()
        if not spec.nullable:
            out.append((blank, f"{name}: required value missing"))
        if spec.dtype == "integer" and not always_fits(df, name, "integer"):
            out.append((~blank & ~fits_type(value, "integer"), f"{name}: not an integer"))
        elif spec.dtype == "float":
            out.append((~blank & number_of(df, name).isNull(), f"{name}: not a number"))
        if spec.regex:
            out.append((~blank & ~value.rlike(spec.regex), f"{name}: pattern mismatch"))
    return out


def validate_declared(df: DataFrame, fields: dict[str, DeclaredField]) -> DataFrame:
    """Adds ``failures`` and ``is_valid``."""
    return note_failures(df, declared_failures(df, fields), "failures", "is_valid")


# ---- custom rules -----------------------------------------------------------------------------
@dataclass(frozen=True)
class CustomRule:
    """A hand-written rule: pattern, range, values, required or unique."""

    field: str
    rule_type: str
    rule_value: Any = None
    message: str = ""


def rule_failed(df: DataFrame, rule: CustomRule) -> Column:
    """Whether a record breaks the rule; ``unique`` needs ``mark_duplicates`` and is not a Column."""
    value, col = as_text(df, rule.field), F.col(f"`{rule.field}`")
    if rule.rule_type == "pattern":
        return F.coalesce(~value.rlike(rule.rule_value), F.lit(False))
    if rule.rule_type == "range":
        low, high = rule.rule_value
        return F.coalesce(~col.cast("double").between(low, high), F.lit(False))
    if rule.rule_type == "values":
        return F.coalesce(~value.isin(list(rule.rule_value)), F.lit(False))
    if rule.rule_type == "required":
        return value.isNull() | (value == "")
    raise ValueError(f"unknown rule type {rule.rule_type}")


def validate_custom(df: DataFrame, rules: list[CustomRule]) -> DataFrame:
    """Adds ``failures``: the messages of the broken rules."""
    marked, outcome, helpers = df, [], []
    for i, rule in enumerate(rules):
        text = rule.message or f"{rule.field}: {rule.rule_type}"
        if rule.rule_type == "unique":
            helper = f"__copies_{i}"
            # a null is no copy of another null
            marked, helpers = mark_duplicates(marked, [rule.field], helper, nulls=False), [*helpers, helper]
            outcome.append((F.col(helper) > 1, text))
        else:
            outcome.append((rule_failed(marked, rule), text))
    return note_failures(marked, outcome, "failures").drop(*helpers)


# ---- keys, references, copies ------------------------------------------------------------------
def _named(columns: list[str]) -> list[Column]:
    """Columns by their plain names, dots included."""
    return [F.col(f"`{c}`") for c in columns]


def key_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once. Combined before the exchange, so a hot key costs one row per task."""
    return df.groupBy(*_named(keys)).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def mark_duplicates(df: DataFrame, keys: list[str], name: str = "copies", nulls: bool = True) -> DataFrame:
    """Number of rows that share the key, on every row.

    A window would bring all rows of a key into one task. Counting first leaves one row per
    repeated key, and the join back is an ordinary equi-join whose large side Spark may split.
    Without ``nulls`` a row with a null in its key has no copies and takes no part in the join.
    """
    counted = df if nulls else df.filter(reduce(lambda a, b: a & b, [c.isNotNull() for c in _named(keys)]))
    renamed = key_counts(counted, keys).select(*[F.col(f"`{k}`").alias(f"__key_{i}") for i, k in enumerate(keys)], F.col("copies").alias(name))
    same = [(F.col(f"`{k}`").eqNullSafe(F.col(f"__key_{i}")) if nulls else F.col(f"`{k}`") == F.col(f"__key_{i}")) for i, k in enumerate(keys)]
    return df.join(renamed, same, "left").select(*_named(df.columns), F.coalesce(name, F.lit(1)).alias(name))


def orphans(df: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Values without a parent and how many rows hold them; null refers to nothing and is no orphan."""
    used = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("row_count"))
    keys = parent.select(F.col(parent_key).alias("__parent")).filter(F.col("__parent").isNotNull())
    return used.join(keys, F.col(column) == F.col("__parent"), "left_anti")


def duplicate_records(df: DataFrame) -> DataFrame:
    """Whole records that occur more than once; equality is on the values, not on a hash."""
    return key_counts(df, df.columns)


def uniqueness(df: DataFrame) -> DataFrame:
    """Share of distinct records."""
    per_record = df.groupBy(*_named(df.columns)).agg(F.count(F.lit(1)).alias("__n"))
    return per_record.agg(F.sum("__n").alias("records"), F.count(F.lit(1)).alias("distinct_records")).withColumn(
        "uniqueness", F.try_divide(F.col("distinct_records"), F.col("records")))


def outside_spread(value: Column, mean: float, std: float | None, sigmas: float = 2.0) -> Column:
    """Value further than ``sigmas`` deviations from the mean."""
    gap = (std or 0.0) * sigmas
    return (value < mean - gap) | (value > mean + gap)


def timeliness(stamp: Column, as_of: Column, max_days: int) -> Column:
    """1 for a record of the last ``max_days`` days, falling to 0 at twice that age."""
    age = F.date_diff(as_of, stamp)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 - age / max_days))


# ---- three-way disposition ----------------------------------------------------------------------
def disposition(required: list[Column], suspicious: list[Column]) -> Column:
    """violation before quarantine before accepted."""
    missing = reduce(lambda a, b: a | b, [c.isNull() for c in required])
    doubt = reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in suspicious])
    return F.when(missing, "violation").when(doubt, "quarantine").otherwise("accepted")


# ---- static customer record ----------------------------------------------------------------------
def validate_static(df: DataFrame) -> DataFrame:
    """Adds ``failures`` and ``is_valid`` by the fixed customer model."""
    failures = []
    for name, required, low, high in V.CUSTOMER_MODEL:
        value = F.col(name)
        if required:
            failures.append((value.isNull() | (F.length(F.trim(value)) == 0), f"{name}: required"))
        size = F.length(value)
        if low is not None and low > 1:
            failures.append(((F.length(F.trim(value)) > 0) & (size < low), f"{name}: too short"))
        if high is not None:
            failures.append((size > high, f"{name}: too long"))
    postal = F.trim("postal_code")
    failures.append(((F.length(postal) > 0) & (F.length(postal) < 3), "postal_code: under three characters"))
    return note_failures(df, failures, "failures", "is_valid")


def static_score(df: DataFrame) -> Column:
    """Points of the customer model over ten; eleven are possible."""

    def point(cond: Column) -> Column:
        return F.when(cond, 1).otherwise(0)

    filled = [point(F.length(F.trim(F.col(c))) > 0) for c in
              ("customer_id", "company_name", "contact_name", "city", "postal_code", "country", "region", "contact_title")]
    sized = [point(F.length("customer_id") >= 3), point(F.length("postal_code") >= 5)]
    known = point(F.col("segment").isin(V.SEGMENTS))
    return reduce(lambda a, b: a + b, [*filled, *sized, known]) / 10
