"""Record validation: rules compiled into Column expressions, a projection without a shuffle.

Each field first gets one integer of check bits. Scores, issues and warnings are read off those
bits, so every pattern and cast runs once per cell whatever the caller selects.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.detectors import always_fits, as_text, fits_type, number_of, quality_level
from ..functions.settle import settle, sql_text
from .allowed import mark_unknown
from .rules import FieldRule

ABSENT_REQUIRED, ABSENT_OPTIONAL, NULL_REQUIRED, NULL_OPTIONAL = 1, 2, 4, 8
TYPE, SHORT, LONG, BELOW, ABOVE, CATEGORY, PATTERN = 16, 32, 64, 128, 256, 512, 1024
ISSUE_BITS = ABSENT_REQUIRED | NULL_REQUIRED | TYPE | SHORT | LONG | BELOW | ABOVE | PATTERN
WARNING_BITS = ABSENT_OPTIONAL | CATEGORY


def _bit(cond: Column, bit: int) -> Column:
    return F.when(cond, F.lit(bit)).otherwise(F.lit(0))


def check_bits(df: DataFrame, rule: FieldRule, unknown: Column | None = None) -> Column:
    """The failed checks of one cell; ``unknown`` comes from ``mark_unknown`` for a rule with a table of allowed values."""
    value, parts = as_text(df, rule.field), []
    if rule.patterns:
        parts.append(_bit(~fits_type(value, rule.kind), TYPE | PATTERN))
    elif rule.kind not in ("string", "categorical") and not always_fits(df, rule.field, rule.kind):
        parts.append(_bit(~fits_type(value, rule.kind), TYPE))
    size = F.length(value)
    if rule.min_length is not None:
        parts.append(_bit(size < rule.min_length, SHORT))
    if rule.max_length is not None:
        parts.append(_bit(size > rule.max_length, LONG))
    if rule.kind in V.NUMERIC_TYPES:
        if rule.min_value is not None:
            parts.append(_bit(number_of(df, rule.field) < rule.min_value, BELOW))
        if rule.max_value is not None:
            parts.append(_bit(number_of(df, rule.field) > rule.max_value, ABOVE))
    if rule.allowed:
        parts.append(_bit(~value.isin(list(rule.allowed)), CATEGORY))
    elif rule.listed:
        if unknown is None:
            raise ValueError(f"the allowed values of {rule.field} are a table: mark the rows first")
        parts.append(_bit(unknown, CATEGORY))
    present = reduce(lambda a, b: a + b, parts) if parts else F.lit(0)
    absent = NULL_REQUIRED if rule.required else NULL_OPTIONAL
    return F.when(value.isNull() | (value == ""), F.lit(absent)).otherwise(present)


def _has(bits: str, bit: int) -> str:
    return f"({bits} & {bit}) != 0"


# The expressions below read only check bits and rule constants. They are built as SQL text: one
# call to the JVM each, where Column objects would take hundreds for a wide record.


def field_score(bits: str) -> Column:
    """Score of a cell; the factors multiply in the order of the checks."""
    f = V.FACTORS

    def factor(bit: int, name: str) -> str:
        return f"IF({_has(bits, bit)}, {f[name]}D, 1.0D)"

    return F.expr(f"""
        CASE WHEN {bits} = 0 THEN 1.0D
             WHEN {_has(bits, ABSENT_REQUIRED | NULL_REQUIRED)} THEN {V.MISSING_REQUIRED}D
             WHEN {_has(bits, ABSENT_OPTIONAL)} THEN {V.MISSING_OPTIONAL}D
             WHEN {_has(bits, NULL_OPTIONAL)} THEN {V.NULL_OPTIONAL}D
             ELSE {factor(TYPE, 'type')}
                  * CASE WHEN {_has(bits, SHORT)} THEN {f['short']}D WHEN {_has(bits, LONG)} THEN {f['long']}D ELSE 1.0D END
                  * {factor(BELOW | ABOVE, 'range')} * {factor(CATEGORY, 'category')} * {factor(PATTERN, 'pattern')} END""")


def field_issues(bits: str, rule: FieldRule) -> list[str]:
    """Possible issues of a field as SQL, null where the check passed."""
    checks = [
        (True, ABSENT_REQUIRED, "missing_value", "Required field is missing"),
        (True, NULL_REQUIRED, "missing_value", "Field cannot be null"),
        (rule.kind != "string", TYPE, "invalid_format", f"Invalid {rule.kind} format"),
        (rule.min_length is not None, SHORT, "length_violation", f"Value too short (min: {rule.min_length})"),
        (rule.max_length is not None, LONG, "length_violation", f"Value too long (max: {rule.max_length})"),
        (rule.min_value is not None, BELOW, "out_of_range", f"Value below minimum ({rule.min_value})"),
        (rule.max_value is not None, ABOVE, "out_of_range", f"Value above maximum ({rule.max_value})"),
        (bool(rule.patterns), PATTERN, "inconsistent_pattern", "Value doesn't match expected pattern"),
    ]
    return [
        f"IF({_has(bits, bit)}, named_struct('field', {sql_text(rule.field)}, 'issue_type', '{kind}', "
        f"'description', {sql_text(text)}), NULL)"
        for on, bit, kind, text in checks if on
    ]


def field_warnings(bits: str, value: Column | None, rule: FieldRule) -> list[Column]:
    out = [F.expr(f"IF({_has(bits, ABSENT_OPTIONAL)}, {sql_text(f"Optional field '{rule.field}' is missing")}, NULL)")]
    if (rule.allowed or rule.listed) and value is not None:
        out.append(F.when(F.expr(_has(bits, CATEGORY)), F.concat(
            F.lit(f"Field '{rule.field}' has unexpected category: "), value)))
    return out


def validate(df: DataFrame, rules: list[FieldRule], keys: list[str], score_warnings: bool = False) -> DataFrame:
    """Validate every record.

    Adds ``is_valid, quality_score, quality_level, field_scores, issues, warnings`` to the columns
    of ``df``. ``keys`` identify a record and are not validated. ``score_warnings`` also warns about
    scores under the route and valid thresholds. Rules with a table of allowed values read a batch
    twice, see ``mark_unknown``.
    """
    if not rules:
        raise ValueError("no rules to validate by")
    columns, have = df.columns, set(df.columns)
    df, unknown = mark_unknown(df, rules)
    bits = {r.field: f"__bits_{i}" for i, r in enumerate(rules)}
    coded = settle(df, {
        bits[r.field]: check_bits(df, r, unknown.get(r.field)) if r.field in have
        else F.lit(ABSENT_REQUIRED if r.required else ABSENT_OPTIONAL)
        for r in rules
    })
    scores = [field_score(b) for b in bits.values()]
    rated = settle(coded, {
        "quality_score": reduce(lambda a, b: a + b, scores) / len(scores),
        "__flags": F.expr(" | ".join(bits.values())),
    })

    score, failed = F.col("quality_score"), F.expr(_has("__flags", ISSUE_BITS))
    none = F.expr("CAST(array() AS array<struct<field:string,issue_type:string,description:string>>)")
    issues = F.expr("array_compact(array(" + ", ".join(c for r in rules for c in field_issues(bits[r.field], r)) + "))")
    notes = [c for r in rules
             for c in field_warnings(bits[r.field], as_text(df, r.field) if r.field in have else None, r)]
    surprises = [F.lit(f"Unexpected field '{c}' found") for c in columns if c not in bits and c not in keys]
    warned = F.expr(_has("__flags", WARNING_BITS))
    about_score = quality_warnings(score) if score_warnings else []
    if score_warnings:
        warned = warned | (score < V.ROUTE_SCORE)
    extra = F.array(*surprises).cast("array<string>")
    return rated.select(
        *[F.col(f"`{c}`") for c in columns],
        (~failed & (score >= V.VALID_SCORE)).alias("is_valid"),
        "quality_score",
        quality_level(score).alias("quality_level"),
        F.create_map(*[x for r in rules for x in (F.lit(r.field), field_score(bits[r.field]))]).alias("field_scores"),
        F.when(failed, issues).otherwise(none).alias("issues"),
        F.when(warned, F.array_compact(F.array(*notes, *surprises, *about_score))).otherwise(extra).alias("warnings"),
    )


def quality_warnings(score: Column) -> list[Column]:
    """Warnings about the score itself."""
    return [
        F.when(score < V.ROUTE_SCORE, F.concat(
            F.lit("Data quality score is "), F.format_string("%.2f", score), F.lit(" - consider reviewing"))),
        F.when(score < V.VALID_SCORE, F.lit("Poor data quality detected - manual review recommended")),
    ]


def good(results: DataFrame) -> DataFrame:
    return results.filter("is_valid")


def bad(results: DataFrame) -> DataFrame:
    return results.filter(~F.col("is_valid"))


def is_high_quality(floor: float = V.ROUTE_SCORE) -> Column:
    """Valid and at or above a score."""
    return F.col("is_valid") & (F.col("quality_score") >= floor)


def high_quality(results: DataFrame, floor: float = V.ROUTE_SCORE) -> DataFrame:
    """Valid records at or above a score; the rest is ``low_quality``."""
    return results.filter(is_high_quality(floor))


def low_quality(results: DataFrame, floor: float = V.ROUTE_SCORE) -> DataFrame:
    return results.filter(~is_high_quality(floor))


def ingest_stats(results: DataFrame) -> DataFrame:
    """One row of counters; levels count valid records only."""
    valid = F.col("is_valid")
    names = [name for name, _ in V.LEVELS] + [V.LOWEST_LEVEL]
    stats = results.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(valid).alias("valid_records"),
        F.count_if(~valid).alias("invalid_records"),
        *[F.count_if(valid & (F.col("quality_level") == n)).alias(f"{n}_records") for n in names],
    )
    rate = F.when(F.col("total_records") > 0, F.col("valid_records") / F.col("total_records") * 100).otherwise(0.0)
    return stats.withColumn("success_rate_pct", rate)


def issue_rows(results: DataFrame, keys: list[str]) -> DataFrame:
    """One row per issue."""
    return results.select(*keys, F.explode("issues").alias("issue")).select(*keys, "issue.*")


def issues_by_type(results: DataFrame) -> DataFrame:
    return issue_rows(results, []).groupBy("issue_type", "field").agg(F.count(F.lit(1)).alias("issue_count"))


def first_failures(results: DataFrame, keys: list[str], k: int = 50) -> DataFrame:
    """The first ``k`` failing records by key, with their issues as text."""
    return (
        bad(results).orderBy(*keys).limit(k).select(
            *keys, "quality_score",
            F.concat_ws("; ", F.transform("issues", lambda i: F.concat(i["field"], F.lit(": "), i["description"]))).alias("errors"),
            F.concat_ws("; ", "warnings").alias("warnings"),
        )
    )


def cap_issues(results: DataFrame, most: int) -> DataFrame:
    """Report at most ``most`` issues per record and how many there were."""
    return results.withColumn("issue_count", F.size("issues")).withColumn("issues", F.slice("issues", 1, most))
