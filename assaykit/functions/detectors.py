"""Per-value type predicates as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed_values as V


def as_text(df: DataFrame, name: str) -> Column:
    """The column as text; NaN counts as null."""
    dtype, col = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(dtype, T.StringType):
        return col
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(col), col.cast("string"))
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return F.to_json(col)
    return col.cast("string")


def matches_any(value: Column, patterns: list[str]) -> Column:
    """Whether any pattern fits, ignoring case."""
    hit = F.lit(False)
    for i, pattern in enumerate(patterns):
        one = value.rlike(f"(?i){pattern}")
        hit = one if i == 0 else hit | one
    return hit


def _parses(value: Column, formats: list[tuple[str, str]]) -> Column:
    """Whether one of the formats reads the value. A parse runs only where the shape fits."""
    by_shape: dict[str, list[str]] = {}
    for shape, fmt in formats:
        by_shape.setdefault(shape, []).append(fmt)
    hit = None
    for shape, fmts in by_shape.items():
        parsed = F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in fmts])
        hit = (F.when if hit is None else hit.when)(value.rlike(shape), parsed.isNotNull())
    return hit.otherwise(False)


def is_integer(value: Column) -> Column:
    return value.rlike(V.INTEGER_PATTERN)


def is_float(value: Column) -> Column:
    return value.rlike(f"(?i){V.FLOAT_PATTERN}")


def is_boolean(value: Column) -> Column:
    return (F.length(value) <= 5) & F.lower(value).isin(V.BOOLEAN_WORDS)


def is_date(value: Column) -> Column:
    return F.length(value).between(8, 19) & _parses(value, V.DATE_FORMATS)


def is_datetime(value: Column) -> Column:
    return F.length(value).between(14, 27) & _parses(value, V.DATETIME_FORMATS)


def is_json(value: Column) -> Column:
    """One whole JSON value. Scalars are decided by their shape.

    The parser stops after the first value, so a nested one is parsed inside an array and inside an
    object: text that goes on after the value breaks one of the two.
    """
    alone = F.json_array_length(F.concat(F.lit("["), value, F.lit("]"))) == 1
    strict = F.try_parse_json(F.concat(F.lit('{"v":'), value, F.lit("}"))).isNotNull()
    return F.when(value.rlike(r'^\s*[\[{"]'), F.coalesce(alone & strict, F.lit(False))).otherwise(
        value.rlike(V.JSON_SCALAR_PATTERN))


# What a value of a type must have, whatever the pattern says in detail: a length or a character.
# Checking that first keeps most patterns from running at all. Lengths allow for the line end that
# a pattern may leave unmatched.
GATES: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: v.contains("@"),
    "phone": lambda v: F.length(v) <= 20,
    "url": lambda v: v.contains("://"),
    "uuid": lambda v: F.length(v).between(36, 40),
    "percentage": lambda v: v.contains("%"),
    "postal_code": lambda v: F.length(v) <= 14,
    "ip_address": lambda v: F.length(v) <= 20,
    "credit_card": lambda v: F.length(v).between(16, 24),
    "social_security": lambda v: F.length(v).between(9, 16),
}


def gated(kind: str, value: Column, check: Column) -> Column:
    """``check`` behind the gate of the type."""
    return GATES[kind](value) & check if kind in GATES else check


def _pattern_detector(name: str) -> Callable[[Column], Column]:
    return lambda value: gated(name, value, matches_any(value, V.PATTERNS[name]))


DETECTORS: dict[str, Callable[[Column], Column]] = {
    **{name: _pattern_detector(name) for name in V.PATTERNS},
    "integer": is_integer,
    "float": is_float,
    "boolean": is_boolean,
    "date": is_date,
    "datetime": is_datetime,
    "json": is_json,
}


def number(value: Column) -> Column:
    """The number a text holds, else null. The pattern keeps suffixes such as ``1d`` out."""
    return F.when(value.rlike(f"(?i){V.NUMBER_PATTERN}"), F.trim(value).try_cast("double"))


def number_of(df: DataFrame, name: str) -> Column:
    """The number in a column: a numeric one is taken as it is, text is read."""
    dtype, col = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(col), col.cast("double"))
    return col.cast("double") if isinstance(dtype, T.NumericType) else number(as_text(df, name))


def always_fits(df: DataFrame, name: str, kind: str) -> bool:
    """Whether the storage type of a column already settles the check."""
    dtype = df.schema[name].dataType
    return isinstance(dtype, T.IntegralType) and kind == "integer"


def fits_type(value: Column, kind: str) -> Column:
    """Whether a value fits a resolved type; string and categorical take anything."""
    return DETECTORS[kind](value) if kind in DETECTORS else F.lit(True)


def fits_loosely(value: Column, kind: str) -> Column:
    """The lighter check used for inferred definitions; unknown types take anything."""
    checks = {
        "integer": lambda v: v.rlike(r"^\d+$"),
        "float": lambda v: number(v).isNotNull(),
        "boolean": lambda v: F.lower(v).isin(V.LOOSE_BOOLEAN_WORDS),
        "datetime": lambda v: is_date(v) | is_datetime(v),
        "email": lambda v: v.contains("@") & v.contains("."),
        "phone": lambda v: F.length(F.regexp_replace(v, "[ -]", "")) >= 10,
        "url": lambda v: v.startswith("http://") | v.startswith("https://"),
    }
    return checks[kind](value) if kind in checks else F.lit(True)


def quality_level(score: Column) -> Column:
    """Band of a score."""
    band = None
    for name, floor in V.LEVELS:
        band = (F.when if band is None else band.when)(score >= floor, name)
    return band.otherwise(V.LOWEST_LEVEL)
