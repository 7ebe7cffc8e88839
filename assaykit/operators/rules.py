"""Validation rules: learned from a profile, declared, or written by hand."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from .allowed import store_values
from .profile import rule_profile


@dataclass(frozen=True)
class FieldRule:
    """What a field has to look like. A bound of None is not checked.

    Allowed values are a literal list (``allowed``) or, if they are many, a folder with a Parquet table
    of one column ``value`` (``listed``).
    """

    field: str
    kind: str = "string"
    required: bool = False
    min_length: int | None = None
    max_length: int | None = None
    min_value: float | None = None
    max_value: float | None = None
    allowed: tuple[str, ...] | None = None
    listed: str | None = None

    @property
    def patterns(self) -> list[str] | None:
        return V.PATTERNS.get(self.kind)


def rule_rows(profiled: DataFrame) -> DataFrame:
    """Rule columns from profile columns: a projection of one row per field."""
    tolerance = F.coalesce(F.col("std_value"), F.lit(0.0)) * 2
    return profiled.select(
        "field_id",
        "field",
        "detected_type",
        (~F.col("nullable")).alias("required"),
        F.when(F.col("min_length").isNotNull(), F.greatest(F.lit(1), F.col("min_length") - 2)).alias("min_length"),
        (F.col("max_length") + 10).alias("max_length"),
        (F.col("min_value") - tolerance).alias("min_value"),
        (F.col("max_value") + tolerance).alias("max_value"),
        F.col("is_categorical").alias("categorical"),
        *(["categories"] if "categories" in profiled.columns else []),
        "overall_quality",
    )


def learn_rules(df: DataFrame, columns: list[str] | None = None, max_categories: int = V.RULE_VALUES,
                order: list[str] | None = None, folder: str | None = None) -> list[FieldRule]:
    """Profile the frame and bring its rules to the driver: one row per column, no more.

    The values of a categorical column with more than ``max_categories`` of them are written as a
    table under ``folder`` (or the work tables) and judged by a join; the scores are those of a list.
    """
    columns = columns or df.columns
    rows = rule_rows(rule_profile(df, columns, max_categories, order)).collect()
    tables = _value_tables(df, [r["field"] for r in rows if r["categorical"] and not r["categories"]], folder)
    return [
        FieldRule(
            field=r["field"],
            kind=r["detected_type"],
            required=r["required"],
            min_length=r["min_length"],
            max_length=r["max_length"],
            min_value=r["min_value"],
            max_value=r["max_value"],
            allowed=tuple(r["categories"]) if r["categorical"] and r["categories"] else None,
            listed=tables.get(r["field"]),
        )
        for r in sorted(rows, key=lambda r: r["field_id"])
    ]


def _value_tables(df: DataFrame, fields: list[str], folder: str | None) -> dict[str, str]:
    return store_values(df, fields, folder) if fields else {}


def learn_definition(df: DataFrame, columns: list[str] | None = None, max_categories: int = V.RULE_VALUES, folder: str | None = None) -> list[FieldRule]:
    """The inferred definition: the bounds as seen, without the tolerance that rules get."""
    columns = columns or df.columns
    rows = rule_profile(df, columns, max_categories).collect()  # one row per column
    tables = _value_tables(df, [r["field"] for r in rows if r["is_categorical"] and not r["categories"]], folder)
    return [
        FieldRule(
            field=r["field"], kind=r["detected_type"], required=r["null_count"] == 0,
            min_length=r["min_length"], max_length=r["max_length"], min_value=r["min_value"], max_value=r["max_value"],
            allowed=tuple(r["categories"]) if r["is_categorical"] and r["categories"] else None,
            listed=tables.get(r["field"]),
        )
        for r in sorted(rows, key=lambda r: r["field_id"])
    ]
