"""Allowed values as tables, for fields with too many of them for a literal list.

The data meets such a table by its distinct values only, which are combined in each task before they
move. What is left is a table of the values that are not allowed, as a rule a short one: rows are
marked by a join with it, whose way Spark picks by the size of its files.
"""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.detectors import as_text
from ..session import work_path
from .profile import ID, cells

if TYPE_CHECKING:
    from .rules import FieldRule


def store_values(df: DataFrame, fields: list[str], folder: str | None = None) -> dict[str, str]:
    """Writes the distinct values of some columns and returns a folder for each; nulls are no values.

    Without ``folder`` they go to the work tables, which live as long as the application.
    """
    folder = folder or work_path(df.sparkSession, "values")
    cells(df, fields).filter(F.col("value").isNotNull()).distinct().write.mode("overwrite").partitionBy(ID).parquet(folder)
    return {field: f"{folder}/{ID}={i}" for i, field in enumerate(fields)}


def _values(spark, folder: str) -> DataFrame:
    return spark.read.schema("value string").parquet(folder)


def unknown_values(df: DataFrame, listed: list[FieldRule]) -> DataFrame:
    """``field_id, value``: distinct values that their field's table does not hold; ids count ``listed``."""
    seen = cells(df, [r.field for r in listed]).filter(F.col("value").isNotNull()).distinct()
    known = reduce(lambda a, b: a.unionByName(b), [
        _values(df.sparkSession, r.listed).withColumn(ID, F.lit(i)) for i, r in enumerate(listed)])
    return seen.join(known, [ID, "value"], "left_anti")


def mark_unknown(df: DataFrame, rules: list[FieldRule]) -> tuple[DataFrame, dict[str, Column]]:
    """The frame with helper columns, and by field whether its value is not allowed, for the rules with a table.

    A batch is read twice: once for its distinct values, whose unknown ones are written, once by the
    caller. A field without unknown values needs no join. A stream cannot be read twice: its rows are
    joined with the tables of allowed values as they come.
    """
    listed = [r for r in rules if r.listed and r.field in df.columns]
    if not listed:
        return df, {}
    spark, values = df.sparkSession, {r.field: as_text(df, r.field) for r in listed}
    names = {r.field: f"__listed_{i}" for i, r in enumerate(listed)}

    def join(rows: DataFrame, field: str, table: DataFrame) -> DataFrame:
        name = names[field]
        side = table.select(F.col("value").alias(f"{name}_value"), F.lit(True).alias(name))
        return rows.join(side, values[field] == F.col(f"{name}_value"), "left").drop(f"{name}_value")

    if df.isStreaming:
        for r in listed:
            df = join(df, r.field, _values(spark, r.listed))
        return df, {f: F.col(name).isNull() for f, name in names.items()}
    folder = work_path(spark, "unknown")
    unknown_values(df, listed).write.partitionBy(ID).parquet(folder)
    found = {r[0] for r in spark.read.schema(f"value string, {ID} int").parquet(folder).select(ID).distinct().collect()}  # one row per field
    for i, r in enumerate(listed):
        if i in found:
            df = join(df, r.field, _values(spark, f"{folder}/{ID}={i}"))
    return df, {r.field: F.col(names[r.field]).isNotNull() if i in found else F.lit(False) for i, r in enumerate(listed)}
