"""Cleaning projections. None of them shuffles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as V


def _text_columns(df: DataFrame, fn) -> DataFrame:
    """Apply ``fn`` to the text columns and keep the rest."""
    return df.select(
        *[
            fn(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def standardise_names(df: DataFrame) -> DataFrame:
    """Strip column names and replace blanks with underscores."""
    return df.toDF(*[name.strip().replace(" ", "_") for name in df.columns])


def null_tokens(df: DataFrame, tokens: list[str] | None = None) -> DataFrame:
    """Turn null words into nulls."""
    words = V.CLEAN_NULL_TOKENS if tokens is None else tokens
    return _text_columns(df, lambda c: F.when(~F.trim(c).isin(words), c))


def trim_text(df: DataFrame) -> DataFrame:
    """Trim every text column; leftovers of failed conversions become null."""
    return _text_columns(df, lambda c: F.when(~F.trim(c).isin(V.RESIDUE_TOKENS), F.trim(c)))


def drop_empty_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop rows in which every one of the columns is null (or NaN)."""
    filled = []
    for name in columns or df.columns:
        col = F.col(f"`{name}`")
        number = isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))
        filled.append(col.isNotNull() & ~F.isnan(col) if number else col.isNotNull())
    return df.filter(reduce(lambda a, b: a | b, filled))


def clean(df: DataFrame, payload: list[str] | None = None) -> DataFrame:
    """Names, null words, trimming, empty rows: one stage.

    ``payload`` names the columns that decide whether a row is empty; keys are left out of it.
    """
    named = standardise_names(df)
    wanted = [p.strip().replace(" ", "_") for p in payload] if payload else None
    return drop_empty_rows(trim_text(null_tokens(named)), wanted)


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """Nested structs as columns with dotted names."""

    def leaves(schema: T.StructType, path: list[str]) -> list[Column]:
        out: list[Column] = []
        for f in schema.fields:
            here = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                out += leaves(f.dataType, here)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in here)).alias(separator.join(here)))
        return out

    return df.select(*leaves(df.schema, []))


def rename(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Accept the alias spelling of each field: alias -> field name."""
    table = V.CUSTOMER_ALIASES if aliases is None else aliases
    return df.withColumnsRenamed({alias: name for name, alias in table.items()})


def envelope(df: DataFrame, *, job_id: Column, source_file: Column, row_index: Column,
             status: Column, score: Column, ingestion_time: Column, payload: list[str]) -> DataFrame:
    """The stored form of a record: system columns and the payload as JSON."""
    return df.select(
        job_id.alias("job_id"),
        source_file.alias("source_file"),
        row_index.alias("row_index"),
        status.alias("validation_status"),
        score.alias("quality_score"),
        ingestion_time.alias("ingestion_time"),
        F.to_json(F.struct(*payload)).alias("payload"),
    )
