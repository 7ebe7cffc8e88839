"""Profiles that are stored per load and merged: the profile of a table without reading its old data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.detectors import DETECTORS
from ..sources.tables import Tables
from .profile import ID, _finish, _names, _summaries, cells

#: key and name of the stored table
LOAD, TABLE = "load_id", "profiles"
#: the sketch of distinct values has 2^14 buckets: a standard error of about 0.8 %
LG_K = 14


def profile_state(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: counts, sums, bounds, centred squares and a sketch of the distinct values; one pass, no data-sized exchange."""
    columns = columns or df.columns
    each = cells(df, columns).withColumn("n", F.lit(1).cast("long"))
    rows = _summaries(each, F.hll_sketch_agg("value", F.lit(LG_K)).alias("sketch"), (F.var_pop("x") * F.count("x")).alias("square_gaps"))
    return rows.select(_names(columns).alias("field"), F.col(ID).alias("place"), *[c for c in rows.columns if c != ID])


def add_load(tables: Tables, df: DataFrame, load_id: str, columns: list[str] | None = None) -> None:
    """Stores the state of a load; a load that comes again replaces its own. The tables have the key ``load_id``."""
    tables.replace({TABLE: profile_state(df, columns).withColumn(LOAD, F.lit(load_id))}, [load_id])


def merge_states(states: DataFrame) -> DataFrame:
    """The state of all loads together, from a row per column and load.

    A column that a load lacks has no rows there. Squares are joined about the common mean; what
    its rounding leaves is taken off.
    """
    sums = ["total_values", "null_count", "sum_length", "sum_value", "numbers", *[f"is_{t}" for t in DETECTORS], "is_temporal"]
    merged = states.groupBy("field").agg(
        F.min("place").alias("place"), *[F.sum(c).alias(c) for c in sums],
        *[F.min(c).alias(c) for c in ("min_length", "min_value")], *[F.max(c).alias(c) for c in ("max_length", "max_value")],
        F.hll_union_agg("sketch").alias("sketch"))
    means = merged.select("field", F.try_divide("sum_value", "numbers").alias("mean"))
    gap = F.try_divide("sum_value", "numbers") - F.col("mean")
    some, n = F.col("numbers") > 0, F.col("numbers")
    squares = states.join(means, "field").groupBy("field").agg(  # rows per column and load on one side, per column on the other
        F.sum(F.when(some, F.col("square_gaps") + n * gap * gap)).alias("s"), F.sum(F.when(some, n * gap)).alias("rest"), F.sum("numbers").alias("n"))
    rest = F.coalesce(F.try_divide(F.col("rest") * F.col("rest"), F.col("n")), F.lit(0.0))
    return merged.join(squares.select("field", F.greatest(F.col("s") - rest, F.lit(0.0)).alias("square_gaps")), "field")


def finish_profile(states: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Types, bounds, flags and scores as ``profile`` has them; the numbers of distinct values are the sketches'."""
    merged = merge_states(states)
    columns = [r["field"] for r in merged.select("place", "field").orderBy("place", "field").collect()]  # one row per column
    place = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("field")).cast("int") - 1
    unique = F.when(F.col("null_count") == F.col("total_values"), F.lit(0).cast("long")).otherwise(F.hll_sketch_estimate("sketch"))
    return _finish(merged.select(place.alias(ID), unique.alias("unique_values"), *[c for c in merged.columns if c not in ("field", "place", "sketch")]), columns, order)


def stored_profile(tables: Tables, loads: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """The profile over all stored loads, or some of them."""
    return finish_profile(tables.read(TABLE, loads), order)
