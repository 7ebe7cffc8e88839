"""Tables written under several schema versions, read as one, also where a field changed its type."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_REAL = (T.FloatType, T.DoubleType)
_STAMP = (T.TimestampType, T.TimestampNTZType)
_NESTED = (T.StructType, T.ArrayType, T.MapType)


def _two(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    pair = (a, b)
    if all(isinstance(t, _WHOLE) for t in pair):
        return T.LongType()
    if all(isinstance(t, _WHOLE + (T.DecimalType,)) for t in pair):
        digits = [(t.precision - t.scale, t.scale) if isinstance(t, T.DecimalType) else (19, 0) for t in pair]
        left, right = max(d[0] for d in digits), max(d[1] for d in digits)
        return T.DecimalType(left + right, right) if left + right <= 38 else T.StringType()
    if all(isinstance(t, _WHOLE + _REAL + (T.DecimalType,)) for t in pair):
        return T.DoubleType()
    if all(isinstance(t, (T.DateType, *_STAMP)) for t in pair):
        return next((t for t in pair if isinstance(t, T.TimestampType)), T.TimestampNTZType())
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return T.StructType([T.StructField(n, t) for n, t in widest([a, b]).items()])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(_two(a.elementType, b.elementType))
    return T.StringType()


def widest(schemas: Iterable[T.StructType]) -> dict[str, T.DataType]:
    """The type of every field over all versions, in the order of their first appearance.

    Whole numbers become bigint; whole and decimal numbers a decimal that holds both; those and floating
    ones double, which is exact up to 2^53; dates and times a timestamp; records their united fields;
    arrays those of the wider element. What has nothing in common becomes text, nested values JSON text.
    """
    out: dict[str, T.DataType] = {}
    for schema in schemas:
        for field in schema.fields:
            out[field.name] = _two(out[field.name], field.dataType) if field.name in out else field.dataType
    return {name: T.StringType() if isinstance(kind, T.NullType) else kind for name, kind in out.items()}


def _widen(value: Column, have: T.DataType, want: T.DataType) -> Column:
    if have == want:
        return value
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        mine = {f.name: f.dataType for f in have.fields}
        parts = [(_widen(value[f.name], mine[f.name], f.dataType) if f.name in mine else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields]
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType):
        return F.transform(value, lambda x: _widen(x, have.elementType, want.elementType))
    if isinstance(have, _NESTED) and isinstance(want, T.StringType):
        return F.to_json(value)
    return value.cast(want)


def unite(frames: list[DataFrame]) -> DataFrame:
    """The rows of all frames under the widest types; a field that a frame lacks is null there."""
    if not frames:
        raise ValueError("no version to read")
    types = widest(f.schema for f in frames)
    out = None
    for frame in frames:
        mine = {f.name: f.dataType for f in frame.schema.fields}
        rows = frame.select(*[(_widen(F.col(f"`{n}`"), mine[n], t) if n in mine else F.lit(None).cast(t)).alias(n) for n, t in types.items()])
        out = rows if out is None else out.unionByName(rows)
    return out


def read_versions(spark: SparkSession, path: str, versions: Iterable[int], tag: str = "version") -> DataFrame:
    """The folders ``<tag>=<n>`` under a path as one table with the version in a column.

    Of every version only its schema is looked at beforehand. A projection or filter reaches the scan of
    every version, save filters on fields whose type had to change there.
    """
    return unite([spark.read.option("mergeSchema", "true").parquet(f"{path}/{tag}={n}").withColumn(tag, F.lit(n)) for n in versions])
