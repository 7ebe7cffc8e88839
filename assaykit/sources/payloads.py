"""Records out of API payloads kept as text, one payload per row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as V

LIST = "array<variant>"


def record_list(payload: Column) -> Column:
    """The records of a JSON payload.

    A list is taken as it is. Of an object the preferred keys come first, then the first key that
    holds a list, else the object itself is the only record.
    """
    doc = F.try_parse_json(payload)
    fields = F.try_variant_get(doc, "$", "map<string,variant>")
    in_order = F.transform(F.json_object_keys(payload), lambda k: F.try_variant_get(F.try_element_at(fields, k), "$", LIST))
    first_list = F.get(F.filter(in_order, lambda a: a.isNotNull()), 0)
    preferred = [F.try_variant_get(doc, f"$.{key}", LIST) for key in V.PAYLOAD_KEYS]
    return F.coalesce(F.try_variant_get(doc, "$", LIST), *preferred, first_list, F.when(fields.isNotNull(), F.array(doc)))


def json_records(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """One row per record as variant; a payload that is not JSON gives none."""
    return df.select(*keep, F.posexplode(record_list(F.col(payload))).alias("record_index", "record"))


def _outside_quotes(sep: str) -> str:
    """The separator where an even number of quotes follows."""
    return sep + r'(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _unquoted(cell: Column) -> Column:
    bare = F.regexp_extract(cell, r'(?s)^\s*"(.*)"\s*$', 1)
    return F.when(cell.rlike(r'(?s)^\s*".*"\s*$'), F.replace(bare, F.lit('""'), F.lit('"'))).otherwise(cell)


def csv_records(df: DataFrame, payload: str, schema: str, keep: list[str], sep: str = ",") -> DataFrame:
    """Records of CSV text by the names of its own header line, whatever their order.

    Quoted cells may hold separators and line breaks. A field the header lacks, and a cell that does
    not fit its type or is empty, is null.
    """
    text = F.rtrim(F.regexp_replace(payload, "\r\n?", "\n"))
    rows = df.select(*keep, F.split(text, _outside_quotes("\n")).alias("__lines"))
    split = lambda line: F.transform(F.split(line, _outside_quotes(re.escape(sep))), _unquoted)
    header = F.transform(split(F.get("__lines", F.lit(0))), F.trim)
    lines = rows.select(*keep, header.alias("__header"), F.posexplode(
        F.slice("__lines", 2, F.greatest(F.size("__lines") - 1, F.lit(0)))).alias("record_index", "__line"))
    cells = lines.filter(F.trim("__line") != "").withColumn("__cells", split(F.col("__line")))
    fields = T.StructType.fromDDL(schema).fields

    def of(field: T.StructField) -> Column:
        at = F.array_position("__header", field.name).cast("int")
        cell = F.when(at > 0, F.get("__cells", at - 1))
        return F.when(cell != "", cell).try_cast(field.dataType).alias(field.name)

    return cells.select(*keep, "record_index", *[of(f) for f in fields])
