"""Pages by cursor: the rows after the last one seen, however deep, for the price of the first page."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def _key(name: str) -> tuple[str, bool]:
    """(column, descending); a leading minus asks for descending order."""
    return (name[1:], True) if name.startswith("-") else (name, False)


def _beyond(column: Column, value: Any, descending: bool) -> Column:
    """Whether a value comes after the cursor's; nulls are the smallest."""
    if descending:
        return F.lit(False) if value is None else column.isNull() | (column < F.lit(value))
    return column.isNotNull() if value is None else column > F.lit(value)


def after(order: list[str], cursor: dict[str, Any]) -> Column:
    """The rows behind the cursor in the order of the columns, as a filter that scans can use."""
    steps, equal = [], F.lit(True)
    for name, descending in map(_key, order):
        column, value = F.col(f"`{name}`"), cursor[name]
        steps.append(equal & _beyond(column, value, descending))
        equal = equal & (column.isNull() if value is None else column == F.lit(value))
    # rows before the first key are out, said once more so that files and row groups can be skipped
    name, descending = _key(order[0])
    value, column = cursor[name], F.col(f"`{name}`")
    if value is not None:
        steps = [reduce(lambda a, b: a | b, steps) & ((column <= F.lit(value)) | column.isNull() if descending else column >= F.lit(value))]
    return reduce(lambda a, b: a | b, steps)


def seek(df: DataFrame, order: list[str], limit: int, cursor: dict[str, Any] | Row | None = None) -> DataFrame:
    """The next ``limit`` rows behind ``cursor`` (a row, or the values of the ordering columns), or the first ones.

    ``order`` names columns, ``-name`` for descending; nulls come first (last where descending). Together they must
    tell all rows apart: rows equal in all of them and cut by a page's end would be left out. Each task
    hands on at most ``limit`` rows, on every page.
    """
    rows = df if cursor is None else df.filter(after(order, cursor.asDict() if isinstance(cursor, Row) else cursor))
    sort = [F.col(f"`{n}`").desc_nulls_last() if down else F.col(f"`{n}`").asc_nulls_first() for n, down in map(_key, order)]
    return rows.orderBy(*sort).limit(limit)


def pages(df: DataFrame, order: list[str], limit: int) -> Iterator[list[Row]]:
    """All pages one after the other; the driver holds one."""
    cursor = None
    while page := seek(df, order, limit, cursor).collect():
        yield page
        cursor = page[-1]
