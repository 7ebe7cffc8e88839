"""Compute columns once, whatever reads them later."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns behind a one-element ``inline``.

    Catalyst copies the definition of a projected column into the filters it pushes down. For a
    column that many others read this multiplies patterns and casts until the generated code no
    longer compiles. A filter does not move below a generator, so the columns stay computed once;
    the generator itself is part of whole-stage code generation and moves no rows.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def sql_text(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


BITS = 60


def note_failures(df: DataFrame, checks: list[tuple[Column, str]], name: str, flag: str | None = None) -> DataFrame:
    """Adds the texts of the failed checks as an array, and whether there are none as ``flag``.

    The outcome of all checks is one number per sixty of them; arrays are built only for records
    that fail something.
    """
    words = [checks[i:i + BITS] for i in range(0, len(checks), BITS)]
    masks = {
        f"__{name}_{w}": reduce(lambda a, b: a.bitwiseOR(b), [
            F.when(cond, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, (cond, _) in enumerate(word)])
        for w, word in enumerate(words)
    }
    clear = " AND ".join(f"`{m}` = 0" for m in masks) or "true"
    texts = ", ".join(
        f"IF(`__{name}_{w}` & {1 << i}L != 0, {sql_text(text)}, NULL)" for w, word in enumerate(words) for i, (_, text) in enumerate(word))
    found = F.expr(f"IF({clear}, CAST(array() AS array<string>), array_compact(array({texts})))")
    marked = settle(df, masks) if masks else df
    return marked.select(*[F.col(f"`{c}`") for c in df.columns], found.alias(name), *([F.expr(clear).alias(flag)] if flag else []))
