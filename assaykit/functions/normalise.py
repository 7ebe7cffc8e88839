"""Field normalisers of the static customer record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V


def identifier(value: Column) -> Column:
    """Trimmed and upper-cased; null when nothing is left."""
    text = F.upper(F.trim(value))
    return F.when(F.length(text) > 0, text)


def person_name(value: Column) -> Column:
    """Trimmed; null when nothing is left."""
    text = F.trim(value)
    return F.when(F.length(text) > 0, text)


def postal(value: Column) -> Column:
    """Trimmed; null when shorter than three characters."""
    text = F.trim(value)
    return F.when(F.length(text) >= 3, text)


def boolean_like(value: Column) -> Column:
    """``true``/``false`` for the words that mean it, any other text as it is."""
    word = F.lower(F.trim(value))
    return F.when(word.isin(V.TRUE_WORDS), "true").when(word.isin(V.FALSE_WORDS), "false").otherwise(value)


def segment(value: Column) -> Column:
    """Trimmed, every word capitalised."""
    return F.initcap(F.trim(value))


def segment_known(value: Column) -> Column:
    return segment(value).isin(V.SEGMENTS)
