"""Small Column helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.session import work_path

# The white space that separates words, and the letters that are lowered.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def body(text: Column) -> Column:
    """The text, a null as the empty text."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """All runs of ``[^\\x20\\x09-\\x0D]`` in order; none for a null."""
    return F.array_remove(F.split(F.translate(body(text), WHITE[1:], " " * 5), " "), "")


def lowered(text: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def lines(text: Column) -> Column:
    """The text split at ``\\n``; a null or empty text is one empty line."""
    return F.split(body(text), "\n", -1)


def inner(df: DataFrame, *names: str) -> list[str]:
    """Column names for internal use that the input does not have, whatever its columns are called."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        fresh = f"__{name}"
        while fresh.lower() in taken:
            fresh += "_"
        taken.add(fresh.lower())
        out.append(fresh)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its plain name, dots included."""
    return F.col(quoted(name))


def pair_hash(*columns: Column) -> list[Column]:
    """Two independent 64-bit hashes of the columns: together a key of 128 bits."""
    return [F.xxhash64(F.lit(seed), *columns) for seed in (1, 2)]


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame written as a table in the shared folder and read again: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, f"llm-{label}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
