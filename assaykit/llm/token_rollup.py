"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums of signed deltas: an inserted document
adds its count, a deleted one takes it away, a revised one takes the old count and adds the new.
Each batch of deltas is reduced to one row per key (combined on the map side, so a source with a
third of all rows costs one row per task and language) and written under a fresh name; a small commit
file then makes it the batch's only one. So a batch that is delivered again replaces itself, one that
dies half-way changes nothing, and a reader always sees whole batches. Reading the totals sums the
partial rows of all batches: documents are counted once, never again.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.sources.tables import Tables

from .common import body, col, words

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"
BATCH, TABLE = "batch", "rollup"
#: runs of letters and digits (all beyond ASCII count as such), every other visible character by itself
PIECES = r"[A-Za-z0-9\x{80}-\x{10FFFF}]+|[^A-Za-z0-9\x{80}-\x{10FFFF}\x20\x09-\x0D]"


def count_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def count_pieces(text: Column) -> Column:
    return F.regexp_count(body(text), F.lit(PIECES)).cast("long")


#: tokenizer version -> count of a text's tokens
TOKENIZERS = {"words-1": count_words, "pieces-1": count_pieces}


def counted(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang",
            revised: Column | None = None, tokenizers: dict[str, Callable[[Column], Column]] = TOKENIZERS) -> DataFrame:
    """(id, source, lang, counts): a document's tokens by tokenizer version, as array of (tokenizer, n).

    A null text has no tokens but is a document; null sources and languages are keys of their own, and
    rows that repeat or have no id are documents like any other. ``revised``, an expression over the
    columns of ``docs``, is the text after a revision: then ``new`` holds its counts, or null where the
    text stays. Old and new counts are in one row, so no row has to find its revision by an id.
    ``tokenizers`` maps a version to its count of a text; a vocabulary's counts (``token_digests``) can be
    given as a column of ``docs``: ``{"bpe-50k": lambda text: F.col("n_tokens")}``.
    """
    def counts(of: Column) -> Column:
        return F.array(*[F.struct(F.lit(v).alias("tokenizer"), count(of).cast("long").alias("n")) for v, count in tokenizers.items()])

    rows = [col(id).alias("id"), col(source).cast("string").alias("source"), col(lang).cast("string").alias("lang"), counts(col(text)).alias("counts")]
    if revised is not None:
        rows.append(F.when(~revised.eqNullSafe(col(text)), counts(revised)).alias("new"))
    return docs.select(*rows)


def signed(rows: DataFrame, sign: int) -> DataFrame:
    """Deltas of counted documents that come (sign 1) or go (sign -1); of a revision both are given."""
    each = rows.select("source", "lang", F.inline("counts"))
    return each.select(*KEYS, F.lit(sign).cast("long").alias("docs"), (F.col("n") * sign).alias("tokens"))


def commit(deltas: DataFrame, root: str, batch: str) -> None:
    """Adds a batch to the totals under ``root``; a batch of that name that is there already is replaced, in one step.

    Rows that repeat count as often as they are there. An empty batch adds nothing.
    """
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
        raise ValueError("a batch is named by letters, digits, '_', '.' and '-'")
    sums = deltas.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
    Tables(deltas.sparkSession, root, key=BATCH).replace({TABLE: sums.withColumn(BATCH, F.lit(batch))}, [batch])


def totals(spark: SparkSession, root: str) -> DataFrame:
    """The totals after all committed batches, none before the first; keys whose documents and tokens have all gone are left out."""
    tables = Tables(spark, root, key=BATCH)
    rows = tables.read(TABLE) if tables.version() else spark.createDataFrame([], SCHEMA)
    return (rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            .filter("n_docs <> 0 or n_tokens <> 0"))
