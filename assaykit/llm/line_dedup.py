"""Line dedup: lines that occur in many documents are dropped from all of them.

Two passes of built-in functions. The first counts in how many documents each normalised line
occurs; keys are made distinct within their document before the exchange and counted on the map
side, so a line of a third of all documents costs one row per task. The second finds the positions
of the frequent lines and puts the remaining ones together by position. Lines travel as 128-bit
hashes; a text moves once, when it meets the positions it loses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions.settle import settle

from .common import WHITE, body, col, inner, lines, lowered, pair_hash, stored

MIN_DOCS = 10
MIN_CHARS = 1


def line_keys(text: Column) -> Column:
    """The normalised lines: white space stripped at both ends, A-Z in lower case."""
    return F.transform(F.split(lowered(body(text)), "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)))


def frequent_lines(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The hash pairs (h1, h2) of the keys found in at least ``min_docs`` documents, with that number as n_docs."""
    keys = docs.select(F.explode(F.array_distinct(line_keys(col(text)))).alias("key")).filter(F.length("key") >= min_chars)
    h1, h2 = pair_hash(F.col("key"))
    return (keys.select(h1.alias("h1"), h2.alias("h2")).groupBy("h1", "h2").agg(F.count("*").alias("n_docs"))
            .filter(F.col("n_docs") >= min_docs))


def line_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
               out: tuple[str, str, str] = ("kept_text", "n_lines", "n_dropped")) -> DataFrame:
    """All rows and columns of ``docs`` with the kept text, the number of lines before, and how many were dropped.

    Every row is a document: a repeated row counts again, and both get the same result. A null or
    empty text is one empty line; its key has no characters, so with ``min_chars`` >= 1 it stays.
    Null ids are as good as any. Keys shorter than ``min_chars`` code points are never dropped.
    A column of ``docs`` that is called like a result is replaced. An empty table gives an empty
    table.
    """
    k1, k2, at, lost, all_lines = inner(docs, "k1", "k2", "at", "lost", "lines")
    r1, r2 = pair_hash(col(id), col(text))
    placed = docs.select(r1.alias(k1), r2.alias(k2), col(text).alias("text")).select(
        k1, k2, F.posexplode(line_keys(F.col("text"))).alias(at, "key")).filter(F.length("key") >= min_chars)
    h1, h2 = pair_hash(F.col("key"))
    # a table: its size decides whether it is broadcast; if not, Spark can split the rows of a very frequent line
    hot = stored(frequent_lines(docs, text, min_docs, min_chars).select("h1", "h2"), "frequent-lines")
    dropped = (placed.select(k1, k2, at, h1.alias("h1"), h2.alias("h2")).join(hot, ["h1", "h2"], "left_semi")
               .groupBy(k1, k2).agg(F.collect_set(at).alias(lost)))
    rows = docs.withColumns({k1: r1, k2: r2}).join(dropped, [k1, k2], "left")
    rows = settle(rows, {all_lines: F.when(col(lost).isNotNull(), lines(col(text)))})  # split once, not once for each position
    stays = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), col(lost))
    kept = F.when(col(lost).isNull(), body(col(text))).otherwise(
        F.array_join(F.transform(stays, lambda p: F.get(col(all_lines), p)), "\n"))
    kept_text, n_lines, n_dropped = out
    new = {kept_text: kept, n_lines: (F.length(body(col(text))) - F.length(F.translate(body(col(text)), "\n", "")) + 1).cast("long"),
           n_dropped: F.coalesce(F.size(lost), F.lit(0)).cast("long")}
    keep = [col(c) for c in docs.columns if c.lower() not in {n.lower() for n in out}]
    return rows.select(*keep, *[c.alias(n) for n, c in new.items()])
