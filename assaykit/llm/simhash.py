"""SimHash near-dedup by anchor-point covering.

Fingerprints within ``THRESHOLD`` bits of each other meet at an anchor. The anchors are the words of
a covering code: two copies of the perfect binary code of length 23, which takes 12 bits of freedom
and covers all words within 3 changed bits, on the first and second 23 bits of the fingerprint (the
last 18 bits are left free). Every fingerprint has exactly one home anchor, within radius 3 in each
half. A partner at most t bits away lies within 3 + t1 and 3 + t2 of that anchor with t1 + t2 <= t.
So each distinct fingerprint is replicated to all anchors whose excess over the covering radius is
at most t in sum: 61 of 16.8 million on average. At each anchor, fingerprints at home are compared
with those that came to visit, in an equi-join; the pair of a smaller and a larger fingerprint meets
exactly once as (home of the smaller, larger), and no pair is missed.

Equal fingerprints are one entry of the join, so copies never meet each other there.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.functions.settle import settle

from .common import body, col, inner, lowered, stored, words
from .components import components

SHINGLE = 3
THRESHOLD = 2
CODE_BITS, RADIUS = 23, 3
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the perfect code of length 23


def shingle_hashes(text: Column, df: DataFrame, name: str) -> DataFrame:
    """Adds the XXH64 hashes (seed 42) of all shingles; a text with fewer words is one shingle, without words none."""
    (w,) = inner(df, "w")
    df = settle(df, {w: words(lowered(body(text)))})
    many = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE),
                       lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(w, i + j) for j in range(SHINGLE)])))
    one = F.array(F.xxhash64(F.concat_ws(" ", w)))
    hashes = F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < SHINGLE, one).otherwise(many)
    return df.withColumn(name, hashes).drop(w)


@F.arrow_udf(T.LongType())
def majority(hashes: pa.Array) -> pa.Array:
    """A bit is 1 if it is set in over half of a row's hashes; 0 without hashes."""
    starts = hashes.offsets.to_numpy()
    n = np.diff(starts)
    values = hashes.values.to_numpy(zero_copy_only=False).view(np.uint64)[: starts[-1]]
    full = n > 0
    out = np.zeros(len(n), np.uint64)
    if full.any():
        at = starts[:-1][full]
        for bit in range(64):
            ones = np.add.reduceat(((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), at)
            out[full] |= (2 * ones > n[full]).astype(np.uint64) << np.uint64(bit)
    return pa.array(out.view(np.int64))


@functools.cache
def code_tables(threshold: int) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """Syndromes of the 23-bit words' low and high parts, and for each syndrome its error words by excess over the radius.

    A word differs from a code word by exactly the error words of its syndrome; those of weight up to
    3 are unique (the code is perfect), those of weight 3 + e are the anchors at excess e.
    """
    def remainder(x: np.ndarray) -> np.ndarray:
        for bit in range(CODE_BITS - 1, 10, -1):
            x = np.where(x >> bit & 1, x ^ (GENERATOR << (bit - 11)), x)
        return x

    table = remainder(np.arange(1 << CODE_BITS, dtype=np.int64)).astype(np.int16)
    by_excess: list[list[list[int]]] = [[[] for _ in range(1 << 11)] for _ in range(threshold + 1)]
    for weight in range(RADIUS + threshold + 1):
        for places in combinations(range(CODE_BITS), weight):
            word = sum(1 << p for p in places)
            by_excess[max(0, weight - RADIUS)][table[word]].append(word)
    return table, [[np.array(w, np.int64) for w in rows] for rows in by_excess]


def anchors_of(fingerprint: int, threshold: int = THRESHOLD) -> np.ndarray:
    """The home anchor first, then all others that the fingerprint visits."""
    table, by_excess = code_tables(threshold)
    mask = (1 << CODE_BITS) - 1
    low, high = fingerprint & mask, fingerprint >> CODE_BITS & mask
    near = [[low ^ w for w in (rows[table[low]] for rows in by_excess)], [high ^ w for w in (rows[table[high]] for rows in by_excess)]]
    return np.concatenate([((near[1][b][:, None] << CODE_BITS) | near[0][a][None, :]).ravel()
                           for a in range(threshold + 1) for b in range(threshold + 1 - a)])


@F.arrow_udf(T.ArrayType(T.LongType()))
def anchors(fingerprints: pa.Array) -> pa.Array:
    rows = [anchors_of(x) for x in fingerprints.to_numpy(zero_copy_only=False).tolist()]
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(flat))


def fingerprint_links(fingerprints: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints (column f, no repeats) that differ in at most ``THRESHOLD`` bits."""
    at = stored(fingerprints.select("f", anchors("f").alias("at")), "simhash-anchors")
    home = at.select(F.get("at", F.lit(0)).alias("anchor"), F.col("f").alias("a"))
    visits = at.select(F.explode("at").alias("anchor"), F.col("f").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= THRESHOLD
    return home.join(visits, (home.anchor == visits.anchor) & (F.col("a") < F.col("b")) & near).select("a", "b")


def simhash_classes(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, f, component_id): one row per row of ``docs``; a class is what links of fingerprints reach.

    A null text counts as empty: without words the fingerprint is zero and links like any other.
    component_id is the smallest id reachable; null ids are skipped for it, so it is null only if a
    class has no other. Repeated rows are linked, as their fingerprints are equal. An empty table
    gives an empty table.
    """
    df = shingle_hashes(F.col("text"), docs.select(col(id).alias("id"), col(text).alias("text")), "h").select("id", "h")
    rows = stored(df.select("id", majority("h").alias("f")), "simhash-fingerprints")
    classes = rows.groupBy("f").agg(F.min("id").alias("least"))
    roots = components(fingerprint_links(classes.select("f")))
    rooted = classes.join(roots, F.col("f") == F.col("node"), "left").select("f", "least", F.coalesce("root", "f").alias("root"))
    rooted = stored(rooted, "simhash-classes")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.join(least, "root").select("f", "component_id")
    return rows.join(by_print, "f").select("id", "f", "component_id")


def near_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each class the document with the smallest id.

    Rows that repeat that id all stay if they are the class's smallest (they cannot be told apart);
    documents without an id stay only if their class has no other, each of them.
    """
    (keep,) = inner(docs, "keep")
    rows = simhash_classes(docs, id, text)
    stay = rows.filter(F.col("id") == F.col("component_id")).select(F.col("id").alias(keep)).distinct()
    alone = rows.filter("component_id is null").limit(1).count()
    kept = docs.join(stay, col(id) == col(keep), "left_semi")
    if alone:
        f = rows.filter("component_id is null").select(F.col("f").alias(keep)).distinct()
        (mine,) = inner(docs, "f")
        (h,) = inner(docs, "h")
        nulls = shingle_hashes(col(text), docs.filter(col(id).isNull()), h).withColumn(mine, majority(h)).drop(h)
        kept = kept.unionByName(nulls.join(f, col(mine) == col(keep), "left_semi").drop(mine))
    return kept
