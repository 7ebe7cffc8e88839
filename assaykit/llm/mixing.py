"""Mixing sources to target weights by capped water-filling.

The mix is as large as all sources together. Each source gets its weight's share; a source that
would be read more than ``max_epochs`` times is clamped there and what it cannot take is shared out
among the others by weight, until none is above. A source read r times takes every document
floor(r) times; the remaining fraction is sampled: documents in the order of a seeded hash until the
next one does not fit, then again those that fit what is left, and at last the one document that
comes nearest to what is still missing.

A document's decision follows from its own hash and a few numbers of its source, so texts never
move for it. The prefix sums along the seeded order are taken over hash slices: sums per source and
slice first, then only the one slice of each source in which a pass ends is sorted. A source
with a third of all rows is no larger task than any other.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, stored, words

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 7
#: how often the remainder of a fraction is filled anew, each time by documents that are no larger than it
PASSES = 3
#: sources up to which the plan of the mix is broadcast
BROADCAST_SOURCES = 50_000


def source_key(source: Column) -> Column:
    """A text key of a source; the key of null is greater than that of any name."""
    return F.coalesce(F.concat(F.lit("a"), source.cast("string")), F.lit("b"))


def cyclic_weights(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds weight: sources by code point, null last, weigh ``weights`` in turn.

    ``sources`` has one row per source, pre-aggregated; only this list of names is put in order.
    """
    turn = (F.row_number().over(Window.orderBy("src")) - 1) % len(weights)
    return sources.withColumn("weight", F.get(F.array(*[F.lit(w).cast("long") for w in weights]), turn))


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds target to a stored table of (src, size, weight).

    Each round is one aggregate over the sources: the words that are left and the weights that share
    them. Whole numbers are summed, so the result does not depend on the order. A source without
    words takes none. A clamped source stays clamped, as the level only rises; the rounds end when no
    further one is.
    """
    total = sources.agg(F.sum("size")).first()[0] or 0
    wide, cap = (lambda c: c.cast("decimal(38,0)")), F.col("size") * max_epochs
    share, clamped = None, -1
    while True:
        above = F.col("size") == 0
        if share:
            above |= wide(F.col("weight")) * F.lit(Decimal(share[0])) >= wide(cap) * F.lit(Decimal(share[1]))
        row = sources.agg(F.count_if(above).alias("n"), F.sum(F.when(above, cap).otherwise(0)).alias("held"),
                          F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("weight")).first()
        if row["n"] == clamped or not row["weight"]:
            break
        clamped, share = row["n"], (total - row["held"], row["weight"])
    if not share:
        return sources.withColumn("target", F.lit(0.0))
    level = F.col("weight").cast("double") * float(share[0]) / float(share[1])
    return sources.withColumn("target", F.when(F.col("size") == 0, 0.0).otherwise(F.least(level, cap.cast("double"))))


def taken(passes: int) -> Column:
    """Whether the fraction of a source takes a document: it fits a pass and lies before its cut in the seeded order."""
    part, me, found = F.substring("key", 1, 3), F.struct("key", "id", "size"), F.lit(False)
    for i in range(passes):
        p = F.col(f"pass{i}")
        inside = (part < p["slice"]) | ((part == p["slice"]) & p["cut"].isNotNull() & (me <= p["cut"]))
        found |= F.coalesce(inside & (F.col("size") <= p["limit"]), F.lit(False))
    return found


def mix_plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: its size, target, whole repeats, the cuts of the seeded order and the last document.

    ``sized`` is a stored table with src, key (seeded hash), id and size, one row per document.
    """
    sources = stored(cyclic_weights(sized.groupBy("src").agg(F.sum("size").alias("size")), weights), "mix-sources")
    small = F.broadcast if sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else (lambda df: df)
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("long")
    plan = water_fill(sources, max_epochs).withColumn("whole", whole).select(
        "src", F.col("size").alias("source_size"), "target", "whole", (F.col("target") - F.col("whole") * F.col("size")).alias("rest"))
    sliced = sized.withColumn("slice", F.substring("key", 1, 3))
    run = Window.partitionBy("src").orderBy("slice")  # 4096 sums of a source at most
    # ties share a sum: documents with equal key, id and size share one decision
    inside = Window.partitionBy("src").orderBy("key", "id", "size")
    for i in range(PASSES):
        goal = small(plan.select("src", "rest", *[f"pass{k}" for k in range(i)]).filter("rest > 0"))
        free = sliced.join(goal, "src").filter(~taken(i) & (F.col("size") <= F.col("rest")) if i else F.lit(True))
        sums = (free.groupBy("src", "slice", "rest").agg(F.sum("size").alias("words"))
                .withColumn("before", F.sum("words").over(run) - F.col("words")))
        ends = sums.groupBy("src", "rest").agg(
            F.max(F.when(F.expr("before <= rest and rest < before + words"), F.struct("slice", "before"))).alias("end"), F.sum("words").alias("total"))
        # "~" follows every hexadecimal digit: all that fit are taken
        ends = ends.select("src", "rest", F.coalesce("end.slice", F.lit("~")).alias("slice"), F.coalesce("end.before", "total").alias("before"))
        upto = F.col("before") + F.sum("size").over(inside)
        within = free.select("src", "slice", "key", "id", "size").join(small(ends), ["src", "slice"]).withColumn("upto", upto).filter("upto <= rest")
        cut = within.groupBy("src").agg(F.max(F.struct("key", "id", "size")).alias("cut"), F.max("upto").alias("upto"))
        step = ends.drop("rest").join(cut, "src", "left").select(
            "src", F.coalesce("upto", "before").alias("got"), F.struct("slice", "cut").alias("p"))
        limit = F.col("rest") if i else F.lit(float("inf"))
        plan = stored(plan.join(step, "src", "left").withColumn(f"pass{i}", F.when(F.col("p").isNotNull(), F.struct("p.slice", "p.cut", limit.alias("limit"))))
                      .withColumn("rest", F.col("rest") - F.coalesce("got", F.lit(0))).drop("p", "got"), "mix-plan")
    # the document nearest to what is missing, if nearer than taking none; ties by the seeded order
    gap = F.abs(F.col("size") - F.col("rest"))
    last = (sized.join(small(plan.filter("rest > 0")), "src").filter(~taken(PASSES) & (gap < F.col("rest")))
            .groupBy("src").agg(F.min(F.struct(gap.alias("gap"), "key", "id", "size")).alias("last")))
    return small(stored(plan.join(last, "src", "left").drop("rest"), "mix-plan"))


def seeded_key(id: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id.cast("string"), F.lit(""))))


def decided(docs: DataFrame, id: str, text: str, source: str, weights: tuple[int, ...], max_epochs: int, seed: int) -> DataFrame:
    """The rows of ``docs`` as a struct doc, with size, source_size, target and repeats."""
    base = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("doc"), source_key(col(source)).alias("src"), col(id).alias("id"),
                       F.size(words(col(text))).cast("long").alias("size"), seeded_key(col(id), seed).alias("key"))
    plan = mix_plan(stored(base.select("src", "id", "size", "key"), "mix-sizes"), weights, max_epochs)
    is_last = (F.col("key") == F.col("last.key")) & F.col("id").eqNullSafe(F.col("last.id")) & (F.col("size") == F.col("last.size"))
    extra = taken(PASSES) | F.coalesce(is_last, F.lit(False))
    return base.join(plan, "src").select("doc", "size", "source_size", "target", (F.col("whole") + extra.cast("long")).alias("repeats"))


def mix_sources(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
                max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """All rows and columns of ``docs`` with size, source_size, target, repeats and taken.

    ``size`` counts words, ``repeats`` how often the mix reads the whole document, ``taken`` is size
    times repeats. A null text has size 0, a null source is a source of its own. Rows of one source
    with equal id and size share the decision of the fraction, so repeated rows are all in or all
    out. A source without words takes none: its repeats are 0. An empty table gives an empty table.
    Columns of ``docs`` called like a result are replaced. Runs agree for equal inputs, whatever the
    partitions.
    """
    results = {"size", "source_size", "target", "repeats", "taken"}
    rows = decided(docs, id, text, source, weights, max_epochs, seed)
    return rows.select(*[F.col("doc")[c].alias(c) for c in docs.columns if c.lower() not in results],
                       "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def mixed(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
          max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: each document as often as the mix reads it, with the columns of ``docs``."""
    rows = decided(docs, id, text, source, weights, max_epochs, seed).filter("repeats > 0")
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))
    return rows.select("doc", again.alias("n")).select(*[F.col("doc")[c].alias(c) for c in docs.columns])
