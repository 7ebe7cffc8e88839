"""Quality classifier by co-training on two views of a document.

One view is the text's content, the other the page's metadata. Each has a naive Bayes model over
binned features, sources and languages, so fitting is counting: one grouped count per round over
labelled and confidently pseudo-labelled documents, whose result has one row per feature and key. In each round a
view's confident scores on unlabelled documents become labels of the other view. Labelled documents
of one fold are kept apart: they calibrate each view's score (monotone smoothed rates), and the
calibrated views are combined as independent evidence to score all documents.

Texts are read once, rounds run over a table of bins. Odds of bins are literals; those of sources and
languages are tables, each source with its own row, joined back.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, body, col, stored, words
from .quality_rules import FEATURES, stratum_of, with_features

ROUNDS = 3
#: log odds from which a view's score on an unlabelled document is a pseudo-label
CONFIDENT = 3.0
#: one of so many folds of the labelled documents calibrates
FOLDS = 5
LIMIT = 12
KEPT_FROM = 0.5

#: content feature -> (expression over counts, upper ends of bins)
CONTENT = {
    "symbols": ("n_symbols / n_words", (0.0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8, 1.6)),
    "repetition": ("n_repeat_words / n_words", (0.0, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)),
    "dup_lines": ("n_dup_lines / n_text_lines", (0.0, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7)),
    "word_length": ("word_chars / n_words", (2.0, 3.0, 4.0, 4.5, 5.0, 5.5, 6.0, 7.0, 8.0, 10.0)),
    "capitals": ("n_capitals / word_chars", (0.0, 0.01, 0.02, 0.03, 0.05, 0.1, 0.3, 0.6)),
    "digits": ("n_digits / word_chars", (0.0, 0.005, 0.02, 0.05, 0.1, 0.3)),
    "variety": ("n_distinct / n_words", (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)),
}
METADATA = ("source", "lang", "length")
#: features with any number of keys, whose odds stay tables
TABLES = ("source", "lang")
#: size up to which such a table is broadcast
BROADCAST_BYTES = 16 << 20


def bin_of(value: Column, ends: tuple[float, ...]) -> Column:
    """Number of ends that lie below the value; a bin of its own for a value that is not there."""
    below = sum((F.when(value > e, 1).otherwise(0) for e in ends), F.lit(0))
    return F.when(value.isNull(), F.lit(len(ends) + 1)).otherwise(below).cast("int")


def binned(docs: DataFrame, id: str, text: str, source: str, lang: str) -> DataFrame:
    """id, the bins of the content view as array<int>, and the metadata view: source, lang (keys, nulls included) and length (a bin)."""
    lean = docs.select(col(id).alias("id"), col(text).alias("text"), stratum_of(col(source)).alias("source"), stratum_of(col(lang)).alias("lang"))
    plain = body(F.col("text"))
    counts = with_features(lean, "text", {f: f for f in FEATURES}).select(
        "id", "source", "lang", *FEATURES,
        (F.length(plain) - F.length(F.translate(plain, UPPER, ""))).alias("n_capitals"),
        (F.length(plain) - F.length(F.translate(plain, "0123456789", ""))).alias("n_digits"),
        F.size(F.array_distinct(words(F.col("text")))).alias("n_distinct"),
        F.when(F.col("text").isNotNull(), F.length(plain)).alias("length"))

    def ratio(text: str) -> Column:
        over, under = text.split(" / ")
        return F.when(F.col(under) > 0, F.col(over) / F.col(under))

    doubling = F.when(F.col("length").isNull(), 0).otherwise(1 + F.floor(F.log2(F.col("length") + 1)))
    return counts.select("id", F.array(*[bin_of(ratio(e), ends) for e, ends in CONTENT.values()]).alias("content"),
                         "source", "lang", doubling.cast("int").alias("length"))


def cells(view: str) -> list[Column]:
    """The (feature, key) of a document in each feature of a view."""
    if view == "content":
        keys = {f: F.get("content", n).cast("string") for n, f in enumerate(CONTENT)}
    else:
        keys = {f: F.col(f).cast("string") for f in METADATA}
    return [F.struct(F.lit(f).alias("feature"), k.alias("key")) for f, k in keys.items()]


def fit(rows: DataFrame, labels: dict[str, Column]) -> DataFrame:
    """(feature, key, odds): naive Bayes log odds of both views, from counts smoothed by one.

    ``labels`` has each view's own labels. A feature that met one class only has no odds.
    """
    seen = [F.struct(c["feature"].alias("feature"), c["key"].alias("key"), y.alias("y")) for v, y in labels.items() for c in cells(v)]
    counts = stored(rows.select(F.explode(F.array(*seen)).alias("x")).select("x.*").filter("y is not null").groupBy("feature", "key").agg(
        F.count_if(F.col("y") == 1).alias("good"), F.count_if(F.col("y") == 0).alias("bad")), "cotrain-counts")
    sums = counts.groupBy("feature").agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"), F.count("*").alias("n"))
    rate = lambda n, of: F.log((F.col(n) + 1) / (F.col(of) + F.col("n")))
    odds = F.round(rate("good", "all_good") - rate("bad", "all_bad"), 9)
    both = F.broadcast(sums.filter("all_good > 0 and all_bad > 0"))  # one row per feature
    return stored(counts.join(both, "feature").select("feature", "key", odds.alias("odds")), "cotrain-odds")


def scored(rows: DataFrame, odds: DataFrame) -> DataFrame:
    """``rows`` with each view's log odds, s_content and s_metadata; what the model has not met says nothing.

    Odds of binned features become literals. Those of sources and languages, of which there may be
    any number, are joined back as tables.
    """
    literal: dict[str, list[Column]] = {}
    for r in odds.filter(~F.col("feature").isin(*TABLES)).orderBy("feature", "key").collect():  # bins are bounded
        literal.setdefault(r["feature"], []).extend((F.lit(r["key"]), F.lit(r["odds"])))
    sizes = {r["feature"]: r["size"] for r in odds.filter(F.col("feature").isin(*TABLES)).groupBy("feature").agg(
        F.sum(F.octet_length("key") + 32).alias("size")).collect()}
    for f in TABLES:
        table = odds.filter(F.col("feature") == f).select(F.col("key").alias(f), F.col("odds").alias(f"odds_{f}"))
        rows = rows.join(F.broadcast(table) if sizes.get(f, 0) <= BROADCAST_BYTES else table, f, "left")

    def part(cell: Column, feature: str) -> Column:
        if feature in TABLES:
            return F.coalesce(f"odds_{feature}", F.lit(0.0))
        pairs = literal.get(feature)
        return F.coalesce(F.try_element_at(F.create_map(*pairs), cell["key"]), F.lit(0.0)) if pairs else F.lit(0.0)

    def total(view: str, features: Iterable[str]) -> Column:
        summed = sum((part(c, f) for c, f in zip(cells(view), features, strict=True)), F.lit(0.0))
        return F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), summed))

    return rows.withColumns({"s_content": total("content", CONTENT), "s_metadata": total("metadata", METADATA)}).drop(*[f"odds_{f}" for f in TABLES])


def calibrated(rows: DataFrame, view: Column, prior: float) -> list[float]:
    """Log odds of good for each whole score from -LIMIT to LIMIT, rising; from labelled documents not used to fit."""
    found = {r["s"]: (r["n"], r["good"]) for r in rows.select(F.round(view).cast("int").alias("s"), "label").groupBy("s").agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("good")).collect()}  # 2 * LIMIT + 1 rows at most
    blocks: list[list[float]] = []
    for s in range(-LIMIT, LIMIT + 1):
        n, good = found.get(s, (0, 0))
        # a score without documents stands for itself, with the weight of one document
        expected = 1 / (1 + math.exp(-(s + math.log(prior / (1 - prior)))))
        blocks.append([good + expected, n + 1, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            good_, n_, size = blocks.pop()
            blocks[-1] = [blocks[-1][0] + good_, blocks[-1][1] + n_, blocks[-1][2] + size]
    rates = [b[0] / b[1] for b in blocks for _ in range(int(b[2]))]
    return [round(math.log(r / (1 - r)), 9) for r in rates]


def classify(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang",
             rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: id, p_content, p_metadata, score (probabilities of good) and kept.

    Labels that are null, or that differ between rows of one id, are left out; rows with equal ids
    are labelled alike and folds follow the id, so copies of a row stay in one fold. Without labels
    of both classes nothing is learnt: all scores are 0.5 and all documents are kept. Null and empty
    texts, null sources and languages have bins of their own. An empty table gives an empty table.
    Other columns are left out.
    """
    bins = stored(binned(docs, id, text, source, lang), "cotrain-bins")
    agreed = (labels.select(col("doc_id").alias("id"), col("quality").alias("q")).filter("q is not null and id is not null")
              .groupBy("id").agg(F.min("q").alias("lo"), F.max("q").alias("hi")).filter("lo = hi and lo in (0, 1)").select("id", F.col("lo").alias("label")))
    rows = stored(bins.join(agreed, "id", "left").withColumn("fold", F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(FOLDS))), "cotrain-rows")
    count = rows.filter("label is not null").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("good")).first()
    if not 0 < count["good"] < count["n"]:
        half = F.lit(0.5)
        return rows.select(F.col("id").alias(id), half.alias("p_content"), half.alias("p_metadata"), half.alias("score"), F.lit(True).alias("kept"))
    prior = count["good"] / count["n"]
    train = F.when((F.col("fold") > 0) & F.col("label").isNotNull(), F.col("label"))
    judged, labels_of = rows, {"content": train, "metadata": train}
    for _ in range(rounds):
        # both models are fitted on the labels that the other one gave in the round before
        judged = scored(rows, fit(judged, labels_of))
        pseudo = {v: F.when(F.col("label").isNull() & (F.col(f"s_{v}") >= CONFIDENT), 1).when(
            F.col("label").isNull() & (F.col(f"s_{v}") <= -CONFIDENT), 0) for v in labels_of}
        labels_of = {"content": F.coalesce(train, pseudo["metadata"]), "metadata": F.coalesce(train, pseudo["content"])}
    held = judged.filter("label is not null and fold = 0")
    log_odds = {}
    for v in labels_of:
        table = calibrated(held, F.col(f"s_{v}"), prior)
        log_odds[v] = F.get(F.array(*[F.lit(x) for x in table]), F.round(f"s_{v}").cast("int") + LIMIT)
    joint = log_odds["content"] + log_odds["metadata"] - F.lit(round(math.log(prior / (1 - prior)), 9))
    p = lambda x: F.round(1 / (1 + F.exp(-x)), 9)
    return judged.select(F.col("id").alias(id), p(log_odds["content"]).alias("p_content"), p(log_odds["metadata"]).alias("p_metadata"),
                       p(joint).alias("score"), (p(joint) >= KEPT_FROM).alias("kept"))
