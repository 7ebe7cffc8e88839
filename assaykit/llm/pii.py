"""Personal data by bootstrapped contextual extraction.

Base patterns find e-mail addresses, IP addresses, payment cards and phone numbers. They are the
seeds: the words to their left induce lexical patterns, and patterns and the instances they extract
form a bipartite graph, which Spark scores in rounds. A pattern's confidence for a kind is the score
mass of that kind against that mass and the failures: distinct tokens that do not look like the kind
or are seeds of another, and one imagined failure, so that few seeds never make a sure pattern. A
token that looks like the kind but is not known yet is what is to be discovered; the part of it that
has no score counts as a quarter of a failure. An instance's score is the noisy-or of its patterns,
also of those that are not sure yet, and counts in the next round. In the end the sure patterns mark
identifiers that no base pattern matches.

Only built-in functions are used. Distinct instances are counted, not occurrences, so a copied
passage has the weight of one. What leaves the scan of the texts are the few tokens with a digit or
an at sign, with their contexts as hashes; texts do not move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions.settle import settle

from .common import body, col, lowered, pair_hash, stored, words

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
SURE_PATTERN = 0.9
PASSING_PATTERN = 0.5  # patterns from here on pass scores between the rounds
UNKNOWN = 0.25         # failures that a plausible token without a score counts as
#: characters to the left in which the words of a context are looked for
REACH = 80

# The base patterns. Quantifiers are possessive and a run is tried from its start only
# (or from the end of the match before it), which changes no match but keeps long runs linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: a text without these has no valid match, and the pattern is not run
GATES = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9][\x20().0-9-]"}
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
#: an identifier-like token: a word with a digit or an at sign, and the groups of digits that follow it
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+(?:\x20\(?[0-9][0-9().-]*+)*+"
TRAILING = r"[.,;:!?\)\]\}\"'>]+$"
#: what a discovered identifier of a kind looks like
PLAUSIBLE = {
    "email": r"^[^@]+@[^@]+$", "ip": r"^[0-9A-Fa-f]*(?:[.:][0-9A-Fa-f]+){3,}$",
    "card": r"^[0-9][0-9 -]{10,}[0-9]$", "phone": r"^[(+]?[0-9][0-9 ().-]{5,}[0-9]$",
}


def luhn(digits: Column) -> Column:
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int"))))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def placed(text: Column, pattern: str) -> Column:
    """All matches with their places in code points: array of (s, e, m), in order.

    Matches and the text between them come from the same engine, so their lengths add up to places.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(found, between, lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,m:string>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + x["g"]
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(a["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"))

    return F.aggregate(F.filter(pairs, lambda x: x["m"].isNotNull()), start, step, lambda a: a["out"])


def contexts(text: Column, s: Column) -> Column:
    """Hashes of the last word and of the last two words to the left, A-Z in lower case; fewer at the start of a text."""
    near = words(lowered(F.substring(text, F.greatest(s - REACH, F.lit(0)) + 1, F.least(s, F.lit(REACH)))))
    return F.array_compact(F.array(*[F.when(F.size(near) >= n, F.xxhash64(F.lit(n), F.array_join(F.slice(near, -n, n), " "))) for n in (1, 2)]))


def mentions(docs: DataFrame, id: str, text: str) -> DataFrame:
    """One row per row of ``docs``: id, k1, k2, base and more, both arrays of (k, s, e, i, c).

    k is the kind's number (null in more), i the hash of the instance, c its contexts. ``base`` has
    the valid base matches, ``more`` the other identifier-like tokens that touch none of them.
    """
    k1, k2 = pair_hash(F.col("id"), F.col("text"))
    df = settle(docs.select(col(id).alias("id"), body(col(text)).alias("text")), {"k1": k1, "k2": k2})
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    found = {k: F.when(F.col("text").rlike(GATES[k]), placed(F.col("text"), PATTERNS[k])).otherwise(none) for k in KINDS}
    found["more"] = F.when(F.col("text").rlike("[0-9@]"), placed(F.col("text"), CANDIDATE)).otherwise(none)
    df = settle(df, {f"f_{k}": v for k, v in found.items()})

    def of_kind(n: int, k: str) -> Column:
        return F.transform(F.filter(f"f_{k}", lambda x: valid(k, x["m"])), lambda x: F.struct(F.lit(n).alias("k"), x["s"], x["e"], x["m"]))

    df = settle(df, {"typed": F.flatten(F.array(*[of_kind(n, k) for n, k in enumerate(KINDS)]))})

    def described(x: Column, k: Column, e: Column, m: Column) -> Column:
        return F.struct(k.cast("int").alias("k"), x["s"].alias("s"), e.alias("e"), F.xxhash64(lowered(m)).alias("i"), contexts(F.col("text"), x["s"]).alias("c"))

    base = F.transform("typed", lambda x: described(x, x["k"], x["e"], x["m"]))
    trimmed = F.transform("f_more", lambda x: F.struct(x["s"].alias("s"), F.regexp_replace(x["m"], TRAILING, "").alias("m")))
    looks = lambda m: F.array_compact(F.array(*[F.when(m.rlike(PLAUSIBLE[k]), F.lit(n)) for n, k in enumerate(KINDS)]))
    free = F.filter(trimmed, lambda x: (F.length(x["m"]) > 0) & ~F.exists("typed", lambda b: (b["s"] < x["s"] + F.length(x["m"])) & (x["s"] < b["e"])))
    more = F.transform(free, lambda x: F.struct(described(x, F.lit(None), x["s"] + F.length(x["m"]), x["m"]).alias("d"), looks(x["m"]).alias("looks")))
    return df.select("id", "k1", "k2", base.alias("base"), more.alias("more"))


def sure_patterns(edges: DataFrame, seeds: DataFrame, plausible: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Patterns (c, k, confidence) that are sure after scoring the graph in rounds.

    ``edges``: distinct (c, i) of contexts and instances; ``seeds``: distinct (i, k) of base matches;
    ``plausible``: distinct (i, k) of other tokens and the kinds that they look like.
    """
    totals = edges.groupBy("c").agg(F.count("*").alias("total"))
    unknown = plausible.join(seeds.select("i").distinct(), "i", "left_anti")
    kinds = seeds.withColumn("seed", F.lit(True)).unionByName(unknown.withColumn("seed", F.lit(False)))
    graph = stored(edges.join(kinds, "i"), "pii-graph")
    scores = graph.filter("false").select("i", "k", F.lit(0.0).alias("score"))
    for r in range(rounds):
        score = F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0)))
        counted = graph.join(scores, ["i", "k"], "left").withColumn("score", score).groupBy("c", "k").agg(
            F.sum("score").alias("mass"), F.count("*").alias("n"), F.sum(UNKNOWN * (1 - F.col("score"))).alias("open"))
        failures = F.col("total") - F.col("n") + F.col("open") + 1
        confidence = F.round(F.col("mass") / (F.col("mass") + failures), 9)
        patterns = stored(counted.filter(F.col("mass") >= 1).join(totals, "c").select("c", "k", confidence.alias("confidence"))
                          .filter(F.col("confidence") >= (PASSING_PATTERN if r < rounds - 1 else SURE_PATTERN)), "pii-patterns")
        if r == rounds - 1:
            return patterns
        noisy_or = F.round(1 - F.exp(F.sum(F.log(1 - F.col("confidence")))), 9)
        scores = stored(graph.filter(~F.col("seed")).join(patterns, ["c", "k"]).groupBy("i", "k").agg(noisy_or.alias("score")), "pii-scores")


def find_pii(docs: DataFrame, id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: its id, and spans as an array of (k, s, e, added), by kind and start.

    k numbers ``KINDS``; s and e are code points, e exclusive; added tells spans that a pattern
    discovered from base ones. A null or empty text has no spans; null ids are kept; rows that repeat
    an id and text all get the same spans. Base spans of different kinds may overlap, added ones
    touch no base span; where patterns of two kinds add the same token, both spans are given. An
    empty table gives an empty table. Other columns are left out.
    """
    rows = stored(mentions(docs, id, text), "pii-mentions")
    base = rows.select(F.explode("base").alias("x")).select("x.k", "x.i", "x.c")
    more = rows.select("k1", "k2", F.explode("more").alias("x")).select("k1", "k2", "x.looks", "x.d.*")
    edges = stored(base.select(F.explode("c").alias("c"), "i").union(more.select(F.explode("c").alias("c"), "i")).distinct(), "pii-edges")
    plausible = more.select("i", F.explode("looks").alias("k")).distinct()
    patterns = sure_patterns(edges, base.select("i", "k").distinct(), plausible, rounds)
    hits = (more.select("k1", "k2", "s", "e", "looks", F.explode("c").alias("c")).join(patterns.select("c", F.col("k").alias("kind")), "c")
            .filter(F.array_contains("looks", F.col("kind")))
            .groupBy("k1", "k2").agg(F.collect_set(F.struct(F.col("kind").alias("k"), "s", "e", F.lit(True).alias("added"))).alias("hits")))
    own = F.transform("base", lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.lit(False).alias("added")))
    nothing = F.array().cast("array<struct<k:int,s:int,e:int,added:boolean>>")
    spans = F.sort_array(F.concat(own, F.coalesce("hits", nothing)))
    return rows.select("id", "k1", "k2", "base").join(hits, ["k1", "k2"], "left").select(F.col("id").alias(id), spans.alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
