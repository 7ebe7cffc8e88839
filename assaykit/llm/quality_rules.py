"""Quality rules with risk-controlled thresholds.

Each document gets a few counts. A base rule rejects what is too short or mostly repetition. Three
ratio rules follow, whose cutoffs are chosen from labelled documents, separately in each stratum:
cutoffs are tried from the most lenient to the strictest, and a cutoff is certified while the exact
binomial test rejects "more than this rule's part of ``alpha`` of good documents would be lost" at
level ``delta`` divided by the number of strata and rules (Bonferroni). Testing in a fixed order and
stopping at the first failure needs no correction for the number of cutoffs. The rules share
``alpha`` evenly, so with probability 1 - ``delta`` all of them together lose no more than ``alpha``
of the good documents that the base rule passes, in any stratum. Among certified cutoffs the one
that rejects the most bad documents net of good ones is used; a rule without such gain is off.

Only built-in functions are used. The labelled documents are reduced to one row per stratum, rule
and cutoff with counts before anything is decided.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.functions.settle import settle

from .common import WHITE, body, col, inner, lines, stored, words

MIN_WORDS = 50
MAX_REPEATED = 50  # percent of the words
ALPHA = 0.02       # share of good documents that all ratio rules together may lose in a stratum
DELTA = 0.05       # probability that they break that promise in any stratum
SYMBOLS = "#*$%&|<>"
#: rule -> (numerator, denominator, cutoffs per thousand from lenient to strict); beyond the cutoff a document is rejected
RULES = {
    "symbols": ("n_symbols", "n_words", (2000, 1000, 700, 500, 400, 300, 250, 200, 150, 100, 70, 50)),
    "dup_lines": ("n_dup_lines", "n_text_lines", (900, 800, 700, 600, 500, 400, 300, 250, 200)),
    "repetition": ("n_repeat_words", "n_words", (480, 450, 400, 350, 300, 250, 200, 150)),
}
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_text_lines")
#: strata up to which the chosen cutoffs are broadcast
BROADCAST_STRATA = 10_000
#: labelled ids up to which they are broadcast to leave other documents out before cutoffs are chosen
BROADCAST_LABELS = 500_000


def with_features(docs: DataFrame, text: str, names: dict[str, str]) -> DataFrame:
    """``docs`` with the counts of ``FEATURES`` under the given names.

    Words covered by a repeated window of three: the windows' hashes are sorted with their
    positions, equal neighbours are repeats, and a repeated window adds the words that the one
    before it (by position) did not cover.
    """
    w, split, grams, ranked, at = inner(docs, "words", "lines", "grams", "ranked", "at")
    plain = body(col(text))
    df = settle(docs, {w: words(col(text)), split: F.filter(lines(col(text)), lambda x: F.btrim(x, F.lit(WHITE)) != "")})
    windows = F.sequence(F.lit(0), F.size(w) - 3)
    df = settle(df, {grams: F.when(F.size(w) > 3, F.transform(windows, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))})
    repeats = F.size(F.array_distinct(grams)) < F.size(grams)
    df = settle(df, {ranked: F.when(repeats, F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))})
    same = lambda x, j: F.coalesce(F.get(ranked, j)["h"] == x["h"], F.lit(False))
    hits = F.filter(ranked, lambda x, j: F.when(j > 0, same(x, j - 1)).otherwise(F.lit(False)) | same(x, j + 1))
    df = settle(df, {at: F.sort_array(F.transform(hits, lambda x: x["i"]))})
    covered = F.aggregate(F.transform(at, lambda p, j: F.when(j == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get(at, j - 1)))),
                          F.lit(0), lambda a, x: a + x)
    long = {
        "n_words": F.size(w), "word_chars": F.length(F.translate(plain, WHITE, "")),
        "n_symbols": F.length(plain) - F.length(F.translate(plain, SYMBOLS, "")),
        "n_dup_lines": F.size(split) - F.size(F.array_distinct(split)),
        "n_repeat_words": F.coalesce(covered, F.lit(0)), "n_text_lines": F.size(split),
    }
    keep = [col(c) for c in docs.columns]
    return df.select(*keep, *[long[f].cast("long").alias(names[f]) for f in FEATURES])


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (n_repeat_words * 100 > n_words * MAX_REPEATED)


def stratum_of(column: Column) -> Column:
    """A text key of a stratum: a null is a stratum of its own."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial, 1 where k exceeds the mean; summed in logarithms, so that no n underflows."""
    first = n * F.log1p(F.lit(-p))

    def add(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + F.log(F.lit(p / (1 - p)))
        top = F.greatest(a["total"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(a["total"] - top) + F.exp(term - top))).alias("total"))

    upto = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    log_sum = F.aggregate(upto, F.struct(first.alias("term"), first.alias("total")), add, lambda a: a["total"])
    return F.when(k > n * F.lit(p), F.lit(1.0)).otherwise(F.exp(log_sum))


def choose_cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum and rule that is used: stratum, rule, cutoff (per thousand).

    ``labelled`` has stratum, good (boolean) and the features, one row per labelled document that
    the base rule passes. Without labels nothing is certified and the result is empty.
    """
    trials = F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"),
                 (F.col(num) * 1000 > F.col(den) * c).alias("rejected"))
        for r, (num, den, cutoffs) in RULES.items() for i, c in enumerate(cutoffs)]))
    counts = labelled.select("stratum", "good", trials.alias("t")).groupBy("stratum", "t.rule", "t.step", "t.cutoff").agg(
        F.count_if("good").alias("n"), F.count_if(F.col("good") & F.col("t.rejected")).alias("k"),
        F.count_if(~F.col("good") & F.col("t.rejected")).alias("caught"))
    strata = labelled.select(F.count_distinct("stratum").alias("n_strata"))
    level = F.lit(delta) / (F.col("n_strata") * len(RULES))
    failed = (~(binomial_tail(F.col("k"), F.col("n"), alpha / len(RULES)) <= level)).cast("int")
    order = Window.partitionBy("stratum", "rule").orderBy("step")
    certified = (counts.crossJoin(strata).withColumn("failed", failed)  # strata is one row
                 .withColumn("failed", F.max("failed").over(order)).filter("failed = 0 and caught > k"))
    best = F.max_by(F.col("cutoff"), F.struct((F.col("caught") - F.col("k")), -F.col("step")))
    return certified.groupBy("stratum", "rule").agg(best.alias("cutoff"))


def quality_rules(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", stratum: str = "lang",
                  alpha: float = ALPHA, delta: float = DELTA, with_text: bool = True) -> DataFrame:
    """``docs`` (or only its id, without ``with_text``) with the counts, base_failed, kept and the stratum's reasons.

    ``labels`` has the id and quality (1 good, 0 bad). Labels that are null, or that differ between
    rows of one id, are left out; labels of unknown ids are not used. A null text has no words and
    fails the base rule. A null stratum is a stratum. Rows with equal ids are judged each by its own
    text and all count as labelled. Strata without enough labelled documents have no ratio rules, so
    only the base rule acts there. Columns of ``docs`` called like a result are replaced.
    """
    names = {f: f for f in FEATURES}
    lean = docs.select(col(id).alias("id"), col(text).alias("text"), stratum_of(col(stratum)).alias("stratum"))
    agreed = (labels.select(col("doc_id").alias("id"), col("quality").alias("q")).filter("q is not null and id is not null")
              .groupBy("id").agg(F.min("q").alias("lo"), F.max("q").alias("hi")).filter("lo = hi and lo in (0, 1)"))
    agreed = stored(agreed.select("id", "lo"), "quality-labels")
    if with_text and agreed.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:  # else texts would have to move
        lean = lean.join(F.broadcast(agreed.select("id")), "id", "left_semi")
    seen = stored(with_features(lean, "text", names).drop("text"), "quality-features")
    passing = seen.filter(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    labelled = passing.join(agreed, "id").select("stratum", (F.col("lo") == 1).alias("good"), *FEATURES)
    chosen = choose_cutoffs(labelled, alpha, delta).groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))
    chosen = stored(chosen.select(F.col("stratum").alias("key"), *[F.col(r).alias(f"cut_{r}") for r in RULES]), "quality-cutoffs")
    if chosen.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA:
        chosen = F.broadcast(chosen)

    def judged(df: DataFrame, keep: list[Column], key: str) -> DataFrame:
        failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
        hits = [F.when(F.col(num) * 1000 > F.col(den) * F.col(f"cut_{r}"), F.lit(r)) for r, (num, den, _) in RULES.items()]
        reasons = F.array_compact(F.array(F.when(failed, F.lit("base")), *hits))
        return df.join(chosen, F.col(key) == F.col("key"), "left").select(
            *keep, *FEATURES, failed.alias("base_failed"), (F.size(reasons) == 0).alias("kept"), reasons.alias("reasons"))

    if not with_text:
        return judged(seen, [F.col("id").alias(id)], "stratum")
    results = {"base_failed", "kept", "reasons", "key", *FEATURES, *(f"cut_{r}" for r in RULES)}
    (key,) = inner(docs, "stratum")
    kept = docs.select(*[col(c) for c in docs.columns if c.lower() not in results], stratum_of(col(stratum)).alias(key))
    full = with_features(kept, text, names)
    return judged(full, [col(c) for c in kept.columns if c != key], key)
