"""Co-training and the graph of patterns and instances, held against plain Python versions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from assaykit.llm import cotraining, pii

from . import brute

SF = "/root/testdata/sf0.01"


def bins(text, source, lang):
    """{feature: key} of each view."""
    w, t = brute.words(text), text or ""
    n_words, word_chars, n_symbols, n_dup, n_repeat, _ = brute.quality(text)
    rows = [r for r in t.split("\n") if brute.words(r)]
    values = {
        "symbols": (n_symbols, n_words), "repetition": (n_repeat, n_words), "dup_lines": (n_dup, len(rows)), "word_length": (word_chars, n_words),
        "capitals": (sum("A" <= c <= "Z" for c in t), word_chars), "digits": (sum(c in "0123456789" for c in t), word_chars), "variety": (len(set(w)), n_words),
    }
    content = {}
    for f, (over, under) in values.items():
        ends = cotraining.CONTENT[f][1]
        content[f] = sum(over / under > e for e in ends) if under else len(ends) + 1
    return {"content": content, "metadata": {"source": source, "lang": lang, "length": 0 if text is None else 1 + math.floor(math.log2(len(t) + 1))}}


def naive_bayes(rows):
    """Scores by a model of (features, label) rows."""
    counts = defaultdict(lambda: [0, 0])
    for features, y in rows:
        for cell in features.items():
            counts[cell][y] += 1
    odds = {}
    for f in {f for f, _ in counts}:
        own = {cell: n for cell, n in counts.items() if cell[0] == f}
        bad, good = (sum(n[y] for n in own.values()) for y in (0, 1))
        if good and bad:
            odds |= {cell: math.log((n[1] + 1) / (good + len(own))) - math.log((n[0] + 1) / (bad + len(own))) for cell, n in own.items()}
    return lambda features: max(-12.0, min(12.0, sum(odds.get(cell, 0.0) for cell in features.items())))


def rising(held, prior):
    """Calibrated log odds by rounded score: a least-squares rising fit of rates, by pooling neighbours."""
    own = Counter(s for s, _ in held)
    good = Counter(s for s, y in held if y == 1)
    fit = [[good[s] + 1 / (1 + math.exp(-s) * (1 - prior) / prior), own[s] + 1, [s]] for s in range(-12, 13)]
    n = 0
    while n + 1 < len(fit):
        if fit[n][0] * fit[n + 1][1] >= fit[n + 1][0] * fit[n][1]:
            fit[n:n + 2] = [[fit[n][0] + fit[n + 1][0], fit[n][1] + fit[n + 1][1], fit[n][2] + fit[n + 1][2]]]
            n = max(n - 1, 0)
        else:
            n += 1
    return {s: math.log(g / (m - g)) for g, m, scores in fit for s in scores}


def cotrained(docs, labels, rounds=3):
    """{id: (content, metadata, joint probability)} of (id, text, source, lang) rows and {id: label}."""
    seed = xxhash.xxh64_intdigest((11).to_bytes(4, "little"), seed=42)
    fold = lambda i: np.int64(np.uint64(xxhash.xxh64_intdigest(i.to_bytes(8, "little"), seed=seed))) % 5
    held = {i for i in labels if fold(i) == 0}
    views = {i: bins(t, s, g) for i, t, s, g in docs}
    prior = np.mean([labels[i] for i in views if i in labels])
    own = {i: labels[i] for i in views if i in labels and i not in held}
    given = {"content": own, "metadata": own}
    for _ in range(rounds):
        models = {v: naive_bayes([(views[i][v], y) for i, y in given[v].items()]) for v in given}
        scores = {v: {i: models[v](views[i][v]) for i in views} for v in models}
        sure = {v: {i: int(s > 0) for i, s in scores[v].items() if abs(s) >= 3 and i not in labels} for v in scores}
        given = {"content": own | sure["metadata"], "metadata": own | sure["content"]}
    half_up = lambda s: int(math.copysign(math.floor(abs(s) + 0.5), s))
    odds = {}
    for v, found in scores.items():
        table = rising([(half_up(found[i]), labels[i]) for i in held if i in views], prior)
        odds[v] = {i: table[half_up(s)] for i, s in found.items()}
    p = lambda x: 1 / (1 + math.exp(-x))
    return {i: (p(odds["content"][i]), p(odds["metadata"][i]), p(odds["content"][i] + odds["metadata"][i] - math.log(prior / (1 - prior)))) for i in views}


@pytest.mark.parametrize("broadcast", [True, False])
def test_classifier_by_brute_force(spark, monkeypatch, broadcast):
    """Many sources, some of them without a label, some rows without a source or language."""
    if not broadcast:
        monkeypatch.setattr(cotraining, "BROADCAST_BYTES", 0)
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({
        "source": F.when(F.col("doc_id") % 17 > 0, F.concat("source", F.lit("/"), F.expr("doc_id div 20 % 17").cast("string"))),
        "lang": F.when(F.col("doc_id") % 19 > 0, F.col("lang"))})
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source", "lang").collect()]
    assert len({r[2] for r in rows}) > 256
    want = cotrained(rows, {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None})
    got = {r["doc_id"]: (r["p_content"], r["p_metadata"], r["score"]) for r in cotraining.classify(docs, labels).collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[i], want[i], atol=1e-6) for i in want)
    assert len({round(x[2], 6) for x in want.values()}) > 5


def test_sources_are_told_apart(spark):
    """Of 500 sources with the same texts, each is scored by its own labels (13, so none has all of them in the fold kept apart)."""
    docs = spark.range(7000).selectExpr("id AS doc_id", "'the same text' AS text", "concat('host', id % 500) AS source", "'en' AS lang")
    labels = docs.filter("doc_id < 6500").selectExpr("doc_id", "cast(doc_id % 2 AS int) AS quality")
    rows = cotraining.classify(docs, labels).filter("doc_id >= 6500").selectExpr("doc_id % 2 = 1 AS good", "kept").collect()
    assert len(rows) == 500 and all(r["good"] == r["kept"] for r in rows)


def graph_scores(edges, seeds, plausible, rounds=3):
    """{(context, kind): confidence} after the rounds."""
    known = {i for i, _ in seeds}
    kinds = defaultdict(list)
    for i, k in seeds | {(i, k) for i, k in plausible if i not in known}:
        kinds[i].append(k)
    tokens = defaultdict(set)
    for c, i in edges:
        tokens[c].add(i)
    score = {}
    for r in range(rounds):
        sure = {}
        for c, own in tokens.items():
            for k in {k for i in own for k in kinds[i]}:
                values = [1.0 if (i, k) in seeds else score.get((i, k), 0.0) for i in own if k in kinds[i]]
                failures = len(own) - len(values) + pii.UNKNOWN * sum(1 - v for v in values) + 1
                if sum(values) >= 1:
                    sure[c, k] = sum(values) / (sum(values) + failures)
        bound = pii.SURE_PATTERN if r == rounds - 1 else pii.PASSING_PATTERN
        sure = {ck: v for ck, v in sure.items() if v >= bound}
        open_ = defaultdict(lambda: 1.0)
        for (c, k), v in sure.items():
            for i in tokens[c]:
                if k in kinds[i] and (i, k) not in seeds:
                    open_[i, k] *= 1 - v
        score = {ik: 1 - v for ik, v in open_.items()}
    return sure


@pytest.mark.parametrize("seed", range(3))
def test_pattern_graph_by_brute_force(spark, seed):
    """Contexts of every purity, tokens of two kinds, seeds that look like another kind."""
    rng = random.Random(seed)
    edges, seeds, plausible = set(), set(), set()
    for i in range(900):
        kind = rng.randrange(4)
        if rng.random() < 0.6:
            seeds.add((i, kind))
        if rng.random() < 0.7:
            plausible |= {(i, kind), (i, rng.randrange(4))}
        for _ in range(rng.randint(1, 3)):
            edges.add((kind * 8 + rng.randrange(8) if rng.random() < 0.97 else rng.randrange(32), i))
    make = lambda rows, names: spark.createDataFrame(sorted(rows), names)
    found = pii.sure_patterns(make(edges, "c long, i long"), make(seeds, "i long, k int"), make(plausible, "i long, k int"))
    got = {(r["c"], r["k"]): r["confidence"] for r in found.collect()}
    want = graph_scores(edges, seeds, plausible)
    assert got.keys() == want.keys()
    assert all(abs(got[ck] - v) < 1e-6 for ck, v in want.items())
