"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from assaykit.llm.bpe import decode, encode, token_digests
from assaykit.llm.common import inner
from assaykit.llm.components import components
from assaykit.llm.cotraining import classify
from assaykit.llm.html_text import extract_text, main_text
from assaykit.llm.line_dedup import line_dedup
from assaykit.llm.mixing import mix_sources, mixed
from assaykit.llm.pii import find_pii, span_text
from assaykit.llm.quality_rules import binomial_tail, quality_rules
from assaykit.llm.simhash import anchors_of, near_dedup, simhash_classes
from assaykit.llm.token_rollup import commit, counted, signed, totals
from assaykit.llm.vector_graph import assign, drawn, near_vectors, unit

from . import brute

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: besides the columns of documents, names that operators use for results or inside
CLASHES = ["size", "kept", "ids", "key", "src", "id", "f", "h", "label", "fold", "n_words", "kept_text", "__k1", "__words", "lost", "f_more", "target", "slice", "lines"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
LONG = " ".join(f"word{i % 997} and{i % 13}" for i in range(20_000)) + "\n" + "x" * 20_000
ROWS = [
    (1, None, "en", "a", None), (2, "", None, None, 0), (3, " \n\t\n", "en", "a", 4), (4, LONG, "de", "b", None), (5, "one", "en", "", 3),
    (6, "one", "en", "", 3), (None, "no id here", "fr", None, 10), (None, None, None, None, None), (7, "same row twice", "en", "a", 14),
    (7, "same row twice", "en", "a", 14), (8, "E\nÉ É\né\n" * 12, None, "b", None),
]
LABELS = [(1, 1, 0), (2, None, None), (3, 0, 0), (3, 1, 1), (4, 1, 0), (None, 1, 1), (99, 0, 0), (5, 0, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *["c"] * len(CLASHES)) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def same_others(df, docs, replaced=()):
    """All rows are there and the columns of the input are unchanged."""
    cols = [c for c in docs.columns if c not in replaced]
    assert sorted(map(repr, df.select(*cols).collect())) == sorted(map(repr, docs.select(*cols).collect()))


def test_line_dedup(docs, none):
    out = line_dedup(docs, min_docs=2)
    same_others(out, docs, {"kept_text", "n_lines", "n_dropped"})
    want = brute.line_dedup([r[1] for r in ROWS], min_docs=2)
    got = [tuple(r) for r in out.select("kept_text", "n_lines", "n_dropped").collect()]
    assert sorted(got) == sorted(want)
    assert line_dedup(none).count() == 0


def test_quality_rules(docs, none, labels):
    out = quality_rules(docs, labels)
    same_others(out, docs, {"kept", "n_words", "key"})
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted(tuple(r) for r in out.select(*cols).collect()) == sorted(brute.quality(r[1]) for r in ROWS)
    lean = quality_rules(docs, labels, with_text=False)
    assert sorted(tuple(r) for r in lean.select(*cols).collect()) == sorted(brute.quality(r[1]) for r in ROWS)
    assert quality_rules(none, labels).count() == 0
    assert quality_rules(docs, labels.limit(0)).count() == len(ROWS)


def test_binomial_tail(spark):
    from math import comb

    cases = [(k, n, p) for n in (0, 1, 7, 60) for k in range(n + 1) for p in (0.01, 0.3)]
    for p in (0.01, 0.3):
        rows = [(k, n) for k, n, q in cases if q == p]
        got = spark.createDataFrame(rows, "k long, n long").select("k", "n", binomial_tail(F.col("k"), F.col("n"), p).alias("t")).collect()
        for r in got:
            exact = sum(comb(r["n"], i) * p**i * (1 - p) ** (r["n"] - i) for i in range(r["k"] + 1))
            assert r["t"] == pytest.approx(1.0 if r["k"] > r["n"] * p else exact, rel=1e-9)
    far = spark.range(1).select(binomial_tail(F.lit(900_000).cast("long"), F.lit(100_000_000).cast("long"), 0.01).alias("t")).first()["t"]
    assert 0 <= far < 1e-300


def test_rules_are_certified_and_used(spark):
    good = [(i, f"word{i} " + " ".join(f"w{i}x{j}" for j in range(60)), "en") for i in range(900)]
    bad = [(i + 10_000, " ".join(f"w{i}y{j}#" for j in range(60)), "en") for i in range(60)]
    other = [(i + 20_000, " ".join(f"w{i}z{j}#" for j in range(60)), "fr") for i in range(30)]
    docs = spark.createDataFrame(good + bad + other, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], 1) for r in good] + [(r[0], 0) for r in bad + other], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules(docs, labels, with_text=False).collect()}
    assert all(kept[r[0]] for r in good) and not any(kept[r[0]] for r in bad)
    assert all(kept[r[0]] for r in other)  # nothing is certified without good documents of the stratum


def test_mixing(docs, none):
    out = mix_sources(docs)
    same_others(out, docs, {"size", "target"})
    rows = out.select("source", "size", "source_size", "target", "repeats", "taken").collect()
    assert all(r["taken"] == r["size"] * r["repeats"] and r["taken"] <= 3 * r["size"] for r in rows)
    assert sum({r["source"]: r["target"] for r in rows}.values()) == pytest.approx(sum(len(brute.words(r[1])) for r in ROWS))
    again = out.repartition(7).select("doc_id", "source", "taken").collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out.select("doc_id", "source", "taken").collect()))
    assert mixed(docs).columns == docs.columns
    assert mixed(docs).count() == sum(r["repeats"] for r in rows)
    assert {r["size"] for r in mixed(docs).select("size").collect()} == {"c"}
    assert mix_sources(none).count() == 0 and mixed(none).count() == 0


def test_hot_source_and_clamped_sources(spark):
    rows = [(i, "w " * (i % 40 + 1), "hot") for i in range(2000)] + [(10_000 + i, "w w w", f"s{i}") for i in range(10)]
    out = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(
        F.first("source_size").alias("size"), F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert sum(r["target"] for r in out) == pytest.approx(sum(r["size"] for r in out))
    assert all(r["target"] == 9 and r["taken"] == 9 for r in out if r["source"] != "hot")
    assert all(abs(r["taken"] - r["target"]) <= 20 for r in out)  # half a document: hardly any is left out


def test_bpe(docs, none):
    out = token_digests(docs, PATH, public_tokenizers.PATTERN)
    same_others(out, docs, {"ids"})
    got = sorted((r["n_tokens"] == len(r["ids"]), r["decoded_sha256"]) for r in out.select("n_tokens", "ids", "decoded_sha256").collect())
    assert got == sorted((True, brute.sha(r[1] or "")) for r in ROWS)
    assert token_digests(none, PATH, public_tokenizers.PATTERN).count() == 0
    nulls = encode(docs, PATH, public_tokenizers.PATTERN).select(F.when(F.col("doc_id") > 3, F.col("ids")).alias("ids"))
    assert decode(nulls, PATH, public_tokenizers.PATTERN).filter("ids is null and decoded is not null").count() == 0


def test_html(spark):
    rows = [(1, None), (2, ""), (3, "<p>"), (4, "a" * 200_000), (5, "<article><p>x</p></article>"), (5, "<article><p>x</p></article>"), (6, "<!-- open"), (7, "<nav>never closed")]
    df = spark.createDataFrame([(a, b, "t", "k") for a, b in rows], "page_id long, html string, text string, `__x` string")
    out = {(r["page_id"], r["text"]) for r in extract_text(df).collect()}
    assert out == {(1, ""), (2, ""), (3, ""), (4, "a" * 200_000), (5, "x"), (6, ""), (7, "")}
    assert extract_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("page, text", [
    ("<nav>m</nav><article><h1>T &amp; U</h1><p>a\n  <b>b</b>c<br>d</article><footer>f", "T & U a bc d"),
    ("<article><p>a</p><div class='ad-slot'>x</div><p>b</p><aside>s</aside><p>c</p><div id=comments><p>nice</p></div></article>", "a b c"),
    ("<main><header><h1>T</h1></header><p>&eacute;&#10;&#x41;</p><form>q<input></form></main><header>h</header>", "T é A"),
    ("<div class=cookie-notice>We use cookies</div><script>var a='<p>x</p>'</script><div><p>" + "word " * 30 + "</p><p>end</p></div>", ("word " * 30).strip() + " end"),
    ("<article><p>a < b and c > d <3 &lt;p&gt;</p></article>", "a < b and c > d <3 <p>"),
])
def test_main_text(page, text):
    assert main_text(page) == text


LINE = ("long line of text " * 9).strip()


@pytest.mark.parametrize("page, text", [
    (f"<h1>Title</h1><div><p>{LINE}</p></div>", f"Title {LINE}"),
    (f"<div><div><p>{LINE}</p></div></div><div><p>Short.</p></div><div><div><p>{LINE}</p></div></div>", f"{LINE} Short. {LINE}"),
    (f"<div><div><p>{LINE}</p></div></div><div><div><p>End.</p></div></div>", f"{LINE} End."),
    (f"<div><h1>Title</h1></div><p>By X</p><p>Today</p><p>Place</p><table><tr><td><p>{LINE}</p></table>", f"Title By X Today Place {LINE}"),
    (f"<p>Home</p><nav>menu</nav><h1>T</h1><div><div><p>{LINE}</p></div></div><footer>f</footer><p>Imprint</p>", f"T {LINE}"),
])
def test_nested_tags_are_no_gaps(page, text):
    assert main_text(page) == text


STORY = "".join(f"<p>{'story ' * 20}{i}</p>" for i in range(4))
TOLD = " ".join(f"{'story ' * 20}{i}" for i in range(4))


@pytest.mark.parametrize("page, text", [
    (f"<div class=post>{STORY}</div><article class=comment><p>{'nice ' * 30}</p></article><article class='related teaser'>{'more ' * 30}</article>", TOLD),
    (f"<div>{STORY}</div><aside><article><p>{'teaser ' * 99}</p></article></aside>", TOLD),
    (f"<main>{STORY}<article class='reader-comment' id=comment-3><p>{'nice ' * 99}</p></article></main>", TOLD),
    (f"<div>{STORY[:300]}</div><div class=ad>x</div><div>{STORY[300:]}</div><article><p>{'teaser ' * 25}</p></article>", None),
    (f"<article class='post tag-related has-comments category-ads'>{STORY}<p>end</p></article><div>{'terms ' * 20}</div>", TOLD + " end"),
])
def test_articles_that_are_not_the_text(page, text):
    if text is None:  # an article that is smaller than the rest hides nothing of it
        assert all(f"story {i}" in main_text(page) for i in range(4))
    else:
        assert main_text(page) == text


def test_simhash(docs, none):
    got = simhash_classes(docs).collect()
    prints = [(r[0], brute.fingerprint(r[1])) for r in ROWS]
    assert sorted((r["f"] % 2**64, -1 if r["id"] is None else r["id"]) for r in got) == sorted((f, -1 if i is None else i) for i, f in prints)
    by = {}
    for r in got:
        by.setdefault(r["f"], set()).add(r["component_id"])
    assert all(len(c) == 1 for c in by.values())
    assert {r["component_id"] for r in got if r["f"] == 0} == {1}  # null and empty texts
    kept = near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted(map(repr, [1, 4, 5, None, 7, 7, 8]))
    assert simhash_classes(none).count() == 0 and near_dedup(none).count() == 0


def test_every_pair_within_the_threshold_meets_at_the_home_of_either():
    rng = np.random.default_rng(5)
    for _ in range(300):
        x = int(rng.integers(0, 2**63))
        y = x
        for bit in rng.choice(64, rng.integers(0, 3), replace=False):
            y ^= 1 << int(bit)
        ax, ay = anchors_of(x).tolist(), anchors_of(y % 2**64).tolist()
        assert ax[0] in ay and ay[0] in ax and len(set(ax)) == len(ax)


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 500)] + [tuple(map(int, p)) for p in rng.integers(2000, 2300, (200, 2))]
    want = brute.least_reachable({x for p in links for x in p if p[0] != p[1]}, links)
    got = components(spark.createDataFrame([*links, (None, 1), (7, 7)], "a long, b long").filter("a is not null"))
    rows = [tuple(r) for r in got.collect()]
    assert dict(rows) == want and len(rows) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_personal_data(docs, none, spark):
    out = find_pii(docs)
    assert out.count() == len(ROWS) and out.filter("size(spans) > 0").count() == 0
    assert find_pii(none).count() == 0
    texts = ["a@b.c_d@e.f 1.2.3.4.5.6.7.8 256.1.1.1 +1 (555) 123-4567", "4111 1111 1111 1111 4111-1111-1111-1112 é😀 x@y.z", "1" * 5000 + " " + "a" * 5000 + "@", "+12 3.4.5.6.", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["t"] for r in find_pii(df).select("doc_id", span_text(F.col("spans")).alias("t")).collect()}
    assert got == {i: ",".join(brute.personal(t)) for i, t in enumerate(texts)}


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"noise{i} write to u{i}@mail{i}.example.org today or later") for i in range(40)]
    rows += [(100, "please write to someone@intranet soon"), (101, "read about someone@intranet here"), (102, "write to room 12 instead"),
             *[(200 + i, "write to copied@mail.example.org again") for i in range(30)]]
    out = {r["doc_id"]: r["t"] for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", span_text(F.filter("spans", lambda x: x["added"])).alias("t")).collect()}
    assert out[100] == "email:16:32"
    assert all(not t for i, t in out.items() if i != 100)


def test_contexts_with_many_unseen_identifiers(spark):
    rows = [(i, f"noise{i} please dial +1 555 {1000 + i} {2000 + i} now") for i in range(60)]
    rows += [(100 + i, f"noise{i} please dial 555-{3000 + i} now") for i in range(40)]
    rows += [(200 + i, f"noise{i} order number +1 555 {1000 + i} {5000 + i} now") for i in range(60)]  # as many tokens that look like no phone
    rows += [(300 + i, f"noise{i} order number x{i} now") for i in range(60)] + [(400, "order number 555-9999 now")]
    out = {r["doc_id"]: r["t"] for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", span_text(F.filter("spans", lambda x: x["added"])).alias("t")).collect()}
    assert {i for i, t in out.items() if t} == set(range(100, 140))
    assert out[100] == "phone:19:27"


def test_rollup(docs, none, spark, tmp_path):
    root = str(tmp_path / "totals")
    rows = counted(docs)
    commit(signed(rows, 1), root, "1")
    first = sorted(map(repr, totals(spark, root).collect()))
    commit(signed(rows.filter("id = 4"), -1), root, "2")
    commit(signed(rows, 1), root, "1")  # delivered again
    commit(signed(rows.filter("id = 4"), -1), root, "2")
    commit(signed(counted(none), 1), root, "3")
    left = {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in totals(spark, root).collect()}
    assert ("b", "de", "words-1") not in left and left[("b", None, "words-1")][0] == 1
    assert left[(None, None, "words-1")] == (2, 0) and left[("a", "en", "words-1")] == (4, 6)
    commit(signed(rows.filter("id = 4"), 1), root, "4")
    assert sorted(map(repr, totals(spark, root).collect())) == first
    with pytest.raises(ValueError):
        commit(signed(rows, 1), root, "a/b")


def test_rollup_of_revised_rows_with_equal_or_no_ids(spark, tmp_path):
    """Two equal rows and one without an id: each is revised once, by itself."""
    root = str(tmp_path / "totals")
    assert totals(spark, root).collect() == [] and totals(spark, root).columns == ["source", "lang", "tokenizer", "n_docs", "n_tokens"]
    docs = spark.createDataFrame([(1, "a b #"), (1, "a b #"), (None, "c #"), (2, "stays"), (3, None)], "doc_id long, text string").selectExpr("*", "'s' AS source", "'l' AS lang")
    rows = counted(docs, revised=F.translate("text", "#", ""))
    commit(signed(rows, 1), root, "1")
    changed = rows.filter("new is not null")
    assert changed.count() == 3
    deltas = signed(changed, -1).union(signed(changed.withColumn("counts", F.col("new")), 1))
    with pytest.raises(Exception, match="dies"):  # half-way: the totals stay as they are
        commit(deltas.withColumn("tokens", F.when(F.col("tokens") < 0, F.raise_error(F.lit("dies"))).otherwise(F.col("tokens"))), root, "2")
    assert {r["tokenizer"]: (r["n_docs"], r["n_tokens"]) for r in totals(spark, root).collect()}["words-1"] == (5, 9)
    for _ in range(2):
        commit(deltas, root, "2")
    assert {r["tokenizer"]: (r["n_docs"], r["n_tokens"]) for r in totals(spark, root).collect()} == {"words-1": (5, 6), "pieces-1": (5, 6)}


def test_rollup_by_a_vocabulary(spark, tmp_path):
    """The counts of a real tokenizer as one of the versions."""
    docs = spark.createDataFrame([(1, "Hello, world", "s", "l"), (2, None, "s", "l"), (3, "naïve été", "t", None)], "doc_id long, text string, source string, lang string")
    rows = counted(token_digests(docs, PATH, public_tokenizers.PATTERN), tokenizers={"bpe-50k": lambda text: F.col("n_tokens")})
    commit(signed(rows, 1), str(tmp_path / "t"), "1")
    want = {r["doc_id"]: r["n_tokens"] for r in token_digests(docs, PATH, public_tokenizers.PATTERN).collect()}
    assert {r["source"]: (r["n_docs"], r["n_tokens"]) for r in totals(spark, str(tmp_path / "t")).collect()} == {"s": (2, want[1]), "t": (1, want[3])}


def test_classifier(docs, none, labels):
    out = classify(docs, labels)
    assert out.count() == len(ROWS) and out.filter("score is null or score < 0 or score > 1 or kept is null").count() == 0
    assert classify(none, labels).count() == 0
    assert {(r["score"], r["kept"]) for r in classify(docs, labels.limit(0)).collect()} == {(0.5, True)}


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 0), (4, [1.0, 0.0], 1), (5, [1.0, 0.0], None), (6, None, 0), (7, [0.0, 0.0], 0),
            (8, [nan, 1.0], 0), (9, [inf, 1.0], 0), (10, [None, 1.0], 0), (11, [0.0, 1.0], 0), (12, [0.0, 1.0], 0), (13, [0.0, -1.0], 0), (14, [], 0), (14, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("c")).withColumn("grp", F.lit("c"))
    got = [(r["vec_id"], (r["n_links"], r["component_id"])) for r in near_vectors(df).collect()]
    assert dict(got) == brute.vectors(rows) and len(got) == len(rows)
    assert near_vectors(df.limit(0)).count() == 0
    extra = near_vectors(df.union(spark.createDataFrame([(None, [1.0, 0.0], 0, "c", "c"), (1, [1.0, 0.0], 0, "c", "c")], df.schema))).collect()
    assert {r["n_links"] for r in extra if r["vec_id"] in (1, 2, 3, None)} == {4} and len(extra) == len(rows) + 2


def test_of_two_linked_nodes_the_one_with_the_higher_home_visits_the_other():
    rng = np.random.default_rng(7)
    x = unit(rng.normal(size=(2000, 64)))
    side = rng.normal(size=x.shape)
    side = unit(side - (side * x).sum(1, keepdims=True) * x)
    y = 0.981 * x + np.sqrt(1 - 0.981 ** 2) * side
    pivots = pd.DataFrame({"shard": range(256), "vec": list(rng.normal(size=(256, 64)))})
    routes = assign(0.98)(pd.DataFrame({"node": range(4000), "vec": [*x, *y]}), pivots)
    home = routes[routes["rank"] == 0].set_index("node")["shard"]
    visits = routes[routes["visit"]]
    visited = set(zip(visits["node"], visits["shard"]))
    pairs = [(n, (n + 2000) % 4000) for n in range(4000)]
    assert all((n, home[n]) in visited for n, _ in pairs) and len({home[n] != home[m] for n, m in pairs}) == 2
    assert all((n, home[m]) in visited for n, m in pairs if home[n] >= home[m])
    assert (visits["shard"] <= visits["home"]).all() and (routes["home"] == home[routes["node"]].to_numpy()).all()


def test_pivots_are_ranked_among_few_nodes(spark):
    nodes = spark.range(0, 60_000, 1, 4).select(F.when(F.col("id") % 50 > 0, "hot").otherwise(F.col("id").cast("string")).alias("grp"), F.col("id").alias("node"))
    groups = nodes.groupBy("grp").agg(F.count("*").alias("n")).select("grp", "n", F.ceil(F.col("n") / 1000).alias("k"), F.lit(1).alias("chunks"))
    got = drawn(nodes, groups, F.broadcast)
    plain = nodes.filter("grp = 'hot'").orderBy(F.xxhash64(F.lit(5), "node"), "node").limit(59).collect()
    assert [r["node"] for r in got.filter("grp = 'hot'").orderBy("shard").collect()] == [r["node"] for r in plain]
    assert got.count() == 59 + 1200
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    ranked = plan[plan.index("Window"):]
    assert "Filter" in ranked and "vec" not in plan


def test_inner_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "__a int, `__a_` int, B int")
    assert inner(df, "a", "b") == ["__a__", "__b"]
