"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.session import read_table, work_path

from . import sql
from .bpe import token_digests
from .common import stored
from .cotraining import classify
from .html_text import extract_text
from .line_dedup import line_dedup
from .mixing import mix_sources
from .pii import KINDS, find_pii, span_text
from .prefix_trie import branched, prefix_trie, sequences
from .quality_rules import SYMBOLS, quality_rules
from .simhash import simhash_classes
from .token_files import read_tokens, write_tokens
from .token_rollup import commit, counted, signed, totals
from .vector_graph import near_vectors
from .whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(text: str | None = None):
    """Registers a query under its own name, with its SQL if there is one."""
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if text:
            SQL[fn.__name__] = text
        return fn

    return keep


@query(sql.mix_sources())
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix_sources(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


@query()
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_classes(read_table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


@query(sql.quality_rules())
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), with_text=False)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query(sql.LINE_DEDUP)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query()
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_digests(docs, vocabulary, public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query(sql.HTML_TEXT)
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract_text(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query()
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_pii(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: ~x["added"])
    kinds = F.transform(base, lambda x: x["k"])
    counts = [(F.size(base) - F.size(F.array_remove(kinds, n))).cast("long").alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


@query(sql.TOKEN_ROLLUP)
def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches: all documents come, toxic ones go, those with symbols are revised without them; one is delivered twice.

    Rows with equal ids come, go and change each by itself; one without an id is never toxic.
    """
    docs = read_table(spark, sf_dir, "documents")
    toxic = read_table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id")).distinct()
    first = stored(counted(docs, revised=F.translate("text", SYMBOLS, "")), "rollup-counted")
    root = work_path(spark, "llm-rollup")
    gone = signed(first.join(toxic, "id", "left_semi"), -1)
    commit(signed(first, 1), root, "1-insert")
    commit(gone, root, "2-delete")
    revised = first.filter("new is not null").join(toxic, "id", "left_anti")
    commit(signed(revised, -1).union(signed(revised.withColumn("counts", F.col("new")), 1)), root, "3-revise")
    commit(gone, root, "2-delete")
    return totals(spark, root)


@query()
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query()
def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


@query()
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))


@query()
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_path(spark, "llm-tokens")
    write_tokens(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, folder, ids=False)


@query(sql.PREFIX_TRIE)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(branched(sequences(read_table(spark, sf_dir, "conversations"))))
