"""A training corpus from raw documents: five stages, each over all that the one before kept.

Each stage takes the documents as a DataFrame and gives one back; it is written as Parquet in the
shared folder and read again as the next one's input, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm.bpe import token_digests
from assaykit.llm.common import stored
from assaykit.llm.line_dedup import line_dedup
from assaykit.llm.mixing import mixed
from assaykit.llm.quality_rules import quality_rules
from assaykit.llm.simhash import near_dedup
from assaykit.session import read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    rows = quality_rules(docs.select(COLUMNS), read_table(spark, sf_dir, "labels"))
    return rows.filter("kept").select(COLUMNS)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten or more documents go; n_chars follows the text."""
    rows = line_dedup(docs.select(COLUMNS))
    return rows.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return near_dedup(docs.select(COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out until sources have their target weights."""
    return mixed(docs.select(COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document of the mix, with their number and digests."""
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return token_digests(docs.select("doc_id", "text", "source"), vocabulary, public_tokenizers.PATTERN).drop("text")


STAGES = [("quality_rules", quality), ("line_dedup", repeated_lines), ("simhash_near_dedup", near_copies), ("mix_sources", mix),
          ("byte_bpe", tokens)]

#: near copies and token ids have no SQL form; tests hold the pipeline against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
