"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as Parquet and
read again as the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tasteframe.llm import jaccard, lines, packing, quality, substrings
from tasteframe.llm.common import WORD, discard, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned rules reject go, and so do null and empty texts, which are too short. Equal rows stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go; with them, documents of which nothing is left. A null or empty text stays, as "". Rows
    under one doc_id, or without one, do not repeat one another."""
    return _cut(docs, lines.cut_repeated_lines)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays, once (a null id is largest). Null and empty
    texts are duplicates of nothing; equal (doc_id, text) are one row."""
    return jaccard.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of 20 or more words go; with them, documents of which nothing is left. What holds for nulls and
    equal rows is as in line_dedup."""
    return _cut(docs, substrings.cut_repeats)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row per piece, with its ids. A null or empty text is its end id; equal rows are
    packed as often as they stand."""
    import public_tokenizers

    return packing.pack_texts(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, cache_mb=16)


def _cut(docs: DataFrame, operator: Callable[..., DataFrame]) -> DataFrame:
    """docs with what is kept of the texts. Other columns have other names meanwhile, so that none clashes."""
    names = {c: f"own_{i}_" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    cut = operator(docs.withColumnsRenamed(names), kept="kept_")
    cut = cut.where((F.col("n_removed") == 0) | F.col("kept_").rlike(WORD))
    changed = {"text": F.col("kept_"), "n_chars": F.length("kept_").cast("long")}
    return cut.select(*(changed[c].alias(c) if c in changed else F.col(names.get(c, c)).alias(c) for c in docs.columns))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("packing", packed),
]

#: SQL expresses neither the learned rules nor the packing; tests/llm/test_pipeline.py holds the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the packed pieces. A stage's input goes when its result is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
