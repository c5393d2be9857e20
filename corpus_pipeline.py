"""Corpus pipeline over ``documents``: five stages, each applying one operator
of ``shoptally.llm`` to all that its predecessor kept. Every stage but the last
returns the columns of ``documents``.

Defined results: an empty table passes through; rows that repeat an id are one
document and stay or go together; documents with a NULL id aren't compared
with others by the n-gram join and stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoptally.llm.bpe import digests
from shoptally.llm.common import has_word, materialize, read
from shoptally.llm.decontaminate import drop_leaks
from shoptally.llm.line_dedup import dedup_lines
from shoptally.llm.ngram_join import jaccard_components
from shoptally.llm.quality_rules import quality_rules
from shoptally.llm.queries import ranks

C = F.col
#: Near copies of the stage; op10's contract (4 words, 85 %) binds its query alone.
NEAR_WORDS = 5
NEAR_PERCENT = 80
#: Shorter lines go only if equal: short sentences that differ in a letter are clean text.
NEAR_LINE_CHARS = 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules or their host's verdict reject go."""
    return quality_rules(docs, C("text"), C("source")).where("kept").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one (within one edit) go; so do documents
    of which no word is left."""
    found = dedup_lines(docs, C("doc_id"), C("text"), near_chars=NEAR_LINE_CHARS)
    changed = C("n_equal") + C("n_near") > 0
    found = found.where(~changed | has_word(C("kept_text")))
    return found.withColumns({"text": F.when(changed, C("kept_text")).otherwise(C("text")),
                              "n_chars": F.when(changed, F.length("kept_text").cast("long")).otherwise(C("n_chars"))}).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that n-gram similarity connects, the one of least id stays."""
    found = jaccard_components(docs, "doc_id", "text", percent=NEAR_PERCENT, n=NEAR_WORDS)
    drop = found.where("component_id != doc_id").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_leaks(docs, "text", read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids in place of the text, with digests of ids and decoded bytes."""
    return digests(docs, "text", *ranks(), ids=True)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_join", near), ("decontaminate", benchmark), ("bpe", tokens)]

#: SQL expresses neither the prefix-tree join at this size nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
