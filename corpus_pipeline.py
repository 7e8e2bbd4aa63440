"""The corpus pipeline: quality rules, near-dedup, substring dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. Stages but the last return the
columns of documents (and whatever other columns docs has); packing returns a row for each piece of each document. An empty table
stays empty in all of them. What holds for nulls, ties and very long texts is told by the operators' docstrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from photonflow.llm import decontam, packing, quality, simhash, substring
from photonflow.llm.common import cut, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in their language's perplexity band. Null texts go, null languages are a language;
    repeated rows stay or go together."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 0.8 of their five-word shingles, the one of the smallest id. Texts without words are one
    group; rows of a null id stay; repeated rows of the id that stays stay."""
    return simhash.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-word passages that a document of smaller id has too; documents left without words go. Null texts and
    null ids stay as they are."""
    return substring.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of benchmark items; documents of which more than 0.8 is hit go. Null texts stay as they are."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,048 tokens in optimal length buckets and batches. A null text is one piece of no tokens; repeated rows
    are packed as often as they come."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: SQL has no Kneser-Ney model, SimHash or components; the tests hold run() against brute-force stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
