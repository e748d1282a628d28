"""Corpus pipeline: quality rules, near duplicates, repeated strings, secrets, packing.

Each stage works on all that the one before it kept. All but the last return the columns of documents: rejected
documents go, of each group of near duplicates the one with the smallest doc_id stays, repeated strings are cut out,
secrets are masked. The last returns the pieces of the packed sequences.

Defined results, of each stage and of the whole: null and empty texts fail the quality rules, later stages leave them as
they are; rows that share an id stay or go together; repeated rows get equal treatment; an empty table gives an empty
result; extra columns are kept up to the last stage; texts of any length are read whole.

Near duplicates are judged on five words and a similarity of 0.8. SQL can't express the outlier estimates, the masks or
the tokens, so there is no ORACLE_SQL; the tests hold the pipeline against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import jaccard, packing, quality, secrets, suffixes
from ledgerloom.llm.common import discard, read, settled


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.drop_near_duplicates(docs, width=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.drop_repeats(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, temperature=packing.TEMPERATURE)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", suffix_dedup),
    ("secret_scans", secret_scan),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = read(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before = docs
        docs = settled(lambda: stage(spark, before, sf_dir), name)  # noqa: B023  called at once
        if i:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
