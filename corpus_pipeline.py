"""A corpus pipeline: language identification, near-duplicates, decontamination, secrets, tokens.

Every stage takes (spark, docs, folder of tables) and works on all that the one before it kept. All but the last
return the columns of documents; the last returns each document's tokens as digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm import byte_bpe, decontaminate, language_id, near_dedup, secret_scan
from lociflow.llm.common import fold, swept, table, written
from lociflow.llm.registry import vocabulary


def identify(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in a language go on; those that language identification rejects, as they hold no letter, go."""
    model = language_id.fit(docs.where(fold(F.col("doc_id"), 5) != 0))
    return language_id.kept(docs, model)


def deduplicate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each class of near-duplicates goes on, that with the smallest doc_id."""
    return near_dedup.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that do not hold a benchmark item go on."""
    return decontaminate.clean(docs, table(spark, folder, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents go on; live-looking secrets in their texts are masked."""
    return secret_scan.redacted(docs)


def tokenize(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, n_tokens and digests of the tokens and of what they decode to."""
    return byte_bpe.digests(docs, vocabulary())


STAGES = [
    ("language_id", identify),
    ("near_dedup", deduplicate),
    ("decontaminate", decontaminated),
    ("secret_scan", redact),
    ("byte_bpe", tokenize),
]

#: SQL cannot express near-duplicates, tiling or merges; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over documents, each written and read again before the next; a stage's scratch tables go with it."""
    docs = table(spark, folder, "documents")
    for _, stage in STAGES[:-1]:
        with swept(spark):
            docs = written(stage(spark, docs, folder), lasting=True)
    return STAGES[-1][1](spark, docs, folder)
