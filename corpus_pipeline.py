"""Documents made into training sequences: five stages, each one operator of gleaner.llm.

Every stage takes documents with any further columns, of any names, and gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import decontaminate, language, neardup, packing, secrets
from gleaner.llm.common import staged, table
from gleaner.llm.queries import tokenizer


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those of doubtful language, go: null and empty texts too. Repeated rows fare alike."""
    return language.reject(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of least id stays; null ids, null and empty texts stay. Rows of one id stay or go together."""
    return neardup.keep_first(docs)


def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which half a benchmark item can be tiled go; null and empty texts stay. Repeated rows fare alike."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, null and empty texts as they are. Repeated rows are changed alike."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences; a null text is its end alone. Repeated rows are packed as often as they occur."""
    return packing.pack(docs, tokenizer())


STAGES = [
    ("language ID", identify_language),
    ("near-duplicates", remove_near_duplicates),
    ("benchmark decontamination", remove_benchmark_leaks),
    ("secret scans", remove_secrets),
    ("packing", pack_sequences),
]
ORACLE_SQL = None  # SQL can't express the classifier, the tiling or the tokenizer; tests compare with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
