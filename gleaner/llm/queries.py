"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, fingerprints, html, language, neardup, negatives, packing, scoring, secrets, sharding, sql, substrings, suffixes
from .common import table


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """Where this machine has the vocabulary file; executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_cover_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op2_fast_sketch_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.imatch(table(spark, sf_dir, "documents"))


def op5_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer())


def op7_suffix_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeated_bytes(table(spark, sf_dir, "documents"))


def op8_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(table(spark, sf_dir, "documents"))


def op9_min_cut_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op10_family_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op11_shared_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_report(table(spark, sf_dir, "documents"), tokenizer(), tokenizer("piece_bpe_32k.model"))


def op12_context_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_texts(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2)


def op13_slot_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(negatives.quantised(vectors), F.col("id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cover_substrings": op1_cover_substrings,
    "op2_fast_sketch_neardup": op2_fast_sketch_neardup,
    "op3_secret_ownership": op3_secret_ownership,
    "op4_imatch": op4_imatch,
    "op5_string_tiling": op5_string_tiling,
    "op6_bounded_packing": op6_bounded_packing,
    "op7_suffix_collections": op7_suffix_collections,
    "op8_byte_shards": op8_byte_shards,
    "op9_min_cut_html": op9_min_cut_html,
    "op10_family_svm": op10_family_svm,
    "op11_shared_cuts": op11_shared_cuts,
    "op12_context_trees": op12_context_trees,
    "op13_slot_negatives": op13_slot_negatives,
}
SQL: dict[str, str] = dict(sql.SQL)
