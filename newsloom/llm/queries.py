"""Registered queries of the training-data operators, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import htmltree, importance, jaccard, lblm, mixing, mixpack, oracle, packing, pii, quality, sharding, substrings, topk, trie


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_rlz_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_dedup(_read(spark, sf_dir, "documents"), whole=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_tree_model_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltree.main_text(_read(spark, sf_dir, "pages"))


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.line_frequency_quality(_read(spark, sf_dir, "documents"))


def op4_conflict_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def op5_log_bilinear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lblm.score_texts(_read(spark, sf_dir, "documents"))


def op6_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_read(spark, sf_dir, "documents"))


def op7_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.pareto_mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_consistent_hash_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.consistent_hash_shards(_read(spark, sf_dir, "documents"))


def op10_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_read(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.importance_resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_mixture_controlled_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return mixpack.mixture_pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.with_common_heads(trie.turn_arrays(_read(spark, sf_dir, "conversations"))))


QUERIES = {
    f.__name__: f
    for f in (
        op1_rlz_substring_dedup, op2_tree_model_html, op3_line_frequency, op4_conflict_best_fit_packing, op5_log_bilinear_scores,
        op6_grouped_prefix_join, op7_pareto_mixing, op8_bit_sliced_top_k, op9_consistent_hash_sharding, op10_weak_supervision_pii,
        op11_importance_resampling, op12_mixture_controlled_packing, op13_conversation_prefix_trie,
    )
}
ORACLE_SQL = oracle.ORACLE_SQL
