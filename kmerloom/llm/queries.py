"""Queries over the driver's tables, one per operator, with SQL where SQL can express it."""

from pyspark.sql import DataFrame, SparkSession

from . import bitplane, fingerprint, language_id, minhash, mixing, oracles, sentencepiece_viterbi, substring_dedup, suffix_array, token_counts, topk
from .common import table, tokenizer_file


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), window=50).drop("kept_text")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op5_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_viterbi.encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op6_norm_bucketed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"), every=50, k=5, scale=256)


def op7_bitplane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplane.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2)


def op8_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edits(table(spark, sf_dir, "documents"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.suffix_array_dedup(table(spark, sf_dir, "documents"), length=100).drop("kept_bytes")


def op10_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0).drop("copies")


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_substring_dedup,
        op3_minhash_near_dedup,
        op4_token_counts,
        op5_sentencepiece_viterbi,
        op6_norm_bucketed_topk,
        op7_bitplane_ids,
        op8_multiset_fingerprint,
        op9_suffix_array_dedup,
        op10_pivotal_mixing,
    )
}
#: The others need tokenizers, fitted models, random rounding or the operator's own fingerprints.
ORACLE_SQL = {
    "op2_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op3_minhash_near_dedup": oracles.NEAR_DUPLICATES,
    "op6_norm_bucketed_topk": oracles.TOP_PRODUCTS,
    "op9_suffix_array_dedup": oracles.SUFFIX_ARRAY_DEDUP,
}
