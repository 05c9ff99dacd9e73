"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, factors, fingerprint, html, jaccard, oracles, prefixes, quality, repeats, secrets, sharding, spelling, tokencount


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(table(spark, sf_dir, "documents"))


def op3_edit_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op5_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edits(table(spark, sf_dir, "documents"))


def op6_zstd_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_wrapper_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op9_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_pigeonhole_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), k=4, p=85, q=100)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(prefixes.regrafted(table(spark, sf_dir, "conversations")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_lempel_ziv_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.remove(table(spark, sf_dir, "documents")).drop("spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_fm": op1_quality_fm,
        "op2_suffix_repeats": op2_suffix_repeats,
        "op3_edit_decontamination": op3_edit_decontamination,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_edit_embedding": op5_edit_embedding,
        "op6_zstd_secrets": op6_zstd_secrets,
        "op7_token_cache": op7_token_cache,
        "op8_wrapper_html": op8_wrapper_html,
        "op9_kd_shards": op9_kd_shards,
        "op10_pigeonhole_jaccard": op10_pigeonhole_jaccard,
        "op11_conversation_trie": op11_conversation_trie,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_lempel_ziv_repeats": op13_lempel_ziv_repeats,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_conversation_trie": oracles.TRIE, "op12_spelling_variants": oracles.SPELLING, "op13_lempel_ziv_repeats": oracles.FACTORS}
