"""The opN queries with production parameters over whole tables, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table, tokenizer_path
from .cross_alignment import align_tokenizers
from . import mixture as mixing
from . import license_scan as licenses
from . import norm_buckets
from .ngram_join import similarity_components
from .periodic_runs import collapse_runs, cycled
from .quality_classifier import score_quality
from .quality_rules import quality_rules
from .sentencepiece_bpe import encode_documents
from .substring_dedup import substring_dedup
from .token_counts import count_tokens
from .token_shards import token_shards
from .toxicity import score_toxicity


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op3_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return norm_buckets.top_k(vectors, norm_buckets.every_nth(vectors))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(table(spark, sf_dir, "documents"), size=3, percent=90)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_runs(table(spark, sf_dir, "documents"), least=6, periods=4, taken=cycled)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), window=20)


def op13_cross_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_license_scan, op3_norm_buckets, op4_ngram_join, op5_token_counts, op6_token_shards, op7_mixture, op8_quality_rules, op9_toxicity, op10_quality_classifier, op11_periodic_runs, op12_substring_dedup, op13_cross_alignment, pipeline)}


def oracles() -> dict[str, str]:
    return {"op2_license_scan": licenses.oracle(), "op3_norm_buckets": norm_buckets.ORACLE, "op7_mixture": mixing.ORACLE}
