"""One query for each corpus operator, over its whole table with production parameters, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import (
    bpe,
    divergence,
    embed_dedup,
    hard_negatives,
    mixing,
    oracle,
    pii,
    quality_knn,
    quality_rules,
    secret_scan,
    sharding,
    simhash,
    stages,
    token_counts,
    toxicity,
)
from plumbline.llm.stages import split_pattern, vocabulary
from plumbline.session import read_table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"), shards=40)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read_table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return bpe.digests(bpe.encode(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), split_pattern()))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_classes(read_table(spark, sf_dir, "documents"), words=3, radius=2)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    counted = token_counts.token_counts(docs, vocabulary("piece_bpe_32k.model"), limit=4096)
    return token_counts.with_limit(counted, 4096)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogates(read_table(spark, sf_dir, "documents"))


def op9_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"), least=0.95)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(read_table(spark, sf_dir, "embeddings"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = secret_scan.read_ranks(vocabulary("byte_bpe_50k.tiktoken"))
    return secret_scan.scan(read_table(spark, sf_dir, "documents"), ranks, split_pattern())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [
        op1_toxicity,
        op2_sharding,
        op3_quality_rules,
        op4_byte_bpe,
        op5_simhash_dedup,
        op6_token_counts,
        op7_mixing,
        op8_pii_surrogates,
        op9_quality_neighbours,
        op10_embedding_dedup,
        op11_source_divergence,
        op12_hard_negatives,
        op13_secret_scan,
        pipeline,
    ]
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    """The rest is beyond SQL (models, EM, BPE, XXH64, knapsacks, keyed draws until none collide); tests hold it to brute force."""
    return {
        "op2_sharding": oracle.op2_sql(),
        "op10_embedding_dedup": oracle.op10_sql(),
        "op11_source_divergence": oracle.op11_sql(),
        "op12_hard_negatives": oracle.op12_sql(),
    }
