"""Queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import bpe, classifier, fingerprint, jaccard, mixing, oracles, rules, secrets, sharding, substring, suffixtree

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    mixed = mixing.mix_documents(docs, mixing.Target(repetition=2.0))
    own = zip(mixing.added(docs.columns), ("epoch", "mix_weight", "mix_place"))
    return mixed.select("doc_id", "source", *(mixed[c].alias(name) for c, name in own))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classifier.score(docs, classifier.train(docs, labels))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(documents(spark, sf_dir))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_documents(documents(spark, sf_dir), jaccard.Join(n=3, percent=90))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir), tokenizer_path())


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(documents(spark, sf_dir))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(documents(spark, sf_dir))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.dedup_words(documents(spark, sf_dir))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {
        "op1_mixing": op1_mixing,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_bpe": op5_bpe,
        "op6_secret_scan": op6_secret_scan,
        "op7_quality_rules": op7_quality_rules,
        "op8_fingerprint": op8_fingerprint,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_sharding": op10_sharding,
    }


def oracle_sql() -> dict[str, str]:
    """Where SQL can say an operator's rows; the others are tested against plain versions."""
    return {"op3_substring_dedup": oracles.SUBSTRINGS, "op4_jaccard_join": oracles.JACCARD, "op9_suffix_dedup": oracles.WORDS}
