"""A training corpus from raw documents: five stages, each one operator applied to all that the stage before kept.

quality          documents that the classifier rejects go
near_duplicates  of each group of linked documents (NEAR) the one of least id stays
secrets          every span found is replaced by a mark in the text
mixing           sources come as often as their target weights say, each document at least once
tokens           every text is encoded by the public tokenizer: its ids, their count, digests of the ids and of what they decode to

Defined results: null and empty texts go or stay by the classifier's bias; they
have no near copies and no tokens.  Very long texts are handled whole.  Rows of
one doc_id are one document to near_duplicates: all stay, or all go.  An empty
table gives no rows at any stage.  Extra columns are kept through all stages but
the last, whatever their names; the last one keeps source and lang.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import bpe, classifier, jaccard, mixing, secrets
from tidewright.llm.catalog import tokenizer_path
from tidewright.session import shared_folder

#: Near copies share four fifths of their shingles of five words (the op4 query has a contract of its own).
NEAR = jaccard.Join(n=5, percent=80)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classifier.keep_good(docs, classifier.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, NEAR)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs)
    if "n_chars" in clean.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)).select(docs.columns)
    return clean


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs, mixing.Target(repetition=2.0)).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, tokenizer_path(), "ids", keep=tuple(c for c in ("source", "lang") if c in docs.columns))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", without_secrets),
    ("mixing", mixture),
    ("tokens", tokens),
]

#: Training and exact merging can't be said in SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written before the next one reads them."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
