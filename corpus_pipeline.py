"""A corpus pipeline of five operators, each written and read again.

Every stage is (name, function); a function takes (spark, docs, sf_dir) and returns
the next documents, the last one the digest of the token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockcast.llm import decontam, mixing, ngram_join, quality, token_files
from dockcast.llm.text import id_hash_mod, scratch

REPETITION_LIMIT = 1.25


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = quality.fit(docs, labels, train=id_hash_mod(F.col("doc_id"), 4) != 2)
    return quality.keep_good(docs, weights)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group."""
    return ngram_join.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages don't contaminate."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as came in, with the sources as even as the repetition limit
    allows; a document that the mix takes twice has two rows."""
    return mixing.realise(docs, repetition_limit=REPETITION_LIMIT)


def token_digest(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in packed files; doc_id, start, n_tokens and ids_crc32 read back."""
    import public_tokenizers

    path = scratch(spark, "pipeline-tokens")
    # workers have run four other stages, and go on to others: less memory for words
    token_files.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), cache_words=100_000, piece_bytes=1 << 20)
    return token_files.read_documents(spark, path)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("token_files", token_digest),
]

# a trained classifier has no SQL; tests/llm checks every stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
