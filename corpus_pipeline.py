"""A corpus pipeline of five stages over ``documents``; each reads what the stage before it wrote.

languages -> one document of each group of near duplicates -> no benchmark items -> target mix -> even shards.
The language model is trained, so SQL cannot express the whole; tests hold each stage against brute force.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from factorspark.llm import decontam, lang_cnn, mixing, near_join, sharding
from factorspark.session import shared_folder

ORACLE_SQL = None

# Parameters of the mix: domains of the sources, weights of tree nodes (others 1), part of all tokens to keep.
DOMAINS = {f"src{k}": ("web", "books", "forums", "code")[k // 5] for k in range(20)}
WEIGHTS = {"web": 4, "books": 3, "forums": 2, "code": 2, "web/en": 3, "books/en": 2}
SHARE = 0.8


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the byte network tells; texts without letters and unclear ones go."""
    return lang_cnn.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by shared 5-word shingles."""
    return near_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that resembles a benchmark item."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights take in one epoch."""
    return mixing.keep_mixed(docs, DOMAINS, WEIGHTS, SHARE)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and the slot of every document left."""
    return sharding.balanced_shards(docs)


STAGES = [
    ("language_id", languages),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
