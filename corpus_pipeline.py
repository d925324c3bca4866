"""From documents to shards: language, near-duplicates, benchmark leaks, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of docs, with the columns of docs; the last adds its
own. run() writes each stage's rows as Parquet in the shared folder and goes on from there.

Null and empty texts go in the first stage, which needs a letter; later stages by themselves keep them. A null
doc_id, lang or source keeps no row from any stage. Rows that repeat a doc_id count as one document, of which
near-duplicate removal keeps one row. Ties go to the smaller name, id or hash, as the operators state. An empty table gives
an empty result. Extra columns stay, whatever their names, but for those that sharding adds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewave.llm import decontaminate, language_id, mixing, near_dedup, sharding
from tidewave.llm._spark import shared_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, with the language found as lang; those without a letter or a clear language go."""
    return language_id.accept(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; documents without a text or an id stay."""
    return near_dedup.deduplicate(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents whose tokens have the tempered marginals; null categories are categories."""
    return mixing.sample(docs)


def deal_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each with its shard and its place there, by a map stored in the shared folder."""
    return sharding.shard(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", deal_into_shards),
]

#: Language models, sketches and BM25 are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
