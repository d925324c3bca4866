"""One query for each operator, over its whole table with the parameters of production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm import decontaminate, filter_audit, html_extract, language_id, license_scan, line_dedup, mixing, near_dedup, periodic_runs, pii, sharding, topk_search, toxicity

#: A deployment takes its own from where it keeps secrets.
PII_KEY = "example key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's directory is its source, then its id without the last four and the last two digits; a text of which licence lines are half or more is a LICENSE file of that directory."""
    docs = _table(spark, sf_dir, "documents")
    name = F.when(2 * F.coalesce(F.length(license_scan.header()), F.lit(0)) >= F.length("text"), F.concat(F.lit("LICENSE-"), F.col("doc_id"))).otherwise(F.concat(F.lit("text-"), F.col("doc_id")))
    top = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.expr("doc_id div 10000").cast("string"), F.expr("doc_id div 100").cast("string"))
    return license_scan.scan(docs.select("doc_id", F.concat_ws("/", top, name).alias("path"), "text"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs, shards=24).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "vslot", "version")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.quantised(_table(spark, sf_dir, "embeddings"))
    return topk_search.search(vectors.where("vec_id % 50 = 0"), vectors, k=5)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate(_table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents"), key=PII_KEY).select("doc_id", "text", "n_values")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("topic", mixing.topic())
    none = lambda c: F.coalesce(c, F.lit(mixing.NONE)).alias(c)
    six = lambda c: F.round(c, 6).alias(c)
    return mixing.probabilities(docs).select("doc_id", none("source"), none("lang"), "topic", "tokens", six("multiplier"), six("probability"), "kept")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.detect(periodic_runs.with_planted_runs(_table(spark, sf_dir, "documents"))))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op5_topk_search": topk_search.ORACLE, "op10_mixing": mixing.oracle(), "op11_filter_audit": filter_audit.ORACLE}
