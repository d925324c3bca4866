"""Score summaries that add up: exact counts by score, kept by day, from which tables come without reading scores again.

A summary has one row for each day, group and score, the score as a whole number of units (hundredths, say). For scores that are
whole units everything that counts and ranks give is exact; for others a score is off by half a unit at most. Summaries of
different days or arms add up to that of both, and a day that is written again takes the place of what it had.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.operators import evaluate
from tidewave.sources.writers import written

UNITS = "units"


def summarise(scores: DataFrame, score: str, keys: list[str], per_unit: int = 100) -> DataFrame:
    """(*keys, units, n): rows by key and score; null scores have null units."""
    return scores.groupBy(*keys, F.round(F.col(score) * per_unit).cast("long").alias(UNITS)).agg(F.count("*").alias("n"))


def store(summary: DataFrame, path: str, day: str = "day") -> None:
    """Writes the summary's days, in place of those days as far as they are there; other days stay."""
    summary.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return written(spark, path, like.schema)


def merged(summary: DataFrame, keys: list[str]) -> DataFrame:
    """The summary by fewer keys: sums over the others."""
    return summary.groupBy(*keys, UNITS).agg(F.sum("n").alias("n"))


def value(per_unit: int = 100) -> Column:
    return F.col(UNITS) / per_unit


def thresholds(negatives: DataFrame, faps: tuple[float, ...], per_unit: int = 100) -> DataFrame:
    """(fap, threshold) from a summary of negatives."""
    own = negatives.select(value(per_unit).alias("_value"), "n")
    return evaluate.thresholds(own, "_value", faps, F.col("n"))


def shares_above(summary: DataFrame, limits: DataFrame, keys: list[str], per_unit: int = 100) -> DataFrame:
    """(fap, *keys, n, share) and, with null keys, of all: rows above each threshold."""
    hit = F.when(value(per_unit) > F.col("threshold"), F.col("n")).otherwise(0)
    met = summary.crossJoin(F.broadcast(limits))  # as many rows as thresholds
    counted = F.sum(F.when(F.col(UNITS).isNotNull(), F.col("n")))
    return met.groupingSets([["fap", *keys], ["fap"]], "fap", *keys).agg(F.sum("n").alias("total"), (F.sum(F.when(F.col(UNITS).isNotNull(), hit)) / counted).alias("share"))


def auc(summary: DataFrame, positive: str, keys: list[str]) -> DataFrame:
    """Area under the ROC curve by key."""
    return evaluate.auc(summary, UNITS, positive, keys, F.col("n"))
