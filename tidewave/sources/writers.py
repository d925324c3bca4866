"""Writers that can be started again: datasets in parts by key, published versions, keyed sinks of streams.

What is published lies in a folder of its own for each version; a row in a small table of pointers, written last, makes a version
the current one. So a job that fails leaves the version before it in place, and who has begun to read one can finish.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidewave.operators import network

POINTERS = "version long, folder string"


def written(spark: SparkSession, path: str, schema) -> DataFrame:
    """What a dataset holds so far; no rows if there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def append_missing(plan: DataFrame, path: str, keys: list[str], build: Callable[[DataFrame], DataFrame], by: tuple[str, ...] = ()) -> None:
    """Builds and appends the rows of the plan whose keys the dataset lacks. The committer publishes all of them or none.

    A dataset with keys that the plan lacks was written for another plan, which is an error.
    """
    done = written(plan.sparkSession, path, plan.select(*keys).schema)
    strange = done.join(plan.select(*keys), keys, "left_anti").limit(1).collect()
    if strange:
        raise ValueError(f"{path} was written for another plan: {strange[0]}")
    build(plan.join(done.distinct(), keys, "left_anti")).write.mode("append").partitionBy(*by).parquet(path)


def versions(spark: SparkSession, path: str) -> DataFrame:
    """(version, folder) of all that was published at path; no rows if nothing was."""
    return written(spark, f"{path}/pointers", POINTERS)


def publish(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> int:
    """Writes df as the next version and then points to it; its number. Of two that are published at once under a number, the larger folder name is current."""
    spark, folder = df.sparkSession, uuid.uuid4().hex
    df.write.partitionBy(*by).parquet(f"{path}/{folder}")
    number = (versions(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    spark.createDataFrame([(number, folder)], POINTERS).coalesce(1).write.mode("append").parquet(f"{path}/pointers")
    return number


def published(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The current version of what is published at path, or a given one."""
    pointers = versions(spark, path)
    pointers = pointers if version is None else pointers.where(F.col("version") == version)
    newest = pointers.agg(F.max(F.struct("version", "folder"))["folder"]).first()[0]
    if newest is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.parquet(f"{path}/{newest}")


def keyed_sink(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: a batch's rows in a folder of its number, without those whose keys earlier batches have.

    A batch that is run again, after a loss between its write and its commit, takes the place of its first run, so each key is there once.
    """

    def put(batch: DataFrame, number: int) -> None:
        earlier = written(batch.sparkSession, path, batch.select("*", F.lit(0).cast("long").alias("batch")).schema).where(F.col("batch") < number)
        new = batch.dropDuplicates(keys).join(earlier.select(*keys), keys, "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return put


def dataset(df: DataFrame, path: str, at: str, width: float, files: int) -> int:
    """Publishes a dataset by split and time file (at div width): about `files` files in all, each of a split's stretch of time, in order.

    A scan of a split and a stretch of time (readers.dataset) opens the files of that split and those time files alone, and
    within them the row groups whose times fit.
    """
    placed = df.withColumn("time_file", F.floor(F.col(at) / width))
    ranged = placed.repartitionByRange(files, "split", "time_file", at).sortWithinPartitions("split", "time_file", at)
    return publish(ranged, path, ("split", "time_file"))


def scores(df: DataFrame, path: str) -> int:
    """A score table, one folder for each dataset that it scores."""
    return publish(df, path, ("dataset",))


def attributes(spark: SparkSession, path: str, values: dict[str, object]) -> int:
    """A dataset's attributes (geometry, seeds, norms) as rows of name and value."""
    return publish(spark.createDataFrame([(k, str(v)) for k, v in sorted(values.items())], "name string, value string").coalesce(1), path)


def best_checkpoint(epochs: DataFrame, keys: list[str], metric: str = "val_auc") -> DataFrame:
    """The weights of the best epoch of each key, the earliest of equal ones."""
    return epochs.groupBy(*keys).agg(F.max_by(F.struct("epoch", metric, "weights"), F.struct(F.col(metric), -F.col("epoch"))).alias("_b")).select(*keys, "_b.*")


def model(spark: SparkSession, path: str, weights: dict) -> int:
    """A network's weights as rows of name, shape and values."""
    return publish(spark.createDataFrame(network.to_rows(weights), "name string, shape array<int>, x array<double>").coalesce(1), path)
