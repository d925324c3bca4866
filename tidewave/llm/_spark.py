"""Small shared parts: checkpoints, Arrow batches and connected components."""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where all runs in one process, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage, kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def drop_unused(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of tables that nothing refers to any more: it does so when the driver's garbage is collected, which a driver with little work may put off for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: A side of a join that is counted to have at most so many bytes is broadcast.
BROADCAST_BYTES = 32 << 20


def map_texts(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow over batches of at most BATCH_ROWS rows and BATCH_BYTES (or one row): a batch is held on both sides of the pipe to Python.

    Spark reads the limits when the plan runs, so they stay set in the session, unless that has lower ones. A task that
    ends gives its freed memory back, as the worker lives on.
    """
    conf = df.sparkSession.conf
    for name, limit in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        own = int(conf.get(name, str(limit + 1)).rstrip("b"))
        if not 0 < own <= limit:
            conf.set(name, limit)

    def runs(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(runs, schema)


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over undirected edges (a, b), for every id that has one.

    Each round hooks every id to its smallest neighbour, follows that one's hook too, and puts these in
    place of the ids in the edges. Edges within a tree go, so each round leaves at most half of the ids, and an edge
    is joined in few rounds. The smallest id of a component hooks to itself throughout. Each round is cut from
    its lineage.
    """
    ordered = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    rest = cut(edges.where("a <> b").select(*ordered("a", "b")).distinct())
    labels = None
    while not rest.isEmpty():
        near = rest.select("a", "b").union(rest.select(F.col("b"), F.col("a"))).groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near"))
        hook = cut(near.select("id", F.least("id", "near").alias("to")))
        tree = cut(hook.join(hook.select(F.col("id").alias("to"), F.col("to").alias("component")), "to").select("id", "component"))
        if labels is None:
            labels = tree
        else:
            up = tree.select(F.col("id").alias("component"), F.col("component").alias("above"))
            labels = cut(labels.join(up, "component", "left").select("id", F.coalesce("above", "component").alias("component")))
        of = lambda c: tree.select(F.col("id").alias(c), F.col("component").alias(f"{c}_in"))  # noqa: B023, E731
        inner = rest.join(of("a"), "a").join(of("b"), "b").where("a_in <> b_in")
        rest = cut(inner.select(*ordered("a_in", "b_in")).distinct())
    return labels if labels is not None else rest.select(F.col("a").alias("id"), F.col("b").alias("component"))
