"""Queries through the sources, sinks, streams and stored tables: what was written is read back and counted."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.operators import evaluate, layout, summaries, training
from tidewave.plans.catalog import query
from tidewave.plans.detection import AUC, DAY, HOUR, SPLIT, _events, _split
from tidewave.plans.spans import B, E, _blocks
from tidewave.session import shared_folder, table
from tidewave.sources import readers, writers
from tidewave.sources.strain_files import StrainFiles
from tidewave.streaming import alarms, ordered

LATE = "10 minutes"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@query(f"WITH {E}, b AS (SELECT event_type AS detector, CAST(floor(us / 86400000000) AS BIGINT) * 86400 AS gps, value FROM e) SELECT detector, gps, count(*) AS samples, round(sum(value), 6) AS total FROM b WHERE gps >= 1704412800 AND gps < 1705708800 AND detector <> 'error' GROUP BY ALL")
def strain_blocks(spark, sf_dir):
    """A class's values of a day as a block of samples: written as files, and those of some days read in fetch groups."""
    spark.dataSource.register(StrainFiles)
    spark.conf.set(PUSHDOWN, "true")
    e, path = _events(spark, sf_dir), _folder(spark)
    values = F.transform(F.array_sort(F.collect_list(F.struct("us", "event_id", "value"))), lambda x: x["value"])
    blocks = e.groupBy(F.col("event_type").alias("detector"), (F.floor(F.col("us") / DAY) * 86_400).alias("gps")).agg(values.alias("strain"))
    blocks.select("detector", "gps", F.lit(86_400).alias("seconds"), "strain").write.format("strain_files").mode("append").save(path)
    read = spark.read.format("strain_files").load(path).where("gps >= 1704412800 and gps < 1705708800 and detector <> 'error'")
    return read.select("detector", "gps", F.size("strain").cast("long").alias("samples"), F.round(F.aggregate("strain", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"WITH {B}, i AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id, k ORDER BY block) = 1 THEN 0 ELSE 1 END AS role FROM (SELECT *, block - row_number() OVER (PARTITION BY user_id ORDER BY block) AS k FROM b)) SELECT user_id, block, role, CAST(before AS BIGINT) AS done FROM (SELECT *, sum(role) OVER (PARTITION BY user_id ORDER BY block) - role AS before FROM i) WHERE before < 5")
def quota_layout(spark, sf_dir):
    return layout.laid_out(_blocks(spark, sf_dir), "user_id", 5)


@query("SELECT 1::BIGINT AS version, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type <> 'error' UNION ALL SELECT 2, count(*), round(sum(value), 4) FROM events")
def published_versions(spark, sf_dir):
    """Two versions of a table, the second in place of the first; both can be read."""
    e, path = table(spark, sf_dir, "events").select("event_id", "event_type", "value"), _folder(spark)
    numbers = [writers.publish(e.where("event_type <> 'error'"), path), writers.publish(e, path, ("event_type",))]
    each = [writers.published(spark, path, n).agg(F.lit(n).cast("long").alias("version"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")) for n in numbers]
    return each[0].unionByName(each[1])


def _streamed(spark: SparkSession, sf_dir: str, build: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """All that a stream over events gives, through a sink that holds each key once."""
    folder = _folder(spark)
    schema = table(spark, sf_dir, "events").schema
    pattern = f"{sf_dir}/events.parque[t]"  # a stream takes a pattern where it would not take one file
    events = spark.readStream.schema(schema).parquet(pattern).withColumn("ts", F.col("ts").cast("timestamp"))
    # a stream's state has as many parts as its first run has shuffle partitions: some for each core, not one for each of a large default
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    own = dict([ordered.STATE_STORE, ("spark.sql.shuffle.partitions", str(parts))])
    old = {name: spark.conf.get(name) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        stream = build(events)
        run = stream.writeStream.foreachBatch(writers.keyed_sink(f"{folder}/out", keys)).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)
    return writers.written(spark, f"{folder}/out", stream.schema).select(*stream.columns)


W = "w AS (SELECT (max(us) // 1000 - 600000) * 1000 AS passed FROM e)"


@query(
    f"""WITH RECURSIVE {E}, {W}, k(user_id, us) AS (SELECT user_id, min(us) FROM e GROUP BY 1 UNION ALL
SELECT k.user_id, (SELECT min(e.us) FROM e WHERE e.user_id = k.user_id AND e.us >= k.us + 28800000000) FROM k WHERE k.us IS NOT NULL) SELECT user_id, us FROM k, w WHERE us < passed"""
)
def streamed_spacing(spark, sf_dir):
    """The greedy choice of triggers as a stream: all that the watermark has passed."""
    return _streamed(spark, sf_dir, lambda e: ordered.spaced(e, "ts", 8 * HOUR, ["user_id"], LATE), ["user_id", "us"])


@query(
    f"""WITH {E}, {W}, d AS (SELECT user_id, us, max(value) AS value FROM e, w WHERE us < passed GROUP BY 1, 2),
g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) > 21600000000 THEN 1 ELSE 0 END AS fresh FROM d), c AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us) AS cluster FROM g)
SELECT user_id, min(us) AS first, max(us) AS last, count(*) AS n, arg_max(us, (value, -us)) AS us, max(value) AS value FROM c, w GROUP BY user_id, cluster, passed HAVING max(us) + 21600000001 < passed"""
)
def streamed_clusters(spark, sf_dir):
    """Clusters of triggers as a stream: those that are over when the watermark has passed."""
    return _streamed(spark, sf_dir, lambda e: ordered.gap_clusters(e, "ts", "value", 6 * HOUR, ["user_id"], LATE), ["user_id", "first"])


def _summary(spark, sf_dir) -> DataFrame:
    """Exact counts by hour, class and score, stored by day: first all days but the last, then that one, as a day's job adds it."""
    path = _folder(spark)
    e = _events(spark, sf_dir).withColumns({"block": F.floor(F.col("us") / HOUR), "day": F.floor(F.col("us") / DAY)})
    counts = summaries.summarise(e, "value", ["day", "block", "event_type"])
    last = e.agg(F.max("day")).first()[0]
    if last is None:
        return counts
    for part in (F.col("day") < last, F.col("day") == last, F.col("day") == last):  # a job that runs again adds nothing
        summaries.store(counts.where(part), path)
    return summaries.stored(spark, path, counts)


@query(
    f"""WITH {SPLIT}, v AS (SELECT value FROM x WHERE split = 'val' AND event_type <> 'error'), t AS (SELECT 0.1::DOUBLE AS fap, quantile_cont(value, 0.9) AS threshold FROM v UNION ALL SELECT 0.01::DOUBLE, quantile_cont(value, 0.99) FROM v)
SELECT fap, coalesce(event_type, 'all') AS class, count(*) AS n, round(avg(CASE WHEN value > threshold THEN 1.0 ELSE 0.0 END), 9) AS share
FROM x, t WHERE split = 'test' GROUP BY GROUPING SETS ((fap, event_type), (fap))"""
)
def summary_fap_table(spark, sf_dir):
    """equal_fap_table from stored summaries alone."""
    own = _split(_summary(spark, sf_dir).withColumn("us", F.col("block") * HOUR))
    limits = summaries.thresholds(own.where("split = 'val' and event_type <> 'error'"), (0.1, 0.01))
    test = summaries.merged(own.where("split = 'test'"), ["event_type"])
    found = summaries.shares_above(test, limits, ["event_type"])
    return found.select("fap", F.coalesce("event_type", F.lit("all")).alias("class"), F.col("total").alias("n"), F.round("share", 9).alias("share"))


@query(AUC.format(keys="", part="", group=""))
def summary_auc(spark, sf_dir):
    own = summaries.merged(_summary(spark, sf_dir), ["event_type"]).select(F.lit(1).alias("one"), (F.col("event_type") == "error").alias("positive"), summaries.UNITS, "n")
    return summaries.auc(own, "positive", ["one"]).withColumn("auc", F.round("auc", 9)).drop("one")


def _labelled(spark, sf_dir) -> DataFrame:
    """Vectors with an even label as y, in three splits by id; x_half has the first half of each vector."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null and label is not null")
    split = F.when(F.col("vec_id") % 10 < 7, "train").when(F.col("vec_id") % 10 == 7, "val").otherwise("test")
    x = F.transform("embedding", lambda v: 8 * v.cast("double"))
    rows = e.select("vec_id", split.alias("split"), (F.col("label") % 2 == 0).cast("int").alias("y"), x.alias("x"), F.slice(x, 1, F.floor(F.size(x) / 2).cast("int")).alias("x_half"))
    return training.laid_out(rows, f"{_folder(spark)}/rows", "vec_id", 2)


@query()
def dense_training(spark, sf_dir):
    """A dense scorer trained on the vectors: the losses and the validation AUC of each epoch."""
    run = training.Run("whole", 7, "x")
    (found,) = training.fit(_labelled(spark, sf_dir), [run], (16,), f"{_folder(spark)}/state", epochs=5, rate=0.02).values()
    return spark.createDataFrame([(int(e), *map(float, rest)) for e, *rest in found.history], "epoch int, train_loss double, val_loss double, val_auc double")


@query()
def seed_sweep(spark, sf_dir):
    """Two arms, whole and half vectors, with three seeds each: whether their test AUCs are apart whatever the seed."""
    results = training.sweep(_labelled(spark, sf_dir), {"half": "x_half", "whole": "x"}, [1, 2, 3], (8,), f"{_folder(spark)}/state", epochs=3, rate=0.02)
    return evaluate.separated(results, "arm", "auc")


@query(f"WITH {SPLIT} SELECT event_id, us, split, value FROM x WHERE split = 'train' AND us >= 1704844800000000 AND us < 1705017600000000")
def dataset_window(spark, sf_dir):
    """Two days of the training split from a dataset that is laid out by split and time."""
    path = _folder(spark)
    x = _split(_events(spark, sf_dir)).select("event_id", "us", "split", "value")
    writers.dataset(x, path, "us", DAY, 8)
    return readers.dataset(spark, path, "us", DAY, "train", 1704844800000000, 1705017600000000)


@query(
    f"""WITH {E} SELECT us // 1000000 AS peak_time, value AS snr, event_type AS ml_label, round(us // 1000000 + (us % 1000000) * 1000 * 1e-9::DOUBLE, 5) AS gps
FROM e WHERE event_id % 10 >= 6 AND event_type <> 'click'"""
)
def trigger_file(spark, sf_dir):
    """Triggers written as a file with a header and more columns than are read, and those of enough confidence and of wanted classes read back."""
    path = _folder(spark)
    us = F.col("us")
    e = _events(spark, sf_dir)
    e.select(
        F.col("event_type").alias("ml_label"), F.expr("us div 1000000").alias("peak_time"), (us % 1_000_000 * 1000).alias("peak_time_ns"), F.lit("more").alias("note"),
        F.col("value").alias("snr"), F.lit(0.1).alias("duration"), F.lit(100.0).alias("peak_frequency"), (F.col("event_id") % 10 / 10).alias("ml_confidence"),
    ).write.option("header", True).csv(path)
    return readers.triggers(spark, path, 0.6, ("click",)).select("peak_time", "snr", "ml_label", F.round("gps", 5).alias("gps"))


@query("SELECT event_id, event_type, value * 2 AS twice FROM events")
def resumed_dataset(spark, sf_dir):
    """A dataset of which a first run wrote a part: the second builds and adds what is missing, a third adds nothing."""
    path = f"{_folder(spark)}/rows"
    plan = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    build = lambda rows: rows.select("event_id", (F.col("value") * 2).alias("twice"), "event_type")
    for part in (plan.where("event_id % 3 = 0"), plan, plan):
        writers.append_missing(part, path, ["event_id"], build, ("event_type",))
    return spark.read.parquet(path).select("event_id", "event_type", "twice")


@query("SELECT event_id, value AS rho FROM events WHERE event_type = 'error'")
def score_scan(spark, sf_dir):
    """The scores of one dataset from a table of several, whose folder alone is read."""
    path = _folder(spark)
    writers.scores(table(spark, sf_dir, "events").select(F.col("event_type").alias("dataset"), "event_id", F.col("value").alias("rho")), path)
    return readers.scores(spark, path, "error", ("event_id", "rho"))


@query(
    f"""WITH {E}, d AS (SELECT user_id, CAST(floor(us / {DAY}) AS BIGINT) AS epoch, max(value) AS val_auc, count(*) AS n FROM e GROUP BY 1, 2)
SELECT user_id, epoch, val_auc, n AS first FROM d QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY val_auc DESC, epoch) = 1"""
)
def best_checkpoints(spark, sf_dir):
    """Of each user's days, as epochs with weights, the one with the largest metric, the earliest of equal ones."""
    days = _events(spark, sf_dir).groupBy("user_id", F.floor(F.col("us") / DAY).alias("epoch")).agg(F.max("value").alias("val_auc"), F.array(F.count("*")).alias("weights"))
    return writers.best_checkpoint(days, ["user_id"]).select("user_id", "epoch", "val_auc", F.col("weights")[0].alias("first"))


@query(
    f"""WITH {E}, b AS (SELECT * FROM e WHERE event_type <> 'error'), w AS (SELECT (max(us) // 1000 - 600000) * 1000 AS passed FROM b)
SELECT us // {HOUR} * {HOUR} AS start, event_type AS detector, count(*) AS n, CAST(sum(CASE WHEN value > 200 THEN 1 ELSE 0 END) AS BIGINT) AS alarms FROM b, w GROUP BY us // {HOUR}, event_type, passed HAVING (us // {HOUR} + 1) * {HOUR} <= passed"""
)
def streamed_alarms(spark, sf_dir):
    """False alarms by hour and class as a stream: the hours that the watermark has passed."""
    scores = lambda e: e.select("ts", F.col("event_type").alias("detector"), F.col("value").alias("score"), (F.col("event_type") == "error").alias("is_signal"))
    out = _streamed(spark, sf_dir, lambda e: alarms.windowed_alarms(scores(e), 200.0, late=LATE), ["start", "detector"])
    return out.select(F.unix_micros("start").alias("start"), "detector", "n", "alarms")
