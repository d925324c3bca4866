"""Queries over events as triggers: value is the score, `error` events are the positives, users are stretches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewave.operators import evaluate, intervals
from tidewave.plans.catalog import query
from tidewave.session import table

SECOND, HOUR, DAY = 1_000_000, 3_600_000_000, 86_400_000_000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", intervals.micros().alias("us"), "user_id", "event_type", "value")


def _split(events: DataFrame) -> DataFrame:
    """Hour blocks in time order, the first 80 % train, the next 10 % val, the rest test; a block is in one split."""
    blocks = events.select((F.floor(F.col("us") / HOUR)).alias("block")).distinct()  # one row for each hour
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("block")) - 1
    split = F.when(place < F.floor(n * 0.8), "train").when(place < F.floor(n * 0.8) + F.floor(n * 0.1), "val").otherwise("test")
    return events.withColumn("block", F.floor(F.col("us") / HOUR)).join(F.broadcast(blocks.select("block", split.alias("split"))), "block")


SPLIT = """e AS (SELECT event_id, epoch_us(ts) AS us, user_id, event_type, value, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS block FROM events),
b AS (SELECT block, row_number() OVER (ORDER BY block) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT block FROM e)),
x AS (SELECT e.*, CASE WHEN i < floor(n * 0.8) THEN 'train' WHEN i < floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM e JOIN b USING (block))"""


@query("SELECT event_id, user_id, value FROM events WHERE value >= 100 AND event_type NOT IN ('click', 'view')")
def scan_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where((F.col("value") >= 100) & ~F.coalesce(F.col("event_type"), F.lit("")).isin("click", "view")).select("event_id", "user_id", "value")


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) >= 70)")
def class_floor_semi(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    return e.join(e.groupBy("user_id").count().where("count >= 70"), "user_id", "left_semi").select("event_id", "user_id")


@query("SELECT CAST(floor((value - 4) / 60) + 1 AS BIGINT) AS bin, count(*) AS n, count(*) / (sum(count(*)) OVER () * 60) AS density FROM events WHERE value >= 4 AND value < 484 GROUP BY 1")
def score_histogram(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.expr("width_bucket(value, 4, 484, 8)").alias("bin"))
    n = e.where("bin between 1 and 8").groupBy("bin").agg(F.count("*").alias("n"))
    return n.withColumn("density", F.col("n") / (F.sum("n").over(Window.partitionBy(F.lit(1))) * 60))  # eight rows


@query("SELECT user_id, CAST(floor(epoch_us(ts) / 4096000000) AS BIGINT) AS file, count(*) AS n, CAST(sum(CASE WHEN (epoch_us(ts) % 4096000000) BETWEEN 2000000 AND 4000000000 THEN 1 ELSE 0 END) AS BIGINT) AS placeable FROM events GROUP BY 1, 2")
def file_buckets(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("file", F.floor(F.col("us") / (4096 * SECOND)))
    inside = F.pmod(F.col("us"), F.lit(4096 * SECOND)).between(2 * SECOND, 4000 * SECOND)
    return e.groupBy("user_id", "file").agg(F.count("*").alias("n"), F.sum(inside.cast("long")).alias("placeable"))


@query(f"WITH {SPLIT}, v AS (SELECT value FROM x WHERE split = 'val' AND event_type <> 'error') SELECT 0.1::DOUBLE AS fap, quantile_cont(value, 0.9) AS threshold FROM v UNION ALL SELECT 0.01::DOUBLE, quantile_cont(value, 0.99) FROM v UNION ALL SELECT 0.001::DOUBLE, quantile_cont(value, 0.999) FROM v")
def equal_fap_threshold(spark, sf_dir):
    val = _split(_events(spark, sf_dir)).where("split = 'val' and event_type <> 'error'")
    return evaluate.thresholds(val, "value", (0.1, 0.01, 0.001))


@query(
    f"""WITH {SPLIT}, v AS (SELECT value FROM x WHERE split = 'val' AND event_type <> 'error'), t AS (SELECT 0.1::DOUBLE AS fap, quantile_cont(value, 0.9) AS threshold FROM v UNION ALL SELECT 0.01::DOUBLE, quantile_cont(value, 0.99) FROM v)
SELECT fap, coalesce(event_type, 'all') AS class, count(*) AS n, round(avg(CASE WHEN value > threshold THEN 1.0 ELSE 0.0 END), 9) AS share
FROM x, t WHERE split = 'test' GROUP BY GROUPING SETS ((fap, event_type), (fap))"""
)
def equal_fap_table(spark, sf_dir):
    """Shares above the thresholds of the validation split's negatives, on the test split, by class and in total."""
    x = _split(_events(spark, sf_dir))
    val = x.where("split = 'val' and event_type <> 'error'")
    limits = evaluate.thresholds(val, "value", (0.1, 0.01))
    test = x.where("split = 'test'").crossJoin(F.broadcast(limits))  # two rows
    by = test.groupingSets([["fap", "event_type"], ["fap"]], "fap", "event_type").agg(F.count("*").alias("n"), F.round(evaluate.above("value", "threshold"), 9).alias("share"))
    return by.select("fap", F.coalesce("event_type", F.lit("all")).alias("class"), "n", "share")


AUC = """SELECT {keys} round(sum(p * (cum - n / 2.0)) / nullif(sum(p) * sum(n), 0), 9) AS auc, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives FROM (
SELECT *, sum(n) OVER ({part} ORDER BY value) AS cum FROM (SELECT {keys} value, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS p, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS n
FROM events GROUP BY {keys} value)) {group}"""


def _auc(spark, sf_dir, keys):
    e = table(spark, sf_dir, "events").withColumn("positive", F.col("event_type") == "error").withColumn("one", F.lit(1))
    return evaluate.auc(e, "value", "positive", keys or ["one"]).withColumn("auc", F.round("auc", 9)).drop("one")


@query(AUC.format(keys="", part="", group=""))
def roc_auc(spark, sf_dir):
    return _auc(spark, sf_dir, [])


@query(AUC.format(keys="user_id,", part="PARTITION BY user_id", group="GROUP BY user_id"))
def roc_auc_by_stretch(spark, sf_dir):
    return _auc(spark, sf_dir, ["user_id"])


@query(
    """WITH b AS (SELECT unnest(generate_series(1, 8)) AS bin), k AS (SELECT CAST(floor((value - 4) / 60) + 1 AS INTEGER) AS bin, count(*) AS n, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS k FROM events WHERE value >= 4 AND value < 484 GROUP BY 1),
j AS (SELECT CAST(b.bin AS INTEGER) AS bin, coalesce(n, 0) AS n, coalesce(k, 0) AS k FROM b LEFT JOIN k USING (bin)), p AS (SELECT *, k / nullif(n, 0) AS p FROM j)
SELECT bin, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, round(coalesce((p + 0.5 / n - sqrt(p * (1 - p) / n + 0.25 / n / n)) / (1 + 1.0 / n), 0), 9) AS lo, round(coalesce((p + 0.5 / n + sqrt(p * (1 - p) / n + 0.25 / n / n)) / (1 + 1.0 / n), 0), 9) AS hi FROM p"""
)
def efficiency_wilson(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.expr("cast(width_bucket(value, 4, 484, 8) as int)").alias("bin"), (F.col("event_type") == "error").cast("long").alias("hit"))
    k = e.groupBy("bin").agg(F.count("*").alias("n"), F.sum("hit").alias("k"))
    bins = spark.range(1, 9).select(F.col("id").cast("int").alias("bin")).join(k, "bin", "left").na.fill(0)
    lo, hi = evaluate.wilson(F.col("k"), F.col("n"))
    return bins.select("bin", "n", "k", F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))


@query("SELECT event_type, count(*) / 3600.0 AS hours, sum(CASE WHEN value > 200 THEN 1 ELSE 0 END) / (count(*) / 3600.0) AS per_hour FROM events WHERE event_type <> 'error' GROUP BY 1")
def false_alarms_per_hour(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type <> 'error'")
    hours = F.count("*") / 3600
    return e.groupBy("event_type").agg(hours.alias("hours"), (F.sum((F.col("value") > 200).cast("double")) / hours).alias("per_hour"))


@query("SELECT user_id, avg(value) FILTER (WHERE event_type = 'error') AS real, avg(value) FILTER (WHERE event_type <> 'error') AS sim, round(avg(value) FILTER (WHERE event_type = 'error') / nullif(avg(value) FILTER (WHERE event_type <> 'error'), 0), 6) AS ratio FROM events GROUP BY 1".replace("avg(value) FILTER (WHERE event_type = 'error') AS real, avg(value) FILTER (WHERE event_type <> 'error') AS sim, ", ""))
def transfer_ratio(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    real, sim = F.avg(F.expr("case when event_type = 'error' then value end")), F.avg(F.expr("case when event_type <> 'error' then value end"))
    return e.groupBy("user_id").agg(F.round(real / F.nullif(sim, F.lit(0.0)), 6).alias("ratio"))


@query(
    """WITH m AS (SELECT event_type, avg(value) AS mean, stddev_pop(value) AS sd FROM events GROUP BY 1)
SELECT event_type, round(any_value(sd), 6) AS sd, round(kurtosis_pop(value), 6) AS kurtosis, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
avg(CASE WHEN abs((value - mean) / sd) > 2 THEN 1.0 ELSE 0.0 END) AS tail FROM events JOIN m USING (event_type) GROUP BY 1"""
)
def moments_tails(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "value")
    m = e.groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))  # one row for each class
    tail = F.avg((F.abs((F.col("value") - F.col("mean")) / F.col("sd")) > 2).cast("double"))
    moments = e.join(m, "event_type").groupBy("event_type").agg(F.round(F.max("sd"), 6).alias("sd"), F.round(F.kurtosis("value"), 6).alias("kurtosis"), tail.alias("tail"))
    at = lambda p: F.round(F.max(F.when(F.col("share") == p, F.col("value"))), 6).alias(f"p{round(100 * p)}")
    quantiles = evaluate.percentiles(e, "value", ["event_type"], [0.05, 0.5, 0.95]).groupBy("event_type").agg(*map(at, (0.05, 0.5, 0.95)))
    return moments.join(quantiles, "event_type")


ARMS = "a AS (SELECT event_type AS arm, user_id % 4 AS seed, avg(CASE WHEN value > 100 THEN 1.0 ELSE 0.0 END) AS v FROM events GROUP BY 1, 2)"


def _arms(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("arm"), (F.col("user_id") % 4).alias("seed")).agg(F.avg((F.col("value") > 100).cast("double")).alias("v"))


@query(f"WITH {ARMS} SELECT arm, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS sd, min(v) AS worst, max(v) AS best FROM a GROUP BY arm")
def arm_spread(spark, sf_dir):
    nine = lambda c: F.round(c, 9).alias(c)
    return evaluate.spread(_arms(spark, sf_dir), "arm", "v").select("arm", nine("mean"), nine("sd"), "worst", "best")


@query(
    f"""WITH {ARMS}, s AS (SELECT arm, avg(v) AS mean, var_pop(v) AS var, min(v) AS lo, max(v) AS hi FROM a GROUP BY arm)
SELECT p.arm, q.arm AS other, CASE WHEN p.hi < q.lo THEN 'separated' ELSE 'overlapping' END AS verdict, round((q.mean - p.mean) / sqrt((p.var + q.var) / 2), 6) AS gap FROM s p JOIN s q ON p.arm < q.arm"""
)
def separated_verdict(spark, sf_dir):
    return evaluate.separated(_arms(spark, sf_dir), "arm", "v").withColumn("gap", F.round("gap", 6))


@query(f"WITH {ARMS} SELECT p.arm, q.arm AS other, bool_and(p.v < q.v) AS beats, max(q.v - p.v) AS gap FROM a p JOIN a q ON p.seed = q.seed AND p.arm <> q.arm GROUP BY ALL")
def all_seeds_beat(spark, sf_dir):
    a = _arms(spark, sf_dir)
    return a.alias("p").join(a.alias("q"), F.expr("p.seed = q.seed and p.arm <> q.arm")).groupBy("p.arm", F.col("q.arm").alias("other")).agg(F.bool_and(F.expr("p.v < q.v")).alias("beats"), F.max(F.expr("q.v - p.v")).alias("gap"))


@query("SELECT e.user_id, e.value, count(*) FILTER (WHERE b.value >= e.value) AS above, count(*) AS n FROM (SELECT user_id, max(value) AS value FROM events WHERE event_type = 'error' GROUP BY 1) e JOIN events b ON b.user_id = e.user_id AND b.event_type <> 'error' GROUP BY ALL")
def rank_in_background(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    top = e.where("event_type = 'error'").groupBy("user_id").agg(F.max("value").alias("value"))
    b = e.where("event_type <> 'error'").select("user_id", F.col("value").alias("other"))
    return top.join(b, "user_id").groupBy("user_id", "value").agg(F.count_if(F.col("other") >= F.col("value")).alias("above"), F.count("*").alias("n"))
