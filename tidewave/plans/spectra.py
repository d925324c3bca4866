"""Checks of spectra: embeddings as crops of 64 samples, and hours of events as crops of their values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewave.operators import signal
from tidewave.plans.catalog import query
from tidewave.plans.crops import X, _crops
from tidewave.plans.detection import HOUR, SPLIT, _events, _split

#: Frequencies of a crop, 0 to 32, and the bands whose powers a tilt compares.
LAST, LOW, HIGH = 32, (1, 2), (7, 10)
_SUM = "list_sum(list_transform(range(1, 65), lambda n: v[n] * {f}(2 * pi() * k * (n - 1) / 64)))"
P = f"{X}, p AS (SELECT vec_id, label, k, pow({_SUM.format(f='cos')}, 2) + pow({_SUM.format(f='sin')}, 2) AS p FROM x, (SELECT unnest(range(0, 33)) AS k))"


def _powers(spark, sf_dir):
    """(vec_id, label, k, p): the power of each crop at each frequency."""
    return signal.powers(_crops(spark, sf_dir), "v").select("vec_id", "label", F.posexplode("p").alias("k", "p"))


@query(f"WITH {P}, m AS (SELECT label, k, avg(p) AS p FROM p GROUP BY ALL) SELECT label, round(avg(p) FILTER (k BETWEEN {LOW[0]} AND {LOW[1]}) / avg(p) FILTER (k BETWEEN {HIGH[0]} AND {HIGH[1]}), 6) AS tilt FROM m GROUP BY 1")
def band_tilt(spark, sf_dir):
    """The mean power at a band's bottom over that at its top, of each label's mean spectrum; white noise has 1."""
    mean = _powers(spark, sf_dir).groupBy("label", "k").agg(F.avg("p").alias("p"))
    of = lambda band: F.avg(F.when(F.col("k").between(*band), F.col("p")))
    return mean.groupBy("label").agg(F.round(of(LOW) / of(HIGH), 6).alias("tilt"))


@query(
    f"""WITH {P}, m AS (SELECT label, k, quantile_cont(p, 0.5) AS m FROM p GROUP BY ALL),
n AS (SELECT label, k, unnest(range(k - 4, k + 5)) AS j FROM m), r AS (SELECT label, k, CASE WHEN j < 0 THEN -1 - j WHEN j > {LAST} THEN {2 * LAST + 1} - j ELSE j END AS j FROM n),
s AS (SELECT r.label, r.k, quantile_cont(m.m, 0.5) AS smooth FROM r JOIN m ON m.label = r.label AND m.k = r.j GROUP BY ALL)
SELECT label, CAST(k AS INTEGER) AS k, round(m, 6) AS median, round(smooth, 6) AS smooth FROM m JOIN s USING (label, k)"""
)
def noise_median_spectrum(spark, sf_dir):
    """The median over crops of each frequency's power, and its running median over nine frequencies, mirrored at the ends."""
    m = _powers(spark, sf_dir).groupBy("label", "k").agg(F.percentile("p", F.lit(0.5)).alias("m"))
    by = m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda r: r["m"]).alias("m"))  # 33 numbers
    inside = lambda j: F.when(j < 0, -1 - j).when(j > LAST, 2 * LAST + 1 - j).otherwise(j)
    near = lambda k: F.transform(F.sequence(F.lit(-4), F.lit(4)), lambda d: F.get("m", inside(k + d)))
    rows = by.select("label", F.posexplode(F.transform("m", lambda m, k: F.struct(m.alias("m"), F.array_sort(near(k))[4].alias("s")))).alias("k", "r"))
    return rows.select("label", "k", F.round("r.m", 6).alias("median"), F.round("r.s", 6).alias("smooth"))


@query(
    f"""WITH {SPLIT}, c AS (SELECT event_type, block, split, stddev_pop(value) AS sd FROM x GROUP BY ALL HAVING count(*) >= 2), n AS (SELECT 1 / avg(sd) AS norm FROM c WHERE split = 'train')
SELECT event_type, count(*) AS crops, sum(CASE WHEN sd * norm > 2 THEN 1 ELSE 0 END)::BIGINT AS loud, round(sum(CASE WHEN sd * norm > 2 THEN 1 ELSE 0 END) / count(*), 9) AS per_hour FROM c, n GROUP BY 1"""
)
def loud_crop_rate(spark, sf_dir):
    """Crops (an hour of a class) whose deviation, scaled by the norm of the training crops, is over 2, by hour of data."""
    c = _split(_events(spark, sf_dir)).groupBy("event_type", F.floor(F.col("us") / HOUR).alias("block"), "split").agg(F.stddev_pop("value").alias("sd"), F.count("*").alias("n")).where("n >= 2")
    norm = c.where("split = 'train'").agg((1 / F.avg("sd")).alias("norm"))
    loud = F.count_if(F.col("sd") * F.col("norm") > 2)
    return c.crossJoin(F.broadcast(norm)).groupBy("event_type").agg(F.count("*").alias("crops"), loud.alias("loud"), F.round(loud / F.count("*"), 9).alias("per_hour"))  # the norm is one row
