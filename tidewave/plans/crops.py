"""Queries over embeddings as crops of 64 samples: folds over arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewave.functions import arrays
from tidewave.operators import evaluate
from tidewave.plans.catalog import query
from tidewave.session import table

X = "x AS (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS v FROM embeddings)"
REF = "SELECT label, arg_min(v, vec_id) AS h FROM x GROUP BY label"


def _crops(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", arrays.doubles("embedding").alias("v"))


@query(f"WITH {X} SELECT vec_id, round(sqrt(list_dot_product(v, v)), 9) AS norm FROM x")
def self_norm(spark, sf_dir):
    return _crops(spark, sf_dir).select("vec_id", F.round(F.sqrt(arrays.dot(F.col("v"), F.col("v"))), 9).alias("norm"))


@query(f"WITH {X}, b AS ({REF}) SELECT vec_id, arg_max(b.label, round(list_dot_product(v, h), 9)) AS best, max(round(list_dot_product(v, h), 9)) AS match FROM x, b GROUP BY vec_id".replace("arg_max(b.label, round(list_dot_product(v, h), 9)) AS best, ", ""))
def best_match(spark, sf_dir):
    """The largest match of each crop with a bank of one template for each label."""
    x = _crops(spark, sf_dir)
    bank = x.groupBy("label").agg(F.min_by("v", "vec_id").alias("h")).agg(F.collect_list("h").alias("bank"))  # one template for each label
    return x.crossJoin(F.broadcast(bank)).select("vec_id", F.array_max(F.transform("bank", lambda h: F.round(arrays.dot(F.col("v"), h), 9))).alias("match"))


@query(f"WITH {X}, b AS ({REF}) SELECT x.label, count(*) AS n, round(stddev_pop(list_dot_product(v, h)), 9) AS sigma, round(max(list_dot_product(v, h)) / stddev_pop(list_dot_product(v, h)), 6) AS rho FROM x JOIN b USING (label) GROUP BY x.label")
def background_rho(spark, sf_dir):
    x = _crops(spark, sf_dir)
    bank = x.groupBy("label").agg(F.min_by("v", "vec_id").alias("h"))
    d = x.join(bank, "label").select("label", arrays.dot(F.col("v"), F.col("h")).alias("d"))
    return d.groupBy("label").agg(F.count("*").alias("n"), F.round(F.stddev_pop("d"), 9).alias("sigma"), F.round(F.max("d") / F.stddev_pop("d"), 6).alias("rho"))


@query(f"WITH {X} SELECT label, sum(len(list_filter(v, lambda e: abs(e) > 0.3)))::BIGINT AS samples, sum(CASE WHEN len(list_filter(v, lambda e: abs(e) > 0.3)) > 0 THEN 1 ELSE 0 END)::BIGINT AS crops, round(max(list_max(list_transform(v, lambda e: greatest(least(e, 0.3), -0.3)))), 9) AS peak FROM x GROUP BY label")
def clip_census(spark, sf_dir):
    over = F.size(F.filter("v", lambda e: F.abs(e) > 0.3))
    return _crops(spark, sf_dir).groupBy("label").agg(F.sum(over).alias("samples"), F.count_if(over > 0).alias("crops"), F.round(F.max(F.array_max(arrays.saturated(F.col("v"), 0.3))), 9).alias("peak"))


@query(f"WITH {X} SELECT vec_id, round(sqrt(list_dot_product(list_transform(v, lambda e: e - list_avg(v)), list_transform(v, lambda e: e - list_avg(v))) / len(v)), 9) AS sd FROM x")
def crop_deviation(spark, sf_dir):
    return _crops(spark, sf_dir).select("vec_id", F.round(arrays.deviation(F.col("v")), 9).alias("sd"))


@query(f"WITH {X} SELECT vec_id, round(CASE WHEN c <= 1 THEN r ELSE r / pow((1 + pow(c, 3)) / 2, 1 / 6.0::DOUBLE) END, 9) AS rank FROM (SELECT vec_id, 10 * abs(v[1]) AS r, 20 * abs(v[2]) AS c FROM x)")
def reweighted_snr(spark, sf_dir):
    r = _crops(spark, sf_dir).select("vec_id", (10 * F.abs(F.col("v")[0])).alias("r"), (20 * F.abs(F.col("v")[1])).alias("c"))
    return r.select("vec_id", F.round(evaluate.reweighted(F.col("r"), F.col("c")), 9).alias("rank"))
