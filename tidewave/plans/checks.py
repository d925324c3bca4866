"""Checks of crops, blocks, spans and specs: embeddings as crops of 64 samples, events as triggers and scores."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewave.functions import arrays, probability
from tidewave.operators import evaluate, intervals, scans, signal
from tidewave.plans.catalog import query
from tidewave.plans.crops import REF, X, _crops
from tidewave.plans.detection import HOUR, _events
from tidewave.plans.spans import E, FILE, SPANS, _merge_sql, _spans
from tidewave.session import table

H = f"{X}, b AS ({REF})"
DRAW = "CAST('0x' || substr(md5(concat_ws('/', CAST({key} AS VARCHAR), '{name}')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


def _with_template(spark, sf_dir):
    """Crops with h, the first crop of their label."""
    x = _crops(spark, sf_dir)
    return x.join(x.groupBy("label").agg(F.min_by("v", "vec_id").alias("h")), "label")


def _plus(a, b):
    return F.zip_with(a, b, lambda x, y: x + y)


def _minus(a, b):
    return F.zip_with(a, b, lambda x, y: x - y)


def _most(a):
    return F.array_max(F.transform(a, F.abs))


def _unit(a):
    return arrays.bound(F.sqrt(arrays.energy(a)), lambda norm: F.transform(a, lambda e: e / norm))


@query(
    f"""WITH {H}, p AS (SELECT x.vec_id, x.v, lead(x.v) OVER (PARTITION BY x.label ORDER BY x.vec_id) AS w, h FROM x JOIN b USING (label)),
q AS (SELECT vec_id, list_transform(list_zip(v, h), lambda z: z[1] + z[2]) AS vh, list_transform(list_zip(w, h), lambda z: z[1] + z[2]) AS wh, v, w FROM p WHERE w IS NOT NULL AND v <> h),
n AS (SELECT vec_id, v, w, vh, wh, sqrt(list_dot_product(v, v)) AS nv, sqrt(list_dot_product(w, w)) AS nw, sqrt(list_dot_product(vh, vh)) AS nvh, sqrt(list_dot_product(wh, wh)) AS nwh FROM q),
d AS (SELECT vec_id, list_transform(range(1, 65), lambda i: vh[i] - v[i]) AS a, list_transform(range(1, 65), lambda i: wh[i] - w[i]) AS c,
list_transform(range(1, 65), lambda i: vh[i] / nvh - v[i] / nv) AS la, list_transform(range(1, 65), lambda i: wh[i] / nwh - w[i] / nw) AS lc FROM n WHERE nvh > 1e-9 AND nwh > 1e-9)
SELECT vec_id, round(list_max(list_transform(range(1, 65), lambda i: abs(a[i] - c[i]))) / list_max(list_transform(a, lambda e: abs(e))), 6) AS fixed,
round(list_max(list_transform(range(1, 65), lambda i: abs(la[i] - lc[i]))) / list_max(list_transform(la, lambda e: abs(e))), 6) AS leaky FROM d"""
)
def leak_identity(spark, sf_dir):
    """A template's effect on two crops of its label, as it is and after each crop is scaled by itself: only a fixed treatment gives the same twice."""
    order = Window.partitionBy("label").orderBy("vec_id")
    p = _with_template(spark, sf_dir).withColumn("w", F.lead("v").over(order)).where("w is not null and v <> h")
    q = p.select("vec_id", "v", "w", _plus("v", "h").alias("vh"), _plus("w", "h").alias("wh"))
    q = q.where((F.sqrt(arrays.energy(F.col("vh"))) > 1e-9) & (F.sqrt(arrays.energy(F.col("wh"))) > 1e-9))
    d = q.select("vec_id", _minus("vh", "v").alias("a"), _minus("wh", "w").alias("c"), _minus(_unit(F.col("vh")), _unit(F.col("v"))).alias("la"), _minus(_unit(F.col("wh")), _unit(F.col("w"))).alias("lc"))
    return d.select("vec_id", F.round(_most(_minus("a", "c")) / _most(F.col("a")), 6).alias("fixed"), F.round(_most(_minus("la", "lc")) / _most(F.col("la")), 6).alias("leaky"))


@query(
    f"""WITH {H}, p AS (SELECT vec_id, v, h, list_transform(range(1, 65), lambda i: CAST(CAST(v[i] + h[i] AS FLOAT) AS DOUBLE) - CAST(CAST(v[i] AS FLOAT) AS DOUBLE) - h[i]) AS d FROM x JOIN b USING (label))
SELECT vec_id, round(sqrt(list_dot_product(h, h)) / sqrt(list_dot_product(v, v)), 9) AS prominence, round(sqrt(list_dot_product(d, d)) / sqrt(list_dot_product(h, h)), 12) AS lost FROM p"""
)
def signal_prominence(spark, sf_dir):
    """How large a template is beside a crop, and what storing their sum as floats loses of it."""
    stored = lambda a: F.transform(a, lambda e: e.cast("float").cast("double"))
    p = _with_template(spark, sf_dir).withColumn("d", _minus(_minus(stored(_plus("v", "h")), stored("v")), F.col("h")))
    size = lambda c: F.sqrt(arrays.energy(F.col(c)))
    return p.select("vec_id", F.round(size("h") / size("v"), 9).alias("prominence"), F.round(size("d") / size("h"), 12).alias("lost"))


@query(f"WITH {X} SELECT vec_id, round(list_dot_product(v[1:16], v[1:16]) / list_dot_product(v[49:64], v[49:64]), 6) AS tilt FROM x")
def spectral_tilt(spark, sf_dir):
    mean = lambda start: arrays.energy(F.slice("v", start, 16)) / 16
    return _crops(spark, sf_dir).select("vec_id", F.round(mean(1) / mean(49), 6).alias("tilt"))


@query(f"WITH {X}, p AS (SELECT vec_id, v, CAST(floor(((vec_id % 10) / 10.0 + 0.05) * 64) AS BIGINT) AS c FROM x) SELECT vec_id, round(list_max(list_transform(v[greatest(1, c - 8):least(64, c + 10)], lambda e: abs(e))), 9) AS peak FROM p")
def peak_near_position(spark, sf_dir):
    """The largest sample within 0.15 of a crop's length of the recorded position."""
    at = F.floor((F.col("vec_id") % 10 / 10 + 0.05) * 64)
    lo, hi = F.greatest(F.lit(1), at - 8).cast("int"), F.least(F.lit(64), at + 10).cast("int")
    return _crops(spark, sf_dir).select("vec_id", F.round(_most(F.slice("v", lo, hi - lo + 1)), 9).alias("peak"))


@query(
    f"""WITH {H}, s AS (SELECT x.label, sqrt(list_dot_product(list_transform(range(1, 65), lambda i: v[i] + h[i]), list_transform(range(1, 65), lambda i: v[i] + h[i])) / 64) / sqrt((1 + list_dot_product(h, h)) / 64) AS r FROM x JOIN b USING (label))
SELECT label, round(quantile_cont(r, 0.5), 6) AS ratio FROM s GROUP BY label"""
)
def variance_prediction(spark, sf_dir):
    """The middle ratio of a crop's deviation with a template in it to what noise and template predict."""
    both = _plus("v", "h")
    r = _with_template(spark, sf_dir).select("label", (F.sqrt(arrays.energy(both) / 64) / F.sqrt((1 + arrays.energy(F.col("h"))) / 64)).alias("r"))
    return r.groupBy("label").agg(F.round(F.percentile("r", F.lit(0.5)), 6).alias("ratio"))


_DFT = "list_sum(list_transform(range(1, 65), lambda n: h[n] * {f}(2 * pi() * k * (n - 1) / 64)))"
_POWER = f"{_DFT.format(f='cos')} * {_DFT.format(f='cos')} + {_DFT.format(f='sin')} * {_DFT.format(f='sin')}"


@query(
    f"""WITH {H}, p AS (SELECT label, k, {_POWER} AS p FROM b, (SELECT unnest(range(1, 32)) AS k))
SELECT label, arg_max(k, p) AS peak, round(max(p), 6) AS power, round(sum(CASE WHEN k BETWEEN 4 AND 12 THEN p ELSE 0 END) / sum(p), 6) AS in_band FROM p GROUP BY label"""
)
def kernel_spectrum(spark, sf_dir):
    """The frequency with most power of each label's template, and the share of the power in a band."""
    x = _crops(spark, sf_dir)
    h = x.groupBy("label").agg(F.min_by("v", "vec_id").alias("h"))
    part = lambda k, f: F.aggregate(F.transform("h", lambda e, n: e * f(2 * math.pi * k * n / 64)), F.lit(0.0), lambda s, e: s + e)
    k = h.select("label", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(31)), lambda k: part(k, F.cos) * part(k, F.cos) + part(k, F.sin) * part(k, F.sin))).alias("k", "p"))
    k = k.withColumn("k", (F.col("k") + 1).cast("long"))
    band = F.sum(F.when(F.col("k").between(4, 12), F.col("p")).otherwise(0.0))
    return k.groupBy("label").agg(F.max_by("k", "p").alias("peak"), F.round(F.max("p"), 6).alias("power"), F.round(band / F.sum("p"), 6).alias("in_band"))


_H128 = "list_sum(list_transform(range(1, 65), lambda n: u[n] * {f}(2 * pi() * k * (n - 1) / 128)))"


@query(
    f"""WITH {H}, t AS (SELECT label, list_transform(h, lambda e: e / sqrt(list_dot_product(h, h))) AS u FROM b),
f AS (SELECT label, k, {_H128.format(f='cos')} AS c, -{_H128.format(f='sin')} AS s FROM t, (SELECT unnest(range(1, 64)) AS k)),
a AS (SELECT label, n, sum(c * cos(2 * pi() * k * n / 128) - s * sin(2 * pi() * k * n / 128)) / 128 AS re, sum(c * sin(2 * pi() * k * n / 128) + s * cos(2 * pi() * k * n / 128)) / 128 AS im FROM f, (SELECT unnest(range(0, 128)) AS n) GROUP BY ALL),
l AS (SELECT label, list(re ORDER BY n) || list(re ORDER BY n) AS re, list(im ORDER BY n) || list(im ORDER BY n) AS im FROM a GROUP BY label),
z AS (SELECT vec_id, l.label, lag, 2 * sqrt(pow(list_dot_product(v, re[(128 - lag) % 128 + 1:(128 - lag) % 128 + 64]), 2) + pow(list_dot_product(v, im[(128 - lag) % 128 + 1:(128 - lag) % 128 + 64]), 2)) AS z FROM x, l, (SELECT unnest(range(0, 128)) AS lag))
SELECT vec_id, round(max(z), 6) AS rho, CAST(arg_max(label, z) AS INTEGER) AS template, CAST(arg_max(lag, z) AS INTEGER) AS lag FROM z GROUP BY vec_id"""
)
def phase_time_match(spark, sf_dir):
    """The largest correlation over phase, time and templates (one for each label) of each crop, with its template and lag."""
    x = _crops(spark, sf_dir)
    own = x.groupBy("label").agg(F.min_by("v", "vec_id").alias("h")).orderBy("label").collect()  # one row for each label
    bank = spark.sparkContext.broadcast(([r["label"] for r in own], signal.spectra(np.asarray([r["h"] for r in own]), 128)))

    def run(parts):
        labels, spectra = bank.value
        for p in parts:
            rows = []
            for v in p["v"]:
                z = np.abs(signal.correlate(np.asarray(v), spectra))
                t, lag = np.unravel_index(z.argmax(), z.shape)
                rows.append((round(float(z.max()), 6), labels[t], int(lag)))
            yield p[["vec_id"]].assign(rho=[r[0] for r in rows], template=[r[1] for r in rows], lag=[r[2] for r in rows])

    return x.select("vec_id", "v").mapInPandas(run, "vec_id long, rho double, template int, lag int")


@query(f"WITH {X} SELECT label, count(*) AS n, CAST(sum(CASE WHEN len(list_filter(v, lambda e: NOT isfinite(e))) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS not_finite, CAST(sum(CASE WHEN len(list_filter(v, lambda e: e = 0)) > 0.001 * len(v) THEN 1 ELSE 0 END) AS BIGINT) AS zeros FROM x GROUP BY 1")
def array_census(spark, sf_dir):
    bad = F.exists("v", lambda e: F.isnan(e) | (F.abs(e) == float("inf")))
    zeros = F.size(F.filter("v", lambda e: e == 0)) > 0.001 * F.size("v")
    return _crops(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.count_if(bad).alias("not_finite"), F.count_if(zeros).alias("zeros"))


@query(
    """WITH f AS (SELECT event_type AS arm, user_id % 8 AS bin, avg(CASE WHEN value > 100 THEN 1.0 ELSE 0.0 END) AS share FROM events GROUP BY ALL)
SELECT a.arm, round(max(a.share - o.share), 9) AS worst, bool_and(o.share >= a.share - 0.02) AS is_ceiling FROM f a JOIN f o ON o.bin = a.bin AND o.arm = 'error' WHERE a.arm <> 'error' AND a.bin >= 4 GROUP BY a.arm"""
)
def worst_gap_to_oracle(spark, sf_dir):
    """The largest gap by which an arm finds more than the oracle in any of the upper bins."""
    f = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("arm"), (F.col("user_id") % 8).alias("bin")).agg(F.avg((F.col("value") > 100).cast("double")).alias("share"))
    oracle = f.where("arm = 'error'").select("bin", F.col("share").alias("best"))
    gap = F.col("share") - F.col("best")
    return f.where("arm <> 'error' and bin >= 4").join(oracle, "bin").groupBy("arm").agg(F.round(F.max(gap), 9).alias("worst"), F.bool_and(F.col("best") >= F.col("share") - 0.02).alias("is_ceiling"))


@query(f"WITH {E}, {SPANS} SELECT user_id, count(DISTINCT file) AS files FROM (SELECT user_id, unnest(generate_series(CAST(floor(lo / 4096000000) AS BIGINT), CAST(floor((hi - 1) / 4096000000) AS BIGINT))) AS file FROM s WHERE hi > lo) GROUP BY 1")
def files_touched(spark, sf_dir):
    cell = lambda c: F.floor(c / 4_096_000_000)
    spans = _spans(spark, sf_dir)[0].where("hi > lo")
    return spans.select("user_id", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))).alias("file")).groupBy("user_id").agg(F.countDistinct("file").alias("files"))


@query(f"WITH {X} SELECT label, round(1 / avg(sqrt(list_dot_product(list_transform(v, lambda e: e - list_avg(v)), list_transform(v, lambda e: e - list_avg(v))) / len(v))), 6) AS norm FROM x WHERE vec_id % 10 < 8 GROUP BY label")
def norm_constant(spark, sf_dir):
    """One over the mean deviation of the training crops, for each label."""
    return _crops(spark, sf_dir).where("vec_id % 10 < 8").groupBy("label").agg(F.round(1 / F.avg(arrays.deviation(F.col("v"))), 6).alias("norm"))


@query(
    f"""WITH {X}, m AS (SELECT label, i, quantile_cont(v[i] * v[i], 0.5) AS m FROM x, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL)
SELECT label, CAST(i AS INTEGER) AS place, round(m, 9) AS median, round(quantile_cont(m, 0.5) OVER (PARTITION BY label ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 9) AS smooth FROM m"""
)
def spectra_median(spark, sf_dir):
    """The median over crops of each place's power, and its running median over nine places."""
    each = _crops(spark, sf_dir).select("label", F.posexplode("v").alias("place", "e"))
    m = each.groupBy("label", (F.col("place") + 1).alias("place")).agg(F.percentile(F.col("e") * F.col("e"), F.lit(0.5)).alias("m"))
    near = F.percentile("m", F.lit(0.5)).over(Window.partitionBy("label").orderBy("place").rowsBetween(-4, 4))
    return m.select("label", "place", F.round("m", 9).alias("median"), F.round(near, 9).alias("smooth"))


@query(f"WITH {X} SELECT label, round(sum(CASE WHEN list_max(list_transform(v, lambda e: abs(e))) > 0.35 THEN 1 ELSE 0 END) / (count(*) / 3600.0), 6) AS per_hour FROM x GROUP BY 1")
def glitchy_rate(spark, sf_dir):
    """Loud crops an hour, each crop being a second."""
    return _crops(spark, sf_dir).groupBy("label").agg(F.round(F.count_if(_most("v") > 0.35) / (F.count("*") / 3600), 6).alias("per_hour"))


B6 = "q AS (SELECT DISTINCT user_id, CAST(floor(us / 21600000000) AS BIGINT) * 21600000000 AS lo FROM e)"


def _quarters(spark, sf_dir):
    return _events(spark, sf_dir).select("user_id", (F.floor(F.col("us") / (6 * HOUR)) * 6 * HOUR).alias("lo")).distinct()


@query(f"WITH {E}, {SPANS}, {B6} SELECT user_id, count(*) AS blocks, CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM v WHERE v.user_id = q.user_id AND v.lo < q.lo + 21600000000 AND v.hi > q.lo) THEN 1 ELSE 0 END) AS BIGINT) AS touched FROM q GROUP BY 1")
def overlap_count(spark, sf_dir):
    """Blocks of six hours, and how many of them a veto overlaps: vetoes are listed in the blocks' grid cells that they touch."""
    vetoes = _spans(spark, sf_dir)[1]
    cell = lambda c: F.floor(c / (6 * HOUR)) * 6 * HOUR
    hit = vetoes.select("user_id", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1), F.lit(6 * HOUR))).alias("lo")).distinct().withColumn("hit", F.lit(1))
    return _quarters(spark, sf_dir).join(hit, ["user_id", "lo"], "left").groupBy("user_id").agg(F.count("*").alias("blocks"), F.count("hit").alias("touched"))


@query(f"WITH {E}, {SPANS}, {B6}, ms AS {_merge_sql('s')} SELECT user_id, count(*) AS inside FROM q WHERE EXISTS (SELECT 1 FROM ms WHERE ms.user_id = q.user_id AND ms.lo <= q.lo + 3600000000 AND ms.hi >= q.lo + 7200000000) GROUP BY 1")
def containment_count(spark, sf_dir):
    """Blocks of which the second hour lies inside a merged span."""
    spans = intervals.merged(_spans(spark, sf_dir)[0], "lo", "hi", ["user_id"], FILE).withColumn("hi", F.col("hi") + 1)
    inner = _quarters(spark, sf_dir).select("user_id", (F.col("lo") + HOUR).alias("from"))
    met = intervals.range_join(inner, spans, "from", "lo", "hi", 12 * HOUR, ("user_id",)).where(F.col("hi") - 1 >= F.col("from") + HOUR)
    return met.groupBy("user_id").agg(F.count("*").alias("inside"))


@query("SELECT DISTINCT user_id, event_type FROM events WHERE value > 200 AND (user_id, event_type) IN (SELECT user_id, event_type FROM events WHERE value < 50)")
def pair_membership(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where("value > 200").select("user_id", "event_type").distinct().join(e.where("value < 50").select("user_id", "event_type").distinct(), ["user_id", "event_type"], "left_semi")


@query("SELECT lang, quality, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def score_label_join(spark, sf_dir):
    """Scores and labels of the same row, by key and not by place."""
    d, own = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(own, "doc_id").groupBy("lang", "quality").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(f"WITH {E} SELECT user_id, min(d) AS least, min(d) >= 60000000 AS apart FROM (SELECT user_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS d FROM e) WHERE d IS NOT NULL GROUP BY 1")
def non_overlap(spark, sf_dir):
    e = scans.running(_events(spark, sf_dir).select("user_id", "us"), ["user_id"], "us", FILE, ["us"], {"before": (F.col("us"), "last")})
    d = e.select("user_id", (F.col("us") - F.col("before")).alias("d")).where("d is not null")
    return d.groupBy("user_id").agg(F.min("d").alias("least"), (F.min("d") >= 60_000_000).alias("apart"))


SHUFFLED = "r AS (SELECT event_id, event_type, row_number() OVER (ORDER BY md5(CAST(event_id AS VARCHAR))) - 1 AS place, count(*) OVER () AS n FROM events)"


def _shuffled(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.md5(F.col("event_id").cast("string").cast("binary")).alias("_md5"))
    return intervals.numbered(e, "_md5").drop("_md5")


@query(f"WITH {SHUFFLED} SELECT event_id, CAST(place AS BIGINT) AS place, CASE WHEN place < floor(0.8 * n) THEN 'train' WHEN place < floor(0.9 * n) THEN 'val' ELSE 'test' END AS split FROM r")
def positional_split(spark, sf_dir):
    r = _shuffled(spark, sf_dir)
    return r.select("event_id", "place", F.when(F.col("place") < F.floor(0.8 * F.col("n")), "train").when(F.col("place") < F.floor(0.9 * F.col("n")), "val").otherwise("test").alias("split"))


@query(
    f"""WITH {SHUFFLED}, s AS (SELECT event_id, place, CASE WHEN place < n // 2 THEN 1 ELSE 0 END AS y, {DRAW.format(key='event_id', name='m1')} AS a, {DRAW.format(key='event_id', name='m2')} AS b, {DRAW.format(key='event_id', name='snr')} AS c FROM r)
SELECT event_id, CAST(y AS INTEGER) AS y, md5(CAST(event_id AS VARCHAR)) AS seed, CASE WHEN y = 1 THEN round(10 + 40 * greatest(a, b), 9) ELSE 0.0 END AS m1, CASE WHEN y = 1 THEN round(10 + 40 * least(a, b), 9) ELSE 0.0 END AS m2, CASE WHEN y = 1 THEN round(4 + 16 * c, 9) ELSE 0.0 END AS snr FROM s"""
)
def spec_draw(spark, sf_dir):
    """Balanced specs: half with a signal, masses and SNR drawn from the row's key, parameters of the rest 0, a seed of its own for each."""
    r = _shuffled(spark, sf_dir).withColumn("y", (F.col("place") < F.floor(F.col("n") / 2)).cast("int"))
    a, b, c = (probability.drawn(F.col("event_id"), x) for x in ("m1", "m2", "snr"))
    only = lambda x: F.when(F.col("y") == 1, F.round(x, 9)).otherwise(0.0)
    seed = F.md5(F.col("event_id").cast("string").cast("binary"))
    return r.select("event_id", "y", seed.alias("seed"), only(10 + 40 * F.greatest(a, b)).alias("m1"), only(10 + 40 * F.least(a, b)).alias("m2"), only(4 + 16 * c).alias("snr"))


@query(
    f"""WITH {E}, p AS (SELECT event_id, CAST(floor(us / 512000000) AS BIGINT) AS block, (us % 512000000) / 1000000.0::DOUBLE AS p FROM e),
c AS (SELECT event_id, block, p, o, p - 1.5 - o AS f FROM (SELECT *, unnest(generate_series(CAST(floor(p - 1.5) AS BIGINT) - 1, CAST(floor(p - 1.5) AS BIGINT) + 1)) AS o FROM p)),
d AS (SELECT *, CASE WHEN f >= 0.1 AND f < 0.95 THEN 0 WHEN f >= 0.02 AND f < 0.99 THEN 1 END AS rank FROM c WHERE o BETWEEN 0 AND 508),
w AS (SELECT * FROM d WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY rank, md5(concat_ws('/', CAST(event_id AS VARCHAR), CAST(o AS VARCHAR)))) = 1)
SELECT event_id, block, o AS start, round(f, 6) AS fraction FROM w QUALIFY row_number() OVER (PARTITION BY block, o ORDER BY event_id) = 1"""
)
def offset_choice(spark, sf_dir):
    """The whole second at which a buffer starts so that a trigger lies in the wanted part of its crop; one trigger for each buffer."""
    p = _events(spark, sf_dir).select("event_id", F.floor(F.col("us") / 512_000_000).alias("block"), (F.pmod(F.col("us"), F.lit(512_000_000)) / 1_000_000).alias("p"))
    near = F.floor(F.col("p") - 1.5)
    c = p.withColumn("start", F.explode(F.sequence(near - 1, near + 1))).withColumn("f", F.col("p") - 1.5 - F.col("start")).where(F.col("start").between(0, 508))
    rank = F.when((F.col("f") >= 0.1) & (F.col("f") < 0.95), 0).when((F.col("f") >= 0.02) & (F.col("f") < 0.99), 1)
    tie = F.md5(F.concat_ws("/", F.col("event_id").cast("string"), F.col("start").cast("string")).cast("binary"))
    best = c.withColumn("rank", rank).where("rank is not null").groupBy("event_id", "block").agg(F.min(F.struct("rank", tie.alias("tie"), "start", "f")).alias("x"))
    first = best.select("event_id", "block", "x.start", "x.f").groupBy("block", "start").agg(F.min(F.struct("event_id", "f")).alias("y"))
    return first.select("y.event_id", "block", "start", F.round("y.f", 6).alias("fraction"))


@query(f"WITH {SHUFFLED} SELECT event_type, event_id, CAST(place AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS k FROM r) WHERE k % 7 = 0 AND k < 700")
def strided_head(spark, sf_dir):
    """Every seventh of the first 700 rows of each class, in the order of the ids."""
    k = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")) - 1
    return _shuffled(spark, sf_dir).withColumn("k", k).where("k % 7 = 0 and k < 700").select("event_type", "event_id", "place")


@query(f"WITH {E} SELECT event_id, us, value FROM e ORDER BY value DESC, event_id LIMIT 100")
def loudest(spark, sf_dir):
    """The hundred loudest triggers, in order."""
    return _events(spark, sf_dir).select("event_id", "us", "value").orderBy(F.desc("value"), "event_id").limit(100)


@query("SELECT split_part(p_name, ' ', 1) AS name, min(p_partkey) AS first, count(*) AS versions FROM part GROUP BY 1")
def version_collapse(spark, sf_dir):
    """Names without what follows the first separator, with their first key."""
    return table(spark, sf_dir, "part").groupBy(probability.first_part(F.col("p_name"), " ").alias("name")).agg(F.min("p_partkey").alias("first"), F.count("*").alias("versions"))


@query(
    """WITH r AS (SELECT DISTINCT CAST(least(floor(value / 25), 12) AS DOUBLE) AS rho FROM events), z AS (SELECT unnest([0.1, 0.01, 0.001])::DOUBLE AS fap, unnest([1.2815515655446004, 2.3263478740408408, 3.090232306167813])::DOUBLE AS z),
x AS (SELECT rho, fap, greatest(-8, least(8, rho - z)) / 1000 AS h FROM r, z)
SELECT rho, fap, round(0.5 + h / 3 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 1001), lambda i: CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(i * h, 2) / 2))), 9) AS ceiling FROM x"""
)
def efficiency_ceiling(spark, sf_dir):
    """The best share that any detector can find of signals of the SNR of each unit of event value, by false-alarm probability."""
    rho = table(spark, sf_dir, "events").select(F.least(F.floor(F.col("value") / 25), F.lit(12)).cast("double").alias("rho")).distinct()
    fap = F.explode(F.array(F.lit(0.1), F.lit(0.01), F.lit(0.001))).alias("fap")
    return rho.select("rho", fap).select("rho", "fap", F.round(probability.ceiling(F.col("rho"), F.col("fap")), 9).alias("ceiling"))


@query(f"WITH {E} SELECT event_type, round(avg(ln(1 + exp(-abs(z))) + greatest(z, 0) - z * y), 9) AS loss FROM (SELECT event_type, (value - 100) / 50 AS z, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS y FROM e) GROUP BY 1")
def validation_loss(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", ((F.col("value") - 100) / 50).alias("z"), (F.col("user_id") % 2 == 0).cast("int").alias("y"))
    return e.groupBy("event_type").agg(F.round(evaluate.loss("z", "y"), 9).alias("loss"))


