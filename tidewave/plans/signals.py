"""Queries that need signal processing or greedy plans; SQL cannot give their rows, tests hold them against plain loops."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidewave.functions import arrays
from tidewave.operators import conditioning, matched, selection, signal
from tidewave.plans.catalog import query
from tidewave.plans.detection import DAY, HOUR, _events
from tidewave.session import table

#: A day of one class of events is a block of 16 seconds; its noise is a function of the class and the day.
SECONDS, G = 16, conditioning.Geometry()
STARTS = tuple(int(s * G.rate) for s in (0, 2, 4, 6, 8, 10, 12))
#: 62 templates, pairs of masses.
MASSES = [(a, b) for a in range(10, 51, 4) for b in range(10, a + 1, 4)][:62]


def psd() -> np.ndarray:
    """A one-sided spectrum like a detector's: a wall below 30 Hz, a floor, and a rise above 200 Hz."""
    f = np.maximum(np.linspace(0, G.rate / 2, 4097), 8.0)
    return (30 / f) ** 8 + 1 + (f / 200) ** 2


def waveform(m1: float, m2: float, n: int, end: int) -> np.ndarray:
    """A chirp of n samples that ends at sample `end`."""
    return np.concatenate((signal.chirp(m1, m2, end, G.rate), np.zeros(n - end)))


def templates() -> np.ndarray:
    return np.stack([waveform(a, b, G.length, G.start + G.size - 200) for a, b in MASSES])


def _series(spark, sf_dir):
    """A user's values in time order; a user is a stretch, five days are a block."""
    e = _events(spark, sf_dir).groupBy("user_id", F.floor(F.col("us") / (5 * DAY)).alias("block")).agg(F.array_sort(F.collect_list(F.struct("us", "value"))).alias("s"))
    return e.select("user_id", "block", F.transform("s", lambda r: r["value"]).alias("x"))


def _strain(spark, sf_dir):
    """Blocks (event_type, block, seed, x), each with its predecessor's samples as `before`."""
    days = _events(spark, sf_dir).select("event_type", F.floor(F.col("us") / DAY).alias("block")).distinct()
    keys = days.withColumn("seed", F.pmod(F.xxhash64("event_type", "block"), F.lit(1 << 31)))
    keys = keys.repartition(4 * spark.sparkContext.defaultParallelism, "event_type", "block")  # a key is little to shuffle and much to compute
    return signal.causal(signal.noise_blocks(keys, psd(), int(SECONDS * G.rate)), ["event_type"])


_W = "list_sum(list_transform(range(1, 9), lambda i: x[4 * g + i] * (0.5 - 0.5 * cos(2 * pi() * (i - 1) / 8)) * {f}(2 * pi() * k * (i - 1) / 8)))"


@query(
    f"""WITH s AS (SELECT user_id, CAST(floor(epoch_us(ts) / {5 * DAY}) AS BIGINT) AS block, list(value ORDER BY epoch_us(ts), value) AS x FROM events GROUP BY 1, 2),
n AS (SELECT *, (len(x) - 8) // 4 + 1 AS all_segments FROM s WHERE len(x) >= 8), m AS (SELECT *, CAST(all_segments - (all_segments + 1) % 2 AS BIGINT) AS n FROM n),
g AS (SELECT *, unnest(range(0, n)) AS g FROM m), p AS (SELECT user_id, block, n, k, (pow({_W.format(f='cos')}, 2) + pow({_W.format(f='sin')}, 2)) / 3 AS p FROM g, (SELECT unnest(range(0, 5)) AS k))
SELECT user_id, block, CAST(k AS INTEGER) AS k, round(CASE WHEN k IN (0, 4) THEN 1 ELSE 2 END * quantile_cont(p, 0.5) / list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN i % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END / i)), 4) AS psd FROM p GROUP BY user_id, block, k, n"""
)
def psd_welch(spark, sf_dir):
    """The spectrum of each user's five days: Hann windows of eight values, every four, the median over windows with its bias taken out."""
    spectra = signal.power_spectra(_series(spark, sf_dir), 8, 4)
    return spectra.select("user_id", "block", F.posexplode("psd").alias("k", "psd")).withColumn("psd", F.round("psd", 4))


@query()
def causal_whitening(spark, sf_dir):
    return signal.whitened(signal.causal(_series(spark, sf_dir), ["user_id"]), 8, 4)


@query()
def matched_filter(spark, sf_dir):
    """Seven crops of 2,048 samples of each block, every other one with a signal of SNR 4 to 20, against 62 templates; rho_oracle for those with one."""
    injected = signal_in_strain(_strain(spark, sf_dir))
    return matched.scored(injected, templates(), G, STARTS, truth=True)


@query()
def quadrature_calibration(spark, sf_dir):
    """The spread of both quadratures of the bank's answers to strain without signals, of each class; 1 if the calibration holds."""
    held = matched.calibration(_strain(spark, sf_dir), templates(), G, STARTS[::2], ["event_type"])
    return held.select("event_type", "n", F.round("sd_real", 4).alias("sd_real"), F.round("sd_imaginary", 4).alias("sd_imaginary"))


def signal_in_strain(blocks):
    """blocks with a waveform in every other buffer, and the waveforms as `own`; masses and SNR are functions of the seed."""
    spectrum = psd()

    def run(parts):
        for p in parts:
            for lo in range(0, len(p), 8):
                part, xs, own = p.iloc[lo : lo + 8], [], []
                for seed, x in zip(part["seed"], part["x"], strict=True):
                    r, x, waves = np.random.default_rng([int(seed), 1]), np.array(x, float), []
                    for k, s in enumerate(STARTS):
                        h = waveform(*sorted(r.uniform(10, 50, 2), reverse=True), G.length, G.start + int(r.uniform(0.5, 0.95) * G.size))
                        if k % 2 and s + G.length <= len(x):
                            x[s : s + G.length] = signal.inject(x[s : s + G.length], h, signal.optimal_snr(h, spectrum / G.rate, G.rate, G.low, G.high), r.uniform(4, 20))
                        waves.append(h if k % 2 else None)
                    xs.append(x)
                    own.append(waves)
                yield part.assign(x=xs, own=own)

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema)
    return blocks.where("before is not null").mapInPandas(run, kind + ", own array<array<double>>")


@query()
def conditioned_arms(spark, sf_dir):
    """The four treatments of one buffer of each block, scaled by one norm for each; their deviation and largest sample."""
    buffers = _strain(spark, sf_dir).select("event_type", "block", F.slice("x", STARTS[3] + 1, G.length).alias("x"), "before")
    crops = conditioning.conditioned(buffers, G).where("x_full is not null")
    out = conditioning.scaled(crops, conditioning.norms(crops))
    of = [(F.round(arrays.deviation(arrays.doubles(f"x_{a}")), 6).alias(f"sd_{a}"), F.round(F.array_max(F.transform(f"x_{a}", F.abs)), 4).alias(f"most_{a}")) for a in conditioning.ARMS]
    return out.select("event_type", "block", *(c for pair in of for c in pair))


@query()
def balanced_cover(spark, sf_dir):
    """Up to 400 events of each class, the best of files of a day, from at most 15 files and 700 hours."""
    e = _events(spark, sf_dir).withColumn("file", F.floor(F.col("us") / DAY))
    return selection.cover(e, "event_type", "file", [F.desc("value"), "event_id"], 400, 15, ("us", HOUR, 700 * HOUR))


_STEP = """a{k} AS MATERIALIZED (SELECT * FROM a{j} UNION ALL SELECT block, CASE WHEN before < t THEN 'test' WHEN before - coalesce(spent, 0) < v THEN 'val' ELSE 'train' END AS split FROM (
SELECT *, max(CASE WHEN before < t THEN before + n END) OVER (ORDER BY block ROWS UNBOUNDED PRECEDING) AS spent FROM (
SELECT c.block, c.n, sum(c.n) OVER (ORDER BY c.block ROWS UNBOUNDED PRECEDING) - c.n AS before, greatest(round_even(0.3::DOUBLE * total, 0), least(20, total)) - coalesce((SELECT sum(d.n) FROM c d JOIN a{j} USING (block) WHERE d.place = {k} AND split = 'test'), 0) AS t,
round_even(0.1::DOUBLE * total, 0) - coalesce((SELECT sum(d.n) FROM c d JOIN a{j} USING (block) WHERE d.place = {k} AND split = 'val'), 0) AS v FROM c WHERE c.place = {k} AND c.block NOT IN (SELECT block FROM a{j}))))"""


@query(
    "WITH e AS (SELECT event_id, event_type, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS block FROM events), g AS (SELECT event_type, block, count(*) AS n FROM e GROUP BY ALL), "
    "k AS (SELECT event_type, sum(n) AS total, row_number() OVER (ORDER BY sum(n), event_type) AS place FROM g GROUP BY 1), c AS MATERIALIZED (SELECT g.block, g.n, place, total FROM g JOIN k USING (event_type)), "
    "a0 AS (SELECT 0::BIGINT AS block, '' AS split WHERE false), " + ", ".join(_STEP.format(k=k, j=k - 1) for k in range(1, 6)) + " SELECT event_id, block, split FROM e JOIN a5 USING (block)"
)
def stratified_split(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("block", F.floor(F.col("us") / DAY))
    return e.select("event_id", "block").join(selection.stratified_split(e, "event_type", "block"), "block").select("event_id", "block", "split")


@query()
def stochastic_bank(spark, sf_dir):
    """Chirps, one for each supplier, accepted while they match none before by 0.97."""
    def waves(p):
        return np.stack([signal.chirp(a, b, 2048, G.rate) for a, b in zip(p["m1"], p["m2"], strict=True)])

    mass = lambda seed: 10 + F.pmod(F.xxhash64("s_suppkey", F.lit(seed)), F.lit(4000)) / 100
    masses = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.greatest(mass(1), mass(2)).alias("m1"), F.least(mass(1), mass(2)).alias("m2"))
    bank = signal.stochastic_bank(masses, waves=waves)
    return masses.join(F.broadcast(spark.createDataFrame([(i,) for i in bank], "id long")), "id")  # as many as a bank has


