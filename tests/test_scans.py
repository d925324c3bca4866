"""Ordered scans by time file against plain loops, with keys that are null, empty tables, and one key that holds all rows."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.functions import arrays
from tidewave.operators import intervals, scans


def greedy(times, least, state=None):
    kept = []
    for t in sorted(set(times)):
        if state is None or t - state >= least:
            kept.append(t)
            state = t
    return kept


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    sparse = [(int(rng.choice([1, 2, 3])), int(t), float(v)) for t, v in zip(rng.integers(-500, 500, 200), rng.random(200), strict=True)]
    dense = [(None, int(t), float(t)) for t in rng.integers(0, 60, 80)]
    return [(k or None, t, v) for k, t, v in [*sparse, *dense, (4, 7, 0.5), (4, 7, 0.5)]]


def by_key(rows):
    out = defaultdict(list)
    for k, *r in rows:
        out[k].append(tuple(r))
    return {k: sorted(own) for k, own in out.items()}


@pytest.mark.parametrize("width", [7, 5000])
def test_running_values_do_not_depend_on_the_files(spark, rows, width):
    df = spark.createDataFrame([(k, t, v if i % 5 else None, i) for i, (k, t, v) in enumerate(rows)], "k int, t long, v double, i long")
    values = {"total": (F.col("v"), "sum"), "top": (F.col("v"), "max"), "low": (F.col("v"), "min"), "latest": (F.col("v"), "last")}
    for inclusive in (False, True):
        got = {r.i: (r.total, r.top, r.low, r.latest) for r in scans.running(df, ["k"], "t", width, ["t", "i"], values, inclusive).collect()}
        assert len(got) == len(rows)
        for own in by_key([(r.k, r.t, r.i, r.v) for r in df.collect()]).values():
            for n, (_, i, _) in enumerate(own):
                seen = [v for _, _, v in own[: n + inclusive] if v is not None]
                want = (sum(seen), max(seen, default=None), min(seen, default=None), seen[-1] if seen else None)
                assert got[i][0] == pytest.approx(want[0]) and got[i][1:] == want[1:]


def test_places_do_not_depend_on_the_files(spark, rows):
    df = spark.createDataFrame([(k, t, i) for i, (k, t, _) in enumerate(rows)], "k int, t long, i long")
    want = {i: (n, len(own)) for own in by_key([(k, t, i) for i, (k, t, _) in enumerate(rows)]).values() for n, (_, i) in enumerate(own)}
    for width in (3, 90.5, 10_000):
        assert {r.i: (r.place, r.n) for r in scans.placed(df, ["k"], "t", width, ["t", "i"]).collect()} == want


@pytest.mark.parametrize("least,width", [(5, 3), (60, 7), (2000, 50)])
def test_greedy_choices_do_not_depend_on_the_files(spark, rows, least, width):
    df = spark.createDataFrame([*rows, (1, None, 1.0)], "k int, t long, v double")
    got = Counter((r.k, r.t) for r in scans.spaced(df, "t", least, ["k"], width).collect())
    assert got == Counter((k, t) for k, own in by_key(rows).items() for t in greedy([t for t, _ in own], least))
    alone = [r.t for r in scans.spaced(df.where("k = 1"), "t", least, [], width).collect()]
    assert sorted(alone) == greedy([t for k, t, _ in rows if k == 1], least)
    assert scans.spaced(df.where("false"), "t", least, ["k"], width).count() == 0


def test_a_file_maps_every_entry_state_to_the_state_it_leaves():
    rng = np.random.default_rng(4)
    for least in (1, 4, 30):
        t = np.unique(rng.integers(100, 180, 40))
        until, leaves = scans.exits(t, least, 100)
        for state in range(100 - 2 * least, 100):
            want = greedy(t, least, state)
            k = int(np.searchsorted(until, state + least))
            assert (leaves[k] if k < len(leaves) else state) == (want[-1] if want else state)
            assert scans.chosen(t, least, state).tolist() == want


@pytest.mark.parametrize("width", [3, 4000])
def test_interval_operators_do_not_depend_on_the_files(spark, width):
    rng = np.random.default_rng(9)
    spans = [(int(k) or None, int(a), int(a + d)) for k, a, d in zip(rng.integers(0, 3, 120), rng.integers(0, 400, 120), rng.integers(0, 9, 120), strict=True)]
    vetoes = [(int(k) or None, int(a), int(a + d)) for k, a, d in zip(rng.integers(0, 3, 30), rng.integers(0, 400, 30), rng.integers(0, 12, 30), strict=True)]
    s, v = (spark.createDataFrame(x, "k int, lo long, hi long") for x in (spans, vetoes))

    def merge(own):
        out = []
        for a, b in sorted(own):
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return out

    want = Counter((k, *x) for k, own in by_key(spans).items() for x in merge(own))
    assert Counter(map(tuple, intervals.merged(s, "lo", "hi", ["k"], width).select("k", "lo", "hi").collect())) == want
    seconds = {(k, t) for k, a, b in spans for t in range(a, b)} - {(k, t) for k, a, b in vetoes for t in range(a, b)}
    left = [tuple(r) for r in intervals.subtracted(s, v, "lo", "hi", ["k"], width).select("k", "lo", "hi").collect()]
    assert {(k, t) for k, a, b in left for t in range(a, b)} == seconds and sum(b - a for _, a, b in left) == len(seconds)
    times = s.select("k", F.col("lo").alias("t"), F.monotonically_increasing_id().alias("i"))
    clusters = {(r.k, r.t): r.cluster for r in intervals.gap_clusters(times, "t", 6, ["k"], width).collect()}
    for k, own in by_key(spans).items():
        n, before = 1, None
        for a in sorted({a for a, _ in own}):
            n += before is not None and a - before > 6
            before = a
            assert clusters[k, a] == n
    right = v.select("k", F.col("lo").alias("t"), F.col("hi").alias("v")).groupBy("k", "t").agg(F.max("v").alias("v"))
    seen = by_key([tuple(r) for r in right.collect()])
    for r in intervals.asof(times, right, "t", ["k"], ["v"], width).collect():
        assert r.v == max(((t, x) for t, x in seen[r.k] if t <= r.t), default=(None, None))[1]
    blocks = s.select("k", F.col("lo").alias("b"))
    runs = sum(r.n for r in intervals.runs(blocks, "b", ["k"], width).collect())
    assert runs == len({(k, a) for k, a, _ in spans})


def test_one_user_with_a_million_rows_is_shared_by_all_tasks(spark):
    """Every task of the passes over rows has its share of them, and the results are those of the loop."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")
    old = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], "16")
        spark.conf.set(names[1], "false")
        times = spark.range(1_000_000).select(F.lit(1).alias("k"), (F.col("id") * 13 + F.pmod(F.xxhash64("id"), F.lit(11))).alias("t"))
        spans = times.select("k", F.col("t").alias("lo"), (F.col("t") + 1 + F.pmod(F.xxhash64("t"), F.lit(40))).alias("hi"))
        shares = {
            "clusters": intervals.gap_clusters(times, "t", 20, ["k"], 13_000),
            "spacing": intervals.spaced(times, "t", 5, ["k"], 13_000),
            "reach": scans.running(spans, ["k"], "lo", 13_000, ["lo", "hi"], {"reach": (F.col("hi"), "max")}),
        }
        for df in shares.values():
            per_task = sorted(r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max(df.columns[-1])).collect())
            assert len(per_task) == 16 and per_task[-1] <= 2 * per_task[8]
        t = np.sort(times.select("t").toPandas()["t"].to_numpy())
        assert shares["clusters"].agg(F.max("cluster")).first()[0] == 1 + int((np.diff(t) > 20).sum())
        assert shares["spacing"].count() == len(scans.chosen(t, 5, None))
    finally:
        for n, value in zip(names, old, strict=True):
            spark.conf.set(n, value)


def test_a_deviation_takes_time_in_proportion_to_its_array(spark):
    """The mean is computed once: 64 times the samples may not cost 64 * 64 times the work."""
    x = np.random.default_rng(0).standard_normal(1 << 15)
    df = spark.createDataFrame([(x.tolist(),)], "x array<double>")
    assert df.select(arrays.deviation(F.col("x"))).first()[0] == pytest.approx(x.std())  # quadratic work would take minutes
