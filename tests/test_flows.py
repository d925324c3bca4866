"""The strain source, published versions, keyed sinks, ordered streams, laid-out blocks and summaries: failures and restarts."""

import threading
import time
from collections import Counter
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.operators import evaluate, intervals, layout, summaries
from tidewave.plans.flows import PUSHDOWN
from tidewave.sources import readers, writers
from tidewave.sources.strain_files import StrainFiles, fetch_groups, Block
from tidewave.streaming import alarms, ordered

# The strain source


@pytest.fixture
def store(spark, tmp_path):
    spark.dataSource.register(StrainFiles)
    spark.conf.set(PUSHDOWN, "true")
    for detector in ("H1", "L1"):
        for gps in (0, 4, 8, 12, 16, 32, 36):
            (np.arange(8) + gps).astype("<f8").tofile(tmp_path / f"{detector}-{gps}-4.f8")
    (tmp_path / "notes.txt").write_text("no block")
    return tmp_path


def strain(spark, path, **options):
    return spark.read.format("strain_files").options(path=str(path), wait="0.05", **options).load()


def test_limits_choose_files_and_groups_are_partitions(spark, store):
    every = strain(spark, store)
    assert every.count() == 14 and every.rdd.getNumPartitions() == 6  # 0-12, 16, 32-36 of each
    some = every.where("detector = 'H1' and gps >= 4 and gps < 36 and gps <> 8")
    plan = some._jdf.queryExecution().executedPlan().toString()
    rows = some.collect()
    assert sorted((r.gps, r.strain[0], r.seconds) for r in rows) == [(g, float(g), 4) for g in (4, 12, 16, 32)]
    assert some.rdd.getNumPartitions() == 2 and "gps" in plan
    for p in store.glob("L1-*"):
        p.write_bytes(b"\x00")  # of the other detector: never opened
    assert some.count() == 4
    assert strain(spark, store, group="1").where("detector in ('H1', 'K1') and gps <= 4").rdd.getNumPartitions() == 2
    assert [len(g) for g in fetch_groups([Block("a", 8, 4), Block("a", 0, 4), Block("a", 4, 4), Block("b", 12, 4)], 2)] == [2, 1, 1]


def test_a_schema_without_samples_opens_no_file(spark, store):
    for p in store.glob("*.f8"):
        p.write_bytes(b"short")
    names = spark.read.format("strain_files").schema("gps bigint, detector string").option("path", str(store)).load()
    assert names.where("gps > 30").count() == 4 and names.columns == ["gps", "detector"]
    with pytest.raises(Exception, match="after 2 attempts"):
        strain(spark, store, retries="1").collect()


def test_missing_and_bad_blocks(spark, store):
    np.array([1.0, np.nan] * 4).astype("<f8").tofile(store / "H1-8-4.f8")
    one = {"retries": "1", "rate": "2"}
    with pytest.raises(Exception, match="H1-8-4.f8 holds samples that are not finite"):
        strain(spark, store, **one).where("detector = 'H1'").collect()
    assert strain(spark, store, bad="skip", **one).where("detector = 'H1'").count() == 6
    listed = strain(spark, store, bad="skip", missing="skip", **one).where("detector = 'L1'")
    assert listed.rdd.getNumPartitions() == 3
    whole = strain(spark, store, whole="true", **one)
    with pytest.raises(Exception, match="no block of H1 from 20 to 32"):
        whole.where("detector = 'H1'").collect()
    assert whole.where("detector = 'L1' and gps < 20").count() == 5


def test_a_block_that_goes_after_it_was_listed(store):
    options = {"path": str(store), "retries": "1", "wait": "0"}
    schema = type("S", (), {"fieldNames": lambda self: ["gps", "strain"]})()
    for missing, want in (("skip", [0, 8, 12]), ("error", None)):
        (store / "H1-4-4.f8").write_bytes(np.zeros(8).tobytes())
        reader = StrainFiles(options | {"missing": missing}).reader(schema)
        group = next(p for p in reader.partitions() if p.blocks[0] == Block("H1", 0, 4))
        (store / "H1-4-4.f8").unlink()
        if want:
            assert [b.column("gps")[0].as_py() for b in reader.read(group)] == want
        else:
            with pytest.raises(OSError, match="no strain of H1-4-4.f8 after 2 attempts"):
                list(reader.read(group))


def test_a_block_that_is_still_being_written_is_tried_again(spark, store):
    half = store / "H1-0-4.f8"
    data = half.read_bytes()
    half.write_bytes(data[:24])
    later = threading.Timer(2, lambda: half.write_bytes(data))
    later.start()
    rows = strain(spark, store, retries="9", rate="2").where("detector = 'H1' and gps = 0").collect()
    later.join()
    assert rows[0].strain == list(range(8))


def test_blocks_are_written_whole_or_not_at_all(spark, tmp_path):
    spark.dataSource.register(StrainFiles)
    blocks = spark.range(6).select(F.lit("V1").alias("detector"), (F.col("id") * 2).alias("gps"), F.lit(2).alias("seconds"), F.array(F.col("id").cast("double"), F.lit(0.5)).alias("strain")).repartition(3)
    failing = blocks.withColumn("strain", F.when(F.col("gps") == 8, F.raise_error(F.lit("lost")).cast("array<double>")).otherwise(F.col("strain")))
    with pytest.raises(Exception, match="lost"):
        failing.write.format("strain_files").mode("append").save(str(tmp_path))
    assert not list(tmp_path.glob("*.f8")) and not list(tmp_path.glob("_staging*"))
    for _ in range(2):  # again: the same blocks
        blocks.write.format("strain_files").mode("append").save(str(tmp_path))
    assert sorted((r.gps, r.strain) for r in strain(spark, tmp_path).collect()) == [(2 * i, [float(i), 0.5]) for i in range(6)]
    with pytest.raises(Exception, match="mode append"):
        blocks.write.format("strain_files").mode("overwrite").save(str(tmp_path))


# Published versions


def test_a_failed_publication_leaves_the_version_before(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError, match="nothing is published"):
        writers.published(spark, path)
    good = spark.range(5)
    assert writers.publish(good, path) == 1
    held = writers.published(spark, path)
    bad = spark.range(9).select(F.when(F.col("id") == 7, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        writers.publish(bad, path)
    assert writers.published(spark, path).count() == 5
    assert writers.publish(spark.range(3), path) == 2
    assert (writers.published(spark, path).count(), held.count(), writers.published(spark, path, 1).count()) == (3, 5, 5)
    assert [r.version for r in writers.versions(spark, path).orderBy("version").collect()] == [1, 2]


def test_scores_of_a_dataset_read_its_folder_only(spark, tmp_path):
    path = str(tmp_path / "s")
    writers.scores(spark.createDataFrame([("a", 1, 0.5), ("b", 2, 0.25)], "dataset string, row long, rho double"), path)
    own = readers.scores(spark, path, "b", ("row", "rho"))
    assert [tuple(r) for r in own.collect()] == [(2, 0.25)]
    assert "PartitionFilters: [isnotnull(dataset" in own._jdf.queryExecution().executedPlan().toString()


# Streams

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def micros_of(seconds):
    return int(START.timestamp() * 1_000_000) + round(seconds * 1_000_000)


def arrive(spark, folder, rows):
    """One more file of (k, seconds, value)."""
    df = spark.createDataFrame([(k, START + timedelta(seconds=s), v) for k, s, v in rows], "k int, ts timestamp, v double")
    df.coalesce(1).write.mode("append").parquet(folder)
    time.sleep(1.1)  # files are taken by their time of change


@pytest.fixture
def flow(spark, tmp_path):
    old = spark.conf.get(ordered.STATE_STORE[0])
    spark.conf.set(*ordered.STATE_STORE)
    files, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def run(build, keys, sink=None):
        source = spark.readStream.schema("k int, ts timestamp, v double").option("maxFilesPerTrigger", 1).parquet(files)
        stream = build(source)
        started = stream.writeStream.foreachBatch(sink or writers.keyed_sink(out, keys)).option("checkpointLocation", state).trigger(availableNow=True).start()
        started.awaitTermination()
        return [tuple(r) for r in writers.written(spark, out, stream.schema).select(*stream.columns).collect()]

    yield files, run
    spark.conf.set(ordered.STATE_STORE[0], old)


def test_streamed_rules_are_those_of_tables_after_a_restart(spark, flow, tmp_path):
    files, run = flow
    rng = np.random.default_rng(8)
    waves = []
    for n in range(4):
        t = rng.uniform(100 * n, 100 * n + 130, 60)  # up to 30 s behind what has been seen
        waves.append([(int(k), float(round(s, 3)), float(v)) for k, s, v in zip(rng.integers(1, 4, 60), t, rng.random(60).round(6), strict=True)])
    late = [(1, 1.5, 9.0), (2, 2.5, 9.0), (9, 0.5, 9.0)]  # far behind the watermark by then
    waves[3] += late
    waves.append([(k, 10_000.0, 0.0) for k in (1, 2, 3)])  # moves the watermark past all
    spacing = lambda s: ordered.spaced(s, "ts", 7_000_000, ["k"], "60 seconds")
    for part in (waves[:2], waves[2:]):  # the second run goes on from the checkpoint of the first
        for w in part:
            arrive(spark, files, w)
        got = run(spacing, ["k", "us"])
    seen = [r for w in waves for r in w if r not in late]
    table = spark.createDataFrame([(k, micros_of(s)) for k, s, _ in seen], "k int, us long")
    want = Counter((r.k, r.us) for r in intervals.spaced(table, "us", 7_000_000, ["k"], 50_000_000).collect())
    end = micros_of(10_000 - 60)
    assert Counter(got) == Counter({x: n for x, n in want.items() if x[1] < end})
    assert run(spacing, ["k", "us"]) and Counter(run(spacing, ["k", "us"])) == Counter(got)  # nothing new, nothing twice


def test_streamed_clusters_close_when_the_watermark_has_passed(spark, flow):
    files, run = flow
    build = lambda s: ordered.gap_clusters(s, "ts", "v", 5_000_000, ["k"], "10 seconds")
    arrive(spark, files, [(1, 0.0, 1.0), (1, 4.0, 3.0), (1, 4.0, 2.0), (1, 9.5, 3.0), (2, 1.0, 5.0)])
    assert run(build, ["k", "first"]) == []
    arrive(spark, files, [(1, 5.0, 0.5), (1, 30.0, 1.0)])  # the first was still waiting: one cluster to 9.5
    got = run(build, ["k", "first"])
    us = micros_of
    assert sorted(got) == [(1, us(0), us(9.5), 4, us(4), 3.0), (2, us(1), us(1), 1, us(1), 5.0)]
    arrive(spark, files, [(1, 33.0, 7.0), (1, 12.0, 99.0), (3, 100.0, 0.0)])  # 12 is late
    assert sorted(run(build, ["k", "first"]))[1] == (1, us(30), us(33), 2, us(33), 7.0)


def test_a_trigger_that_is_reported_again_within_the_watermark_counts_once(spark, flow):
    files, run = flow
    build = lambda s: alarms.distinct_triggers(s.select(F.lit("H1").alias("detector"), F.col("k").alias("trigger_id"), "ts"), "60 seconds")
    arrive(spark, files, [(1, 0.0, 0.0), (2, 5.0, 0.0)])
    arrive(spark, files, [(1, 20.0, 0.0), (2, 10.0, 0.0), (3, 15.0, 0.0)])
    assert sorted(x[1] for x in run(build, ["trigger_id", "ts"])) == [1, 2, 3]
    arrive(spark, files, [(9, 500.0, 0.0)])
    run(build, ["trigger_id", "ts"])
    arrive(spark, files, [(1, 600.0, 0.0)])  # long after: a new one
    assert sorted(x[1] for x in run(build, ["trigger_id", "ts"])) == [1, 1, 2, 3, 9]


def test_a_batch_lost_between_write_and_commit_gives_each_row_once(spark, flow, tmp_path):
    files, run = flow
    put = writers.keyed_sink(str(tmp_path / "out"), ["k", "ts"])
    seen = []

    def dying(batch, number):
        put(batch, number)
        seen.append(number)
        if seen.count(1) == 1 and number == 1:
            raise RuntimeError("killed before the commit")

    arrive(spark, files, [(1, 0.0, 1.0), (2, 0.0, 1.0), (2, 0.0, 1.0)])
    arrive(spark, files, [(1, 1.0, 1.0), (1, 0.0, 5.0)])  # the second key is known
    with pytest.raises(Exception, match="killed before the commit"):
        run(lambda s: s, ["k", "ts"], dying)
    rows = run(lambda s: s, ["k", "ts"], dying)
    assert seen == [0, 1, 1] and sorted((k, v) for k, _, v in rows) == [(1, 1.0), (1, 1.0), (2, 1.0)] and len({(k, t) for k, t, _ in rows}) == 3


# Laying out blocks


def test_blocks_are_laid_out_up_to_the_quota(spark):
    rng = np.random.default_rng(6)
    own = {(k, int(b)) for k in ("a", "b", None) for b in rng.integers(0, 60, 40)}
    df = spark.createDataFrame(list(own), "stretch string, block long")
    got = {(r.stretch, r.block): (r.role, r.done) for r in layout.laid_out(df, "stretch", 6).collect()}
    want = {}
    for k in ("a", "b", None):
        done, before = 0, None
        for b in sorted(b for x, b in own if x == k):
            if done >= 6:
                break
            role = int(before == b - 1)
            want[k, b] = (role, done)
            before, done = b, done + role
    assert got == want
    assert layout.laid_out(df.where("false"), "stretch", 6).count() == 0 and layout.laid_out(df, "stretch", 0).count() == 0


# Summaries


def test_summaries_add_up_and_take_a_day_again(spark, tmp_path):
    rng = np.random.default_rng(12)
    rows = [(int(d), str(a), round(float(v), 2) if v > 0.05 else None) for d, a, v in zip(rng.integers(0, 3, 900), rng.choice(["x", "y", "signal"], 900), rng.gamma(2, 3, 900), strict=True)]
    df = spark.createDataFrame(rows, "day long, arm string, score double")
    counts, path = summaries.summarise(df, "score", ["day", "arm"]), str(tmp_path / "s")
    for days in ("day < 2", "day = 2", "day = 2"):
        summaries.store(counts.where(days), path)
    back = summaries.stored(spark, path, counts)
    assert back.agg(F.sum("n")).first()[0] == 900
    limits = {r.fap: r.threshold for r in summaries.thresholds(back.where("arm <> 'signal'"), (0.1, 0.01)).collect()}
    want = {r.fap: r.threshold for r in evaluate.thresholds(df.where("arm <> 'signal'"), "score", (0.1, 0.01)).collect()}
    assert limits == pytest.approx(want)
    table = spark.createDataFrame(list(want.items()), "fap double, threshold double")
    got = {(r.fap, r.arm): (r.total, r.share) for r in summaries.shares_above(summaries.merged(back, ["arm"]), table, ["arm"]).collect()}
    for (fap, arm), (total, share) in got.items():
        own = [s for _, a, s in rows if arm in (a, None)]
        scored = [s for s in own if s is not None]
        assert total == len(own) and share == pytest.approx(sum(s > want[fap] for s in scored) / len(scored))
    marked = df.withColumn("positive", F.col("arm") == "signal").withColumn("one", F.lit(1))
    area = evaluate.auc(marked, "score", "positive", ["one"]).first()
    own = summaries.merged(back, ["arm"]).withColumn("positive", F.col("arm") == "signal").withColumn("one", F.lit(1))
    assert tuple(summaries.auc(own, "positive", ["one"]).first()) == pytest.approx(tuple(area))
