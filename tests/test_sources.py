"""Readers, writers and the streaming counts, over small files."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewave.operators import evaluate
from tidewave.sources import readers, writers
from tidewave.streaming import alarms


def test_triggers_are_found_by_name_and_keep_rows_without_label(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("ml_label,peak_time,peak_time_ns,snr,duration,peak_frequency,ml_confidence,more\nBlip,10,500000000,9,1,100,0.95,x\nNone,11,0,9,1,100,0.99,x\n,12,0,bad,1,100,0.9,x\nBlip,13,0,9,1,100,0.89,x\n")
    rows = {r.peak_time: r for r in readers.triggers(spark, str(path), without=("None",)).collect()}
    assert sorted(rows) == [10, 12] and rows[10].gps == 10.5 and rows[12].snr is None and rows[12].ml_label is None


def test_crops_of_a_split_are_saturated_in_every_arm(spark, tmp_path):
    spark.createDataFrame([(1, 0, "val", [30.0, -1.0], [1.0, 2.0]), (2, 1, "test", [0.0, -50.0], [5.0, 6.0])], "row long, y int, split string, x array<double>, x_raw array<double>").write.parquet(str(tmp_path / "d"))
    (one,) = readers.crops(spark, str(tmp_path / "d"), "test").collect()
    assert (one.row, one.x, one.is_glitch, one.glitch_label) == (2, [0.0, -20.0], 0, -1)
    (raw,) = readers.crops(spark, str(tmp_path / "d"), "val", arm="x_raw", limit=None).collect()
    assert raw.x == [1.0, 2.0]
    assert readers.noise_hours(readers.crops(spark, str(tmp_path / "d"))).first().hours == pytest.approx(1 / 3600)


def test_buffers_by_offset_and_by_time(spark):
    blocks = spark.createDataFrame([("H1", 100.0, [float(i) for i in range(40)]), ("H1", 110.0, [100.0 + i for i in range(40)])], "detector string, gps double, strain array<double>")
    whole = blocks.select("gps", *(readers.buffer(F.col("strain"), F.lit(o), 4, 8).alias(f"o{o}") for o in (-1, 0, 8, 9))).where("gps = 100").first()
    assert (whole["o-1"], whole.o0, whole.o8, whole.o9) == (None, [float(i) for i in range(8)], [float(i) for i in range(32, 40)], None)
    times = lambda *t: spark.createDataFrame([("H1", x) for x in t], "detector string, t double")
    out = {r.t: r.x for r in readers.buffers_at(blocks, times(101.25, 110.0, 109.0), 4, 8).collect()}
    assert out == {101.25: [float(i) for i in range(5, 13)], 110.0: [100.0 + i for i in range(8)], 109.0: [36.0, 37.0, 38.0, 39.0, 100.0, 101.0, 102.0, 103.0]}
    for outside in (99.0, 118.5, 500.0):
        with pytest.raises(Exception, match="no strain for a buffer"):
            readers.buffers_at(blocks, times(101.0, outside), 4, 8).collect()
    assert [r.t for r in readers.off_source(100.0, 112.0, 104.0, spark, "H1", 2.0).orderBy("t").collect()] == [100.0, 101.0, 102.0, 106.0, 107.0, 108.0, 109.0, 110.0]


def test_an_interrupted_write_goes_on_where_it_stopped(spark, tmp_path):
    path, built = str(tmp_path / "out"), []

    def build(plan):
        built.append(plan.count())
        return plan.withColumn("v", F.col("k") * 2)

    plan = spark.range(10).select(F.col("id").alias("k"))
    writers.append_missing(plan.where("k < 4"), path, ["k"], build)
    writers.append_missing(plan, path, ["k"], build)
    writers.append_missing(plan, path, ["k"], build)
    assert built == [4, 6, 0]
    with pytest.raises(ValueError, match="another plan"):
        writers.append_missing(plan.where("k > 4"), path, ["k"], build)
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(k, 2 * k) for k in range(10)]


def test_score_folders_attributes_and_checkpoints(spark, tmp_path):
    writers.scores(spark.createDataFrame([("a", 1, 0.5), ("b", 2, 0.25)], "dataset string, row long, rho double"), str(tmp_path / "s"))
    assert [r.row for r in writers.published(spark, str(tmp_path / "s")).where("dataset = 'b'").collect()] == [2]
    writers.attributes(spark, str(tmp_path / "a"), {"seed": 7, "norm": 1.5})
    assert {r.name: r.value for r in writers.published(spark, str(tmp_path / "a")).collect()} == {"seed": "7", "norm": "1.5"}
    epochs = spark.createDataFrame([("s", e, v, [float(e)]) for e, v in ((1, 0.5), (2, 0.9), (3, 0.9), (4, 0.1))], "arm string, epoch int, val_auc double, weights array<double>")
    assert writers.best_checkpoint(epochs, ["arm"]).first().epoch == 2


def test_training_stops_before_a_later_best(spark):
    values = [1, 3, 2, 3, 2, 9]
    epochs = spark.createDataFrame([("a", e, v) for e, v in enumerate(values, 1)], "arm string, epoch int, v int")
    r = evaluate.early_stop(epochs, ["arm"], "epoch", "v", patience=3).first()
    assert (r.best_epoch, r.best, r.stopped_at) == (2, 3, 5)


def test_differences_count_nulls_as_equal(spark):
    left = spark.createDataFrame([(1, None, 1.0), (2, "x", 2.0), (3, "y", 3.0)], "k int, a string, b double")
    right = spark.createDataFrame([(1, None, 1.5), (2, None, 2.0), (4, "y", 3.0)], "k int, a string, b double")
    assert {r.name: r.n for r in evaluate.differing(left, right, ["k"]).collect()} == {"left only": 1, "right only": 1, "a": 1, "b": 1}


def test_a_stream_gives_the_counts_of_the_table(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, h, m), "H1", s, sig) for h, m, s, sig in ((0, 1, 0.9, False), (0, 59, 0.5, False), (0, 30, 0.99, True), (1, 0, 0.7, False), (9, 0, 0.1, False))]
    scores = spark.createDataFrame(rows, "ts timestamp, detector string, score double, is_signal boolean")
    scores.write.parquet(str(tmp_path / "in"))
    want = {(r.start, r.n, r.alarms) for r in alarms.windowed_alarms(scores, 0.5).collect()}
    assert {x[1:] for x in want} == {(2, 1), (1, 1), (1, 0)}
    stream = spark.readStream.schema(scores.schema).parquet(str(tmp_path / "in"))
    out = alarms.windowed_alarms(stream, 0.5).writeStream.outputMode("append").format("memory").queryName("alarms").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert out.awaitTermination(120)
    got = {(r.start, r.n, r.alarms) for r in spark.table("alarms").collect()}
    assert got == {x for x in want if x[0] < datetime(2024, 1, 1, 8)}  # the last window stays open until the watermark passes it


def test_models_and_results_are_kept(spark, tmp_path):
    from tidewave.operators import network

    w, path = network.weights(5), str(tmp_path / "w")
    writers.model(spark, path, w)
    back = readers.model(spark, path)
    assert set(back) == set(w) and all((back[k] == w[k]).all() for k in w)
    with pytest.raises(ValueError):
        network.from_rows(network.to_rows(w)[1:])
    assert set(readers.models(spark, {"a": (path, "x"), "b": (str(tmp_path / "none"), "x")})) == {"a"}
    assert 0 < network.speed(w, 2, 1) < 10
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    assert [readers.remembered(spark, str(tmp_path / "r"), build).count() for _ in range(2)] == [3, 3] and built == [1]


def test_specs_and_searches(spark):
    specs = spark.createDataFrame([(0, 5.0, 1, "train"), (1, 6.0, 2, "test")], "y int, m double, k int, split string")
    assert readers.step_inputs(specs).columns == ["y", "m", "k"]
    assert [tuple(r) for r in readers.without_parameters(specs, "y", ("m", "k")).orderBy("y").collect()] == [(0, 0.0, 0, "train"), (1, 6.0, 2, "test")]
    near = lambda span: spark.range(100).where(F.col("id") < span)
    found, span = readers.widened(near, 3, 10, 50)
    assert (found.count(), span) == (12, 12)
    with pytest.raises(ValueError):
        readers.widened(near, 3, 60, 50)


def test_a_scan_of_a_split_and_a_stretch_of_time_reads_only_its_files(spark, tmp_path):
    path, adaptive = str(tmp_path / "d"), spark.conf.get("spark.sql.adaptive.enabled")
    rows = spark.range(4000).select("id", (F.col("id") * 2.5).alias("gps"), F.when(F.col("id") < 3200, "train").when(F.col("id") < 3600, "val").otherwise("test").alias("split"), F.array(F.col("id").cast("double")).alias("x"))
    writers.dataset(rows.orderBy(F.rand(1)), path, "gps", 500.0, 20)
    files = len(list(tmp_path.glob("d/*/split=*/time_file=*/*.parquet")))
    assert 20 <= files <= 45  # a range may end within a time file

    def read(*limits):
        df = readers.dataset(spark, path, "gps", 500.0, *limits).select("id", "gps")
        got = sorted(r.id for r in df.collect())
        plan = df._jdf.queryExecution().executedPlan()
        scan = plan.collectLeaves().apply(0)
        return got, scan.metrics().apply("numFiles").value(), plan.toString()

    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got, n, plan = read("train", 1200.0, 1700.0)
        assert got == list(range(480, 680)) and n <= 4 and "PushedFilters: [IsNotNull(gps), GreaterThanOrEqual(gps,1200.0), LessThan(gps,1700.0)]" in plan and "x:" not in plan
        assert read("test", None, None)[0] == list(range(3600, 4000)) and read("test", None, None)[1] <= 6
        assert read("val", 0.0, 100.0)[:2] == ([], 0)
        assert len(read(None, None, None)[0]) == 4000 and read(None, None, None)[1] == files
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    writers.dataset(rows.where("id < 10"), path, "gps", 500.0, 2)
    assert readers.dataset(spark, path, "gps", 500.0).count() == 10
