"""Readers of trigger files, strain blocks and crop datasets, with the columns that each use needs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.functions import arrays
from tidewave.operators import network
from tidewave.sources.writers import published

TRIGGERS = "peak_time long, peak_time_ns long, duration double, peak_frequency double, snr double, ml_label string, ml_confidence double"
#: Samples a second, samples of a buffer, and the last whole second of a block at which a buffer starts.
RATE, BUFFER, LAST_OFFSET = 2048, 8192, 508
SATURATION = 20.0


def triggers(spark: SparkSession, path: str, least: float = 0.9, without: tuple[str, ...] = ()) -> DataFrame:
    """A trigger CSV file with header: gps (seconds) beside its columns, of confidence `least` or more and not of the classes `without`.

    Columns are found by name; a row without a label has no class to leave out and stays.
    """
    names = [c.split()[0] for c in TRIGGERS.split(", ")]
    kinds = dict(c.split() for c in TRIGGERS.split(", "))
    raw = spark.read.option("header", True).csv(path)
    typed = raw.select(*(F.col(c).try_cast(kinds[c]).alias(c) for c in names))
    kept = typed.where(F.col("ml_confidence") >= least)
    if without:
        kept = kept.where(F.col("ml_label").isNull() | ~F.col("ml_label").isin(*without))
    return kept.withColumn("gps", F.col("peak_time") + F.col("peak_time_ns") * 1e-9)


def crops(spark: SparkSession, path: str, split: str | None = None, arm: str = "x", limit: float | None = SATURATION) -> DataFrame:
    """A dataset's rows of one split with the metadata and one arm's array as x, saturated at `limit`.

    Columns that an earlier dataset lacks come as not a glitch.
    """
    rows = spark.read.parquet(path)
    if split is not None:
        rows = rows.where(F.col("split") == split)
    others = [c for c in rows.columns if c != arm and not c.startswith("x")]
    x = arrays.saturated(F.col(arm), limit) if limit is not None else F.col(arm)
    out = rows.select(*others, x.alias("x"))
    for name, kind, none in (("is_glitch", "tinyint", 0), ("glitch_label", "smallint", -1)):
        if name not in rows.columns:
            out = out.withColumn(name, F.lit(none).cast(kind))
    return out


def dataset(spark: SparkSession, path: str, at: str, width: float, split: str | None = None, start: float | None = None, end: float | None = None) -> DataFrame:
    """Rows of a published dataset (writers.dataset, of the same `at` and width) of one split with start <= at < end; each limit may be left out."""
    rows = published(spark, path)
    if split is not None:
        rows = rows.where(F.col("split") == split)
    if start is not None:
        rows = rows.where((F.col("time_file") >= int(start // width)) & (F.col(at) >= start))
    if end is not None:
        rows = rows.where((F.col("time_file") <= int(end // width)) & (F.col(at) < end))
    return rows.drop("time_file")


def noise_hours(rows: DataFrame) -> DataFrame:
    """Hours of background: each negative row is a second."""
    return rows.agg((F.count_if(F.col("y") == 0) / 3600).alias("hours"))


def buffer(strain: Column, offset: Column, rate: int = RATE, length: int = BUFFER) -> Column:
    """`length` samples from a whole second of a block; null if the block does not hold them all."""
    whole = (offset >= 0) & (offset * rate + length <= F.size(strain))
    return F.when(whole, F.slice(strain, (offset * rate + 1).cast("int"), length))


def buffers_at(blocks: DataFrame, times: DataFrame, rate: int = RATE, length: int = BUFFER) -> DataFrame:
    """times (detector, t) with the buffer x that starts at the sample nearest to t, from blocks (detector, gps, strain).

    Blocks are cut into whole seconds, and a time is joined with the seconds that its buffer touches, in one block or in
    two that follow each other; so no whole block is shuffled. A time whose buffer is not all there is an error when the rows are read.
    """
    seconds = blocks.select(
        "detector", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(F.size("strain") / rate).cast("int") - 1), lambda s: F.slice("strain", s * rate + 1, rate))).alias("_s", "_x"), "gps"
    ).select("detector", (F.floor("gps") + F.col("_s")).alias("_second"), (F.col("gps") - F.floor("gps")).alias("_shift"), "_x")
    first = F.round(F.col("t") * rate).cast("long")
    span = F.sequence(F.floor(first / rate), F.floor((first + length - 1) / rate))
    wanted = times.select("detector", "t").distinct().withColumn("_first", first).withColumn("_second", F.explode(span)).withColumn("_n", F.size(span))
    met = wanted.join(seconds.where("_shift = 0"), ["detector", "_second"], "left")
    parts = met.groupBy("detector", "t", "_first", "_n").agg(F.array_sort(F.collect_list(F.when(F.col("_x").isNotNull(), F.struct("_second", "_x")))).alias("_p"))
    whole = F.flatten(F.transform("_p", lambda p: p["_x"]))
    x = F.slice(whole, (F.col("_first") - F.col("_p")[0]["_second"] * rate + 1).cast("int"), length)
    found = F.when(F.size("_p") == F.col("_n"), x).otherwise(F.raise_error(F.concat(F.lit("no strain for a buffer of "), "detector", F.lit(" at "), F.col("t").cast("string"))))
    return times.join(parts.select("detector", "t", found.alias("x")), ["detector", "t"])


def off_source(start: float, end: float, event: float, spark: SparkSession, detector: str, seconds: float = BUFFER / RATE, hop: float = 1.0) -> DataFrame:
    """(detector, t): starts of background buffers, `hop` apart, over a stretch, without those that touch the buffer of an event."""
    n = int((end - seconds - start) // hop) + 1
    t = F.lit(start) + F.col("id") * hop
    return spark.range(max(0, n)).select(F.lit(detector).alias("detector"), t.alias("t")).where((F.col("t") + seconds <= event) | (F.col("t") >= event + seconds))


def model(spark: SparkSession, path: str) -> dict:
    """The weights of a network stored as rows (name, shape, x); a set that is not whole is an error."""
    return network.from_rows([tuple(r) for r in published(spark, path).select("name", "shape", "x").collect()])  # the layers of one model


def scores(spark: SparkSession, path: str, dataset: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """The current scores of one dataset, whose folder alone is read."""
    rows = published(spark, path).where(F.col("dataset") == dataset)
    return rows.select(*columns) if columns else rows


def models(spark: SparkSession, arms: dict[str, tuple[str, str]]) -> dict:
    """For each arm (path of its weights, column it scores) the weights and column; an arm without weights there is left out."""
    found = {}
    for name, (path, column) in arms.items():
        try:
            found[name] = model(spark, path), column
        except FileNotFoundError:
            pass
    return found


def remembered(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at path, which build() makes if it is not there: a remote or costly result is fetched once."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    build().write.parquet(path)
    return spark.read.parquet(path)


def step_inputs(specs: DataFrame) -> DataFrame:
    """What a step that builds samples may see of their specs: all but the split."""
    return specs.drop("split")


def without_parameters(specs: DataFrame, label: str, parameters: tuple[str, ...]) -> DataFrame:
    """specs with parameters 0 where there is no signal."""
    return specs.withColumns({p: F.when(F.col(label) == 0, F.lit(0).cast(specs.schema[p].dataType)).otherwise(F.col(p)) for p in parameters})


def widened(search, span: float, quota: int, most: float) -> tuple[DataFrame, float]:
    """search(span) of the smallest doubled span that gives `quota` rows; an error beyond `most`."""
    while span <= most:
        found = search(span)
        if found.limit(quota).count() >= quota:
            return found, span
        span *= 2
    raise ValueError(f"fewer than {quota} rows within {most}")
