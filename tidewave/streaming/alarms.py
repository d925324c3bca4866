"""False alarms as a stream: counts above a threshold by event-time window, with late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_alarms(scores: DataFrame, threshold: float, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, detector, n, alarms) of scores (ts, detector, score, is_signal), for streams and tables alike.

    Only background rows count; a score equal to the threshold is no alarm, nor is a null.
    """
    background = scores.where(~F.col("is_signal")).withWatermark("ts", late)
    return (
        background.groupBy(F.window("ts", width), "detector")
        .agg(F.count("*").alias("n"), F.count_if(F.col("score") > threshold).alias("alarms"))
        .select(F.col("window.start").alias("start"), "detector", "n", "alarms")
    )


def distinct_triggers(triggers: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first report of each trigger (detector, trigger_id) among those that come within `late` of one another."""
    return triggers.withWatermark("ts", late).dropDuplicatesWithinWatermark(["detector", "trigger_id"])
