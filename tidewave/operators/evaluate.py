"""Comparing detectors at equal false-alarm probability: thresholds, ROC, efficiencies, seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.session import cut


def thresholds(negatives: DataFrame, score: str, faps: tuple[float, ...], weight: Column | None = None) -> DataFrame:
    """(fap, threshold): the scores that given shares of the negatives exceed (exact, interpolated)."""
    shares = {1 - f: f for f in faps}
    found = percentiles(negatives, score, [], list(shares), weight)
    names = F.create_map(*(F.lit(x) for pair in shares.items() for x in pair))
    return found.select(names[F.col("share")].alias("fap"), F.col("value").alias("threshold"))


def above(score: str, limit: str) -> Column:
    """The share of rows strictly above a threshold; null scores do not count."""
    return F.avg((F.col(score) > F.col(limit)).cast("double"))


def wilson(k: Column, n: Column, z: float = 1.0) -> tuple[Column, Column]:
    """Wilson interval of k of n; 0, 0 if n is 0."""
    n = F.when(n > 0, n)
    p = k / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.coalesce(middle - half, F.lit(0.0)), F.coalesce(middle + half, F.lit(0.0))


def _ranges(counted: DataFrame, score: str, pieces: int = 200) -> DataFrame:
    """Counts by score, written once, with _range, the number of the range of scores that a row is in: about equally filled, the edges being a few numbers on the driver."""
    df = cut(counted)
    edges = df.agg(F.percentile_approx(score, F.lit([i / pieces for i in range(1, pieces)]), F.lit(1000))).first()[0] or []
    edges = F.lit(sorted(set(edges)))
    low = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.struct(F.lit(0).alias("a"), F.size(edges).alias("b")), lambda s, _: _half(s, edges, F.col(score)))
    return df.withColumn("_range", low["a"])


def _half(s: Column, edges: Column, x: Column) -> Column:
    """One step of a search for the number of edges at or below x, which lies from s.a to s.b."""
    middle = F.floor((s["a"] + s["b"]) / 2).cast("int")
    up = F.get(edges, middle) <= x
    return F.when(s["a"] >= s["b"], s).when(up, F.struct((middle + 1).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), middle.alias("b")))


def auc(df: DataFrame, score: str, positive: str, keys: list[str], weight: Column | None = None) -> DataFrame:
    """Area under the ROC curve by key, ties counting half: from counts by score and a running sum of the negatives.

    Rows are summed by (key, score); running sums go within ranges of scores and are shifted by the sums of the ranges
    before (a few hundred rows for each key), so no task holds all of a key's scores. A row counts `weight` times (once).
    """
    one = F.lit(1) if weight is None else weight
    by = df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.sum(F.col(positive).cast("long") * one).alias("p"), F.sum((~F.col(positive)).cast("long") * one).alias("n"))
    by = _ranges(by, score)
    sums = by.groupBy(*keys, "_range").agg(F.sum("n").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    shifts = sums.select(*keys, "_range", before.alias("_before"))
    order = Window.partitionBy(*keys, "_range").orderBy(score).rowsBetween(Window.unboundedPreceding, 0)
    inside = by.withColumn("_inside", F.sum("n").over(order))
    won = inside.join(shifts, [*keys, "_range"]).withColumn("won", F.col("p") * (F.col("_before") + F.col("_inside") - F.col("n") / 2))
    total = F.sum("p") * F.sum("n")
    return won.groupBy(*keys).agg((F.sum("won") / F.when(total > 0, total)).alias("auc"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))


def percentiles(df: DataFrame, score: str, keys: list[str], shares: list[float], weight: Column | None = None) -> DataFrame:
    """(*keys, share, value): exact percentiles by key, interpolated; null scores do not count, a row counts `weight` times (once).

    Counts by ranges of scores tell in which range a rank lies; only the scores of those ranges are ordered, so no
    task holds all of a key's scores.
    """
    by = _ranges(df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("_s")).agg((F.count("*") if weight is None else F.sum(weight)).alias("_n")), "_s")
    sums = by.groupBy(*keys, "_range").agg(F.sum("_n").alias("_in"))
    so_far = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = sums.select(*keys, "_range", (F.sum("_in").over(so_far) - F.col("_in")).alias("_before"), F.col("_in"), F.sum("_in").over(Window.partitionBy(*keys)).alias("_all"))
    rank = ranges.withColumn("share", F.explode(F.lit(shares).cast("array<double>"))).withColumn("_rank", F.col("share") * (F.col("_all") - 1))
    # a rank needs the scores at its floor and its ceiling, which may lie in two ranges
    wanted = rank.where((F.floor("_rank") < F.col("_before") + F.col("_in")) & (F.ceil("_rank") >= F.col("_before"))).select(*keys, "_range", "_before", "share", "_rank")
    order = Window.partitionBy(*keys, "_range", "share").orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    placed = by.join(wanted, [*keys, "_range"]).withColumn("_last", F.col("_before") + F.sum("_n").over(order) - 1)
    at = lambda place: F.max(F.when((F.col("_last") >= place) & (F.col("_last") - F.col("_n") < place), F.col("_s")))
    low, high, part = at(F.floor("_rank")), at(F.ceil("_rank")), F.max("_rank") - F.floor(F.max("_rank"))
    return placed.groupBy(*keys, "share").agg((low + (high - low) * part).alias("value"))


def reweighted(rho: Column, chisq: Column) -> Column:
    """The signal-to-noise ratio, lowered where the reduced chi-square exceeds 1."""
    return F.when(chisq <= 1, rho).otherwise(rho / F.pow((1 + F.pow(chisq, 3)) / 2, F.lit(1 / 6)))


def roc_curve(df: DataFrame, score: str, positive: str, keys: list[str]) -> DataFrame:
    """True and false positives at or above each different score, by key; null scores do not count."""
    by = _ranges(df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n")), score)
    above = Window.partitionBy(*keys).orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a few hundred ranges
    sums = by.groupBy(*keys, "_range").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    shifts = sums.select(*keys, "_range", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(c) for c in ("_p", "_n")))
    order = Window.partitionBy(*keys, "_range").orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    inside = by.select(*keys, "_range", score, F.sum("p").over(order).alias("p"), F.sum("n").over(order).alias("n"))
    return inside.join(shifts, [*keys, "_range"]).select(*keys, score, (F.col("p") + F.col("_p")).alias("tp"), (F.col("n") + F.col("_n")).alias("fp"))


def early_stop(epochs: DataFrame, keys: list[str], epoch: str, metric: str, patience: int = 6) -> DataFrame:
    """best_epoch, best and stopped_at by key: training ends after `patience` epochs that did not beat the best before (strictly)."""
    order = Window.partitionBy(*keys).orderBy(epoch)
    before = F.max(metric).over(order.rowsBetween(Window.unboundedPreceding, -1))
    better = F.when(before.isNull() | (F.col(metric) > before), F.col(epoch))
    marked = epochs.withColumn("_better", better).withColumn("_last", F.max("_better").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ended = marked.withColumn("_end", F.max((F.col(epoch) - F.col("_last") >= patience).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    run = ended.where(F.coalesce("_end", F.lit(0)) == 0)
    return run.groupBy(*keys).agg(F.max("_last").alias("best_epoch"), F.max(metric).alias("best"), F.max(epoch).alias("stopped_at"))


def differing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(name, n): rows whose values differ, for each shared column, and rows of one side only; nulls equal nulls."""
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    a, b = left.select(*keys, F.struct(*shared).alias("_a")), right.select(*keys, F.struct(*shared).alias("_b"))
    both = a.join(b, keys, "full")
    only = lambda c: F.count_if(F.col(c).isNull())
    met = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    counts = both.agg(only("_b").alias("left only"), only("_a").alias("right only"), *(F.count_if(met & ~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}"))).alias(c) for c in shared))
    return counts.unpivot([], counts.columns, "name", "n")


def loss(logit: str, y: str) -> Column:
    """The mean cross entropy of logits and labels 0 or 1, without overflow."""
    z = F.col(logit)
    return F.avg(F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - z * F.col(y))


def spread(results: DataFrame, arm: str, value: str) -> DataFrame:
    """(arm, mean, sd, worst, best) of the values that an arm's seeds gave."""
    return results.groupBy(arm).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.min(value).alias("worst"), F.max(value).alias("best"))


def separated(results: DataFrame, arm: str, value: str) -> DataFrame:
    """For each two arms: separated if every seed of the second is above every seed of the first, and how many deviations their means are apart."""
    s = spread(results, arm, value)  # one row for each arm
    p, q = s.select(*(F.col(c).alias(f"_{c}") for c in s.columns)), s
    verdict = F.when(F.col("_best") < F.col("worst"), "separated").otherwise("overlapping")
    gap = (F.col("mean") - F.col("_mean")) / F.sqrt((F.col("_sd") * F.col("_sd") + F.col("sd") * F.col("sd")) / 2)
    return p.join(q, F.col(f"_{arm}") < F.col(arm)).select(F.col(f"_{arm}").alias(arm), F.col(arm).alias("other"), verdict.alias("verdict"), gap.alias("gap"))
