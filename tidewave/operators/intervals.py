"""Interval and ordered operators: range joins, as-of joins, clusters, spacing, merging, subtraction.

A join on a range becomes an equi-join on grid cells, so no nested loops are planned, whatever the sizes. Ordered
operators go by time files of a given width (scans.py), so a key may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.operators import scans
from tidewave.session import cut


def micros(ts: str = "ts") -> Column:
    """Microseconds since 1970 of a zoneless timestamp (the session zone is UTC)."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def range_join(points: DataFrame, spans: DataFrame, at: str, lo: str, hi: str, cell: int, keys: tuple[str, ...] = (), how: str = "inner") -> DataFrame:
    """Pairs with lo <= at < hi and equal keys; also left_semi and left_anti of the points.

    Each span is listed in the grid cells of width `cell` that it touches; take a cell about as wide as the spans.
    """
    cells = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor((F.col(hi) - 1) / cell)))).where(F.col(lo) < F.col(hi))
    own = points.withColumn("_cell", F.floor(F.col(at) / cell))
    p, s = own.alias("p"), cells.alias("s")
    on = (F.col("p._cell") == F.col("s._cell")) & (F.col(f"p.{at}") >= F.col(f"s.{lo}")) & (F.col(f"p.{at}") < F.col(f"s.{hi}"))
    for k in keys:
        on = on & (F.col(f"p.{k}") == F.col(f"s.{k}"))
    joined = p.join(s, on, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("_cell")
    return joined.select("p.*", *(F.col(f"s.{c}") for c in spans.columns if c not in keys)).drop("_cell")


def asof(left: DataFrame, right: DataFrame, at: str, keys: list[str], values: list[str], width: int) -> DataFrame:
    """left with the values of the last row of right at or before it: a union and a running last."""
    names = [c for c in left.columns if c not in (at, *keys)]
    a = left.select(*keys, at, F.struct(*names).alias("_left"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_right"))
    b = right.select(*keys, at, F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), F.lit(0).alias("_side"), F.struct(*values).alias("_right"))
    both = scans.running(a.unionByName(b), keys, at, width, [at, "_side"], {"_found": (F.col("_right"), "last")}, inclusive=True)
    return both.where("_side = 1").select(*keys, at, "_left.*", *(F.col(f"_found.{v}").alias(v) for v in values))


def gap_clusters(df: DataFrame, at: str, gap: int, keys: list[str], width: int) -> DataFrame:
    """A column cluster, from 1 in each key: a new one starts after more than `gap` without a row."""
    before = scans.running(df, keys, at, width, [at], {"_before": (F.col(at), "last")})
    new = F.when(F.col(at) - F.col("_before") > gap, 1).otherwise(0)
    numbered = scans.running(before, keys, at, width, [at], {"cluster": (new, "sum")}, inclusive=True)
    return numbered.withColumn("cluster", F.col("cluster") + 1).drop("_before")


def spaced(df: DataFrame, at: str, least: int, keys: list[str], width: int) -> DataFrame:
    """The times kept by the greedy rule: at least `least` after the last one kept, in each key."""
    return scans.spaced(df, at, least, keys, width)


def merged(spans: DataFrame, lo: str, hi: str, keys: list[str], width: int) -> DataFrame:
    """Overlapping and touching spans of a key as one.

    A span that begins after all ends before it starts an island; it also ends the island before, at the largest end so far.
    """
    reach = scans.running(spans.select(*keys, lo, hi), keys, lo, width, [lo, hi], {"_reach": (F.col(hi), "max")})
    starts = reach.where(F.col("_reach").isNull() | (F.col(lo) > F.col("_reach"))).select(*keys, lo, "_reach")
    closed = scans.running(starts, keys, lo, width, [lo], {"_lo": (F.col(lo), "last")}).where(F.col("_lo").isNotNull())
    ends = spans.select(*keys, F.lit(None).cast(spans.schema[lo].dataType).alias(lo), hi).unionByName(starts.select(*keys, lo, F.lit(None).cast(spans.schema[hi].dataType).alias(hi)))
    last = ends.groupBy(*keys).agg(F.max(lo).alias(lo), F.max(hi).alias(hi))  # of each key
    return closed.select(*keys, F.col("_lo").alias(lo), F.col("_reach").alias(hi)).unionByName(last)


def subtracted(spans: DataFrame, vetoes: DataFrame, lo: str, hi: str, keys: list[str], width: int) -> DataFrame:
    """What is left of spans without the vetoes of their key, both merged first: stretches between edges at which one of them begins or ends."""

    def edges(df: DataFrame, s: int, v: int) -> DataFrame:
        ends = [F.struct(F.col(c).alias("t"), F.lit(way * s).alias("s"), F.lit(way * v).alias("v")) for c, way in ((lo, 1), (hi, -1))]
        return cut(merged(df, lo, hi, keys, width)).select(*keys, F.inline(F.array(*ends)))

    at = edges(spans, 1, 0).unionByName(edges(vetoes, 0, 1)).groupBy(*keys, "t").agg(F.sum("s").alias("s"), F.sum("v").alias("v")).where("s <> 0 or v <> 0")
    # what holds from the edge before up to this one
    pieces = scans.running(at, keys, "t", width, ["t"], {"_t": (F.col("t"), "last"), "_s": (F.col("s"), "sum"), "_v": (F.col("v"), "sum")})
    return pieces.where("_s > 0 and _v = 0 and _t < t").select(*keys, F.col("_t").alias(lo), F.col("t").alias(hi))


def runs(df: DataFrame, block: str, keys: list[str], width: int) -> DataFrame:
    """Runs of consecutive block numbers, `width` of them in a file: first, last and length. A block is a span that touches the next."""
    spans = df.select(*keys, F.col(block).alias("first"), (F.col(block) + 1).alias("last")).distinct()
    return merged(spans, "first", "last", keys, width).withColumns({"last": F.col("last") - 1, "n": F.col("last") - F.col("first")})


def numbered(df: DataFrame, by: str, digits: int = 3) -> DataFrame:
    """df with place, the rows' number from 0 in the order of a column of hex digits spread evenly (a hash), and n, the number of all.

    Rows are numbered within the first digits and shifted by the counts before (16 ** digits rows), so no task sees all.
    """
    head = F.substring(by, 1, digits)
    counts = df.groupBy(head.alias("_head")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    shifts = counts.select("_head", before.alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("n"))
    own = df.withColumn("_head", head).withColumn("_in", F.row_number().over(Window.partitionBy("_head").orderBy(by)) - 1)
    return own.join(F.broadcast(shifts), "_head").withColumn("place", F.col("_before") + F.col("_in")).drop("_head", "_in", "_before")
