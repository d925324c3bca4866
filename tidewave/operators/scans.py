"""Ordered scans by time file: running values and greedy choices of a key whose rows many tasks share.

A key's rows are cut into time files of a given width. Each file gives a summary (one small row), the summaries of a key are
scanned in order, and what comes out before a file is carried into it; then every file is worked on by itself. So the
largest unit of work is a file, whatever share of all rows a key has; a key costs one row for each of its files.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILE = "_file"


def _combined(how: str, value: Column) -> Column:
    return {"sum": F.sum, "max": F.max, "min": F.min}[how](value) if how != "last" else F.last(value, ignorenulls=True)


def running(df: DataFrame, keys: list[str], at: str, width: float, order: list[str], values: Mapping[str, tuple[Column, str]], inclusive: bool = False) -> DataFrame:
    """df with running values by key in the order of `order` (which begins with `at`): each is (value, sum | max | min | last).

    Only rows before count, or the row itself too if `inclusive`. Nulls are passed over: `last` is the last value that
    is not null; a sum of nothing is 0, the others are null. Rows without a time come first.

    The summaries are a pass of their own over the columns that they need, summed before they are shuffled; rows are
    shuffled once, by key and file, which later scans of the same files use too.
    """
    file = F.struct(*keys, F.floor(F.col(at) / width).alias("at"))  # equal structs may hold nulls, so null keys are a key
    own = df.withColumns({f"_{name}": value for name, (value, _) in values.items()} | {FILE: file})
    place = F.struct(*order)

    def whole(name: str, how: str) -> Column:
        if how != "last":
            return _combined(how, F.col(f"_{name}"))
        return F.max(F.when(F.col(f"_{name}").isNotNull(), F.struct(place.alias("p"), F.col(f"_{name}").alias("v"))))["v"]

    files = own.groupBy(FILE).agg(*(whole(name, how).alias(f"_{name}") for name, (_, how) in values.items()))
    before = Window.partitionBy(*(F.col(FILE)[k] for k in keys)).orderBy(F.col(FILE)["at"]).rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    carry = files.select(FILE, *(_combined(how, F.col(f"_{name}")).over(before).alias(f"_before_{name}") for name, (_, how) in values.items()))
    within = Window.partitionBy(FILE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)

    def value(name: str, how: str) -> Column:
        carried, inside = F.col(f"_before_{name}"), _combined(how, F.col(f"_{name}")).over(within)
        if how == "sum":
            return F.coalesce(carried, F.lit(0)) + F.coalesce(inside, F.lit(0))
        return F.coalesce(inside, carried) if how == "last" else (F.greatest if how == "max" else F.least)(inside, carried)

    met = own.join(carry, FILE).withColumns({name: value(name, how) for name, (_, how) in values.items()})
    return met.drop(FILE, *(f"_{name}" for name in values), *(f"_before_{name}" for name in values))


def placed(df: DataFrame, keys: list[str], at: str, width: float, order: list[str]) -> DataFrame:
    """df with place, a row's number from 0 in its key in that order, and n, the key's rows."""
    numbered = running(df, keys, at, width, order, {"place": (F.lit(1), "sum")})
    n = df.groupBy(*keys).agg(F.count("*").alias("n")).select(F.struct(*keys).alias("_key"), "n")  # structs, as keys may be null
    return numbered.withColumn("_key", F.struct(*keys)).join(n, "_key").drop("_key")


# The greedy rule: a row is kept if it is far enough from the last one kept.


def _after(t: np.ndarray, least: int) -> np.ndarray:
    """For each time the place of the first that may be kept after it."""
    return np.searchsorted(t, t + least)


def exits(t: np.ndarray, least: int, start: int) -> tuple[list[int], list[int]]:
    """What a file does to the last kept time, as steps (until, leaves): an entry state s with s + least <= until[k], and no smaller k, leaves leaves[k].

    t: the file's times, ascending; start: where the file begins, so entry states are below it. Beyond the last step the state
    stays. Choices that begin later end no earlier, so there are as many steps as ways that have not met by the file's end.
    """
    follow = _after(t, least)
    last = np.arange(len(t))
    ahead = np.where(follow < len(t), follow, last)
    while (ahead != last).any():  # each round doubles how far a choice is followed
        last = ahead
        ahead = ahead[ahead]
    first = min(len(t), int(np.searchsorted(t, start + least)) + 1)  # no entry state makes a later time the first kept one
    ends = last[:first]
    turn = np.flatnonzero(np.append(ends[1:] != ends[:-1], True))
    return t[turn].tolist(), t[ends[turn]].tolist()


def chosen(t: np.ndarray, least: int, entry: int | None) -> np.ndarray:
    """The times that the greedy rule keeps, given the last kept one before."""
    follow = _after(t, least).tolist()
    k = 0 if entry is None else int(np.searchsorted(t, entry + least))
    kept = []
    while k < len(t):
        kept.append(k)
        k = follow[k]
    return t[kept]


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column of numbers; a null is an empty one."""
    column = column.fill_null([]) if column.null_count else column
    values, at = column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(pc.list_value_length(column).to_numpy()))
    return [values[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def spaced(df: DataFrame, at: str, least: int, keys: list[str], width: int) -> DataFrame:
    """The times (whole numbers) kept by the greedy rule, at least `least` after the last one kept, in each key; null times are left out."""
    times = df.select(*keys, F.col(at).cast("long").alias("_t")).where("_t is not null").withColumn(FILE, F.floor(F.col("_t") / width))
    files = times.groupBy(*keys, FILE).agg(F.sort_array(F.collect_set("_t")).alias("_t"))
    typed = [f"`{k}` {times.schema[k].dataType.simpleString()}" for k in keys]
    longs = pa.list_(pa.int64())

    def summary(batches):
        for b in batches:
            steps = [exits(t, least, f * width) for t, f in zip(_lists(b.column("_t")), b.column(FILE).to_pylist(), strict=True)]
            until, leaves = (pa.array([s[k] for s in steps], longs) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), b.column(FILE), until, leaves], names=[*keys, FILE, "until", "leaves"])

    def scan(batches):
        for b in batches:
            entries = []
            for own in b.column("_files").to_pylist():
                state, entry = None, []
                for f in own:
                    entry.append({FILE: f[FILE], "_entry": state})
                    k = 0 if state is None else bisect_left(f["until"], state + least)
                    state = f["leaves"][k] if k < len(f["leaves"]) else state
                entries.append(entry)
            kind = pa.list_(pa.struct([(FILE, pa.int64()), ("_entry", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(entries, kind)], names=[*keys, "_entries"])

    def choose(batches):
        for b in batches:
            kept = [chosen(t, least, e) for t, e in zip(_lists(b.column("_t")), b.column("_entry").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(kept, longs)], names=[*keys, "_kept"])

    steps = files.mapInArrow(summary, ", ".join([*typed, f"{FILE} long, until array<long>, leaves array<long>"]))
    ordered = steps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(FILE, "until", "leaves"))).alias("_files"))  # a few numbers for each file
    carry = ordered.mapInArrow(scan, ", ".join([*typed, f"_entries array<struct<{FILE}: bigint, _entry: bigint>>"])).select(*keys, F.inline("_entries"))
    both = times.withColumn("_entry", F.lit(None).cast("long")).unionByName(carry, allowMissingColumns=True)
    entered = both.groupBy(*keys, FILE).agg(F.sort_array(F.collect_set("_t")).alias("_t"), F.max("_entry").alias("_entry"))
    return entered.mapInArrow(choose, ", ".join([*typed, "_kept array<long>"])).select(*keys, F.explode("_kept").alias(at))
