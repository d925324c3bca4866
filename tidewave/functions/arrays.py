"""Array columns as vectors, in built-in higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(x: str) -> Column:
    return F.transform(x, lambda e: e.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, e: s + e)


def saturated(a: Column, limit: float) -> Column:
    return F.transform(a, lambda e: F.greatest(F.least(e, F.lit(limit)), F.lit(-limit)))


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often `then` or a function within it uses it."""
    return F.transform(F.array(value), then)[0]


def deviation(a: Column) -> Column:
    """Population standard deviation, in two passes."""
    squares = lambda x, mean: F.aggregate(x, F.lit(0.0), lambda s, e: s + (e - mean) * (e - mean))
    return bound(a, lambda x: bound(total(x) / F.size(x), lambda mean: F.sqrt(squares(x, mean) / F.size(x))))


def argmax(a: Column) -> Column:
    """The place of the first largest element, from 0."""
    return F.array_position(a, F.array_max(a)) - 1


def placed(h: Column, n: int, peak: Column | int) -> Column:
    """h in a window of n samples with its first largest sample in size at place `peak`, padded with zeros, what lies outside being cut."""
    shift = F.lit(peak) - argmax(F.transform(h, F.abs)) if not isinstance(peak, Column) else peak - argmax(F.transform(h, F.abs))
    padded = F.concat(F.array_repeat(F.lit(0.0), F.greatest(shift, F.lit(0)).cast("int")), F.slice(h, F.greatest(F.lit(1), 1 - shift).cast("int"), F.size(h)), F.array_repeat(F.lit(0.0), n))
    return F.slice(padded, 1, n)


def energy(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, e: s + e * e)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, e: s + e)
