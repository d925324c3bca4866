"""The normal distribution in column functions, and numbers drawn from a row's key."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewave.functions.arrays import bound


def density(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def normal_cdf(x: Column) -> Column:
    """The share of a normal distribution below x: its series about 0, within 1e-12 for |x| up to 8; beyond that 0 or 1; null of null."""

    def of(x: Column) -> Column:
        start = F.struct(x.alias("t"), x.alias("s"))
        step = lambda a, k: F.struct((a["t"] * x * x / (2 * k + 1)).alias("t"), (a["s"] + a["t"] * x * x / (2 * k + 1)).alias("s"))
        inside = 0.5 + density(x) * F.aggregate(F.sequence(F.lit(1), F.lit(120)), start, step, lambda a: a["s"])
        return F.when(x >= 8, 1.0).when(x <= -8, 0.0).otherwise(F.greatest(F.least(inside, F.lit(1.0)), F.lit(0.0)))

    near = lambda x: bound(F.greatest(F.least(x, F.lit(8.0)), F.lit(-8.0)), of)
    return bound(x, lambda x: F.when(x.isNotNull(), near(x)))  # x may be costly, and the series uses it at every term


def normal_quantile(p: Column) -> Column:
    """The x with the share p below it, by Newton's method from 0; null unless 0 < p < 1."""
    step = lambda x, _: x - (normal_cdf(x) - p) / density(x)
    return F.when((p > 0) & (p < 1), F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.lit(0.0), step))


def ceiling(rho: Column, fap: Column) -> Column:
    """The best share of signals of optimal SNR rho that a detector finds at a false-alarm probability."""
    return normal_cdf(rho - normal_quantile(1 - fap))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def drawn(key: Column, name: str) -> Column:
    """A number from 0 to below 1, a function of the key and the name of what is drawn."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", key.cast("string"), F.lit(name)).cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32


def first_part(text: Column, by: str = "-") -> Column:
    """What stands before the first separator."""
    return F.split_part(text, F.lit(by), F.lit(1))
