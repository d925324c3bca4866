"""Laying out blocks of a stretch under a quota, as a table function over partitions in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import SkipRestOfInputTableException, udtf


@udtf(returnType="block bigint, role int, done bigint")
class QuotaLayout:
    """TABLE(...) PARTITION BY a stretch ORDER BY block, and a quota: (block, role, done) until the quota is met.

    The first block of consecutive ones is a source of the spectrum (role 0), those after it are data (role 1); done counts the
    data blocks before. A partition whose quota is met reads no more of its rows.
    """

    def __init__(self):
        self.done, self.before = 0, None

    def eval(self, row, quota):
        if self.done >= quota:
            raise SkipRestOfInputTableException("quota met")
        role = int(self.before is not None and row["block"] == self.before + 1)
        yield row["block"], role, self.done
        self.before, self.done = row["block"], self.done + role


def laid_out(blocks: DataFrame, stretch: str, quota: int) -> DataFrame:
    """(stretch, block, role, done) of different blocks (stretch, block)."""

    @udtf(returnType=f"`{stretch}` {blocks.schema[stretch].dataType.simpleString()}, block bigint, role int, done bigint")
    class WithStretch(QuotaLayout.func):
        def eval(self, row, quota):
            for found in super().eval(row, quota):
                yield row[stretch], *found

    return WithStretch(blocks.select(stretch, "block").asTable().partitionBy(stretch).orderBy("block"), F.lit(quota))
