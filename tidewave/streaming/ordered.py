"""Ordered rules over streams: greedy spacing and gap clusters with keyed state, in event-time order whatever the order of arrival.

Times wait in the state of their key until the watermark has passed them, then take their turn in order. What comes after the
watermark has passed its time is late and dropped: its turn is over. Times that are equal count once, with the larger value. So the
rows are those of the batch operators over all times that were not late, and a query that is started again from its
checkpoint goes on with the last kept time. Timers wake a key when its next time is due.

State in these processors needs the RocksDB state store: `spark.conf.set(*STATE_STORE)`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """Keeps a key's times (microseconds) with their values until they are due; take() has them in order."""

    def __init__(self, keys: list[str], columns: list[str]):
        self.keys, self.columns = keys, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "us array<bigint>, value array<double>")

    def _waiting(self) -> dict[int, float]:
        return dict(zip(*self.pending.get(), strict=True)) if self.pending.exists() else {}

    def _keep(self, waiting: dict[int, float]) -> None:
        """Keeps what waits, with a timer for its first time."""
        if waiting:
            self.pending.update((list(waiting), list(waiting.values())))
            self.handle.registerTimer(min(waiting) // 1000 + 1)
        else:
            self.pending.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting = self._waiting()
        for part in rows:
            for us, value in zip(part["us"].tolist(), part["value"].tolist(), strict=True):
                waiting[us] = max(value, waiting.get(us, value))
        self._keep(waiting)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = 1000 * timerValues.getCurrentWatermarkInMs()
        waiting = self._waiting()
        due = sorted(x for x in waiting.items() if x[0] < passed)
        if due:
            self._keep({us: value for us, value in waiting.items() if us >= passed})
        out = self.take(due, passed)
        if out:
            yield pd.DataFrame([(*key, *r) for r in out], columns=[*self.keys, *self.columns])

    def take(self, due: list[tuple[int, float]], passed: int) -> list[tuple]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Spacing(InOrder):
    def __init__(self, keys: list[str], least: int):
        super().__init__(keys, ["us"])
        self.least = least

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "us long")

    def take(self, due, passed):
        last = self.last.get()[0] if self.last.exists() else None
        kept = []
        for us, _ in due:
            if last is None or us - last >= self.least:
                kept.append((us,))
                last = us
        if kept:
            self.last.update((last,))
        return kept


class Clusters(InOrder):
    """A cluster is given out when the watermark has passed its last time by more than the gap."""

    def __init__(self, keys: list[str], gap: int):
        super().__init__(keys, ["first", "last", "n", "us", "value"])
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", "first long, last long, n long, us long, value double")

    def take(self, due, passed):
        now = self.open.get() if self.open.exists() else None
        out = []
        for us, value in due:
            if now is not None and us - now[1] > self.gap:
                out.append(tuple(now))
                now = None
            if now is None:
                now = (us, us, 1, us, value)
            else:
                first, _, n, at, best = now
                now = (first, us, n + 1, *((us, value) if value > best else (at, best)))
        if now is not None and passed > now[1] + self.gap + 1:
            out.append(tuple(now))
            now = None
        if now is None:
            self.open.clear()
        else:
            self.open.update(tuple(now))
            self.handle.registerTimer((now[1] + self.gap) // 1000 + 2)
        return out


def _grouped(triggers: DataFrame, at: str, value, keys: list[str], late: str):
    own = triggers.where(F.col(at).isNotNull()).withWatermark(at, late)
    return own.select(*keys, at, F.unix_micros(at).alias("us"), value.cast("double").alias("value")).groupBy(*keys)


def _typed(triggers: DataFrame, keys: list[str], more: str) -> str:
    return ", ".join([*(f"`{k}` {triggers.schema[k].dataType.simpleString()}" for k in keys), more])


def spaced(triggers: DataFrame, at: str, least: int, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """(*keys, us) of a stream with a timestamp: the times kept by the greedy rule, `least` microseconds apart, once they are final."""
    grouped = _grouped(triggers, at, F.lit(0), keys, late)
    return grouped.transformWithStateInPandas(Spacing(keys, least), _typed(triggers, keys, "us long"), "Append", "EventTime")


def gap_clusters(triggers: DataFrame, at: str, value: str, gap: int, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """(*keys, first, last, n, us, value) of each cluster of a stream that is over: its times, how many, and its row of the largest value (the earliest of equal ones)."""
    grouped = _grouped(triggers, at, F.col(value), keys, late)
    return grouped.transformWithStateInPandas(Clusters(keys, gap), _typed(triggers, keys, "first long, last long, n long, us long, value double"), "Append", "EventTime")
