"""The registry of queries over the driver's tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None):
    """Registers a function under its name."""

    def put(f: Query) -> Query:
        _found[f.__name__] = (f, sql)
        return f

    return put


def _load() -> None:
    from tidewave.plans import checks, crops, dataset, detection, flows, signals, spans, spectra  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return {k: f for k, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: sql for k, (_, sql) in _found.items() if sql}
