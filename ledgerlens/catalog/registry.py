"""Where queries and their SQL statements are registered."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    name: str
    covers: tuple[str, ...]
    run: Query
    sql: str | None



def single(value: Column) -> Column:
    """A figure at single precision: decimal rounding of means of cents would sit on ties and follow summation order."""
    return value.cast("float").cast("double")


QUERIES: dict[str, Registered] = {}


def query(covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name. ``covers`` lists survey IDs; ``sql`` is the independent statement."""

    def register(run: Query) -> Query:
        if run.__name__ in QUERIES:
            raise ValueError(f"query {run.__name__} is registered twice")
        QUERIES[run.__name__] = Registered(run.__name__, tuple(covers.split()), run, sql.strip() if sql else None)
        return run

    return register
