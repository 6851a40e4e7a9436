"""How queries are registered, and the columns they share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklet.functions.columns import div, micros
from brooklet.session import shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: 2024-01-01 in microseconds, from which windows count.
START = 1_704_067_200_000_000
SECOND, MINUTE, HOUR, DAY = 1_000_000, 60_000_000, 3_600_000_000, 86_400_000_000


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and the SQL of the same rows."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream: event_id is the order of arrival, t the time in microseconds."""
    return table(spark, sf_dir, "events").select("event_id", micros("ts").alias("t"), "user_id", "event_type", "value", "props")


def by_arrival() -> Column:
    """Stretches of arrivals, for order-dependent operators."""
    return div("event_id", 4096)


def by_day() -> Column:
    return div("t", DAY)


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Added before rounding: averages of cents often lie exactly between two rounded values, where the order of a sum would decide.
NUDGE = 1e-9


def rounded(name: str, digits: int = 6) -> Column:
    return F.round(F.col(name) + NUDGE, digits).alias(name)
