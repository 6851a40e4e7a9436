"""The library's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brooklet.plans import common, frames, joins, rows, streams, windows  # noqa: F401
from brooklet.session import ship

FLAGSHIP = "heat_map"


def _shipped(f: common.Query) -> common.Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _shipped(f) for k, f in common.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(common.SQL)
