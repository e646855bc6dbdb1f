"""Named queries over a folder of tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import Tables, check_sql


class Query(NamedTuple):
    build: Callable[[Tables], DataFrame]
    check: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, check: str | None = None):
    """Register a builder ``Tables -> DataFrame`` and its checking SQL."""
    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(build, check)
        return build
    return register


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES[name].build(Tables(spark, folder))


def checks() -> dict[str, str]:
    return {name: check_sql(q.check) for name, q in QUERIES.items() if q.check is not None}


DIGITS = 9


def rounded(df: DataFrame, *columns: str, digits: int = DIGITS) -> DataFrame:
    """Round results of float sums, whose last bits depend on the order of adding."""
    return df.withColumns({c: F.round(c, digits) for c in columns})
