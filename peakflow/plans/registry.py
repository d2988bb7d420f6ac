"""Named queries over the star-schema tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakflow.session import use_utc

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name. Hours and days are UTC, result times carry no zone."""

    def register(run: Query) -> Query:
        @wraps(run)
        def in_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
            return without_zone(run(use_utc(spark), sf_dir))

        QUERIES[run.__name__] = in_utc
        if sql:
            TWINS[run.__name__] = sql
        return in_utc

    return register


def without_zone(df: DataFrame) -> DataFrame:
    zoned = [c for c, kind in df.dtypes if kind == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned}) if zoned else df


def two_digits(x: str) -> str:
    """SQL for rounding to two digits by the decimal value, half up."""
    return f"CAST(round(CAST({x} AS DECIMAL(18,9)), 2) AS DOUBLE)"
