"""Measured logs kept as CSV: read latency and publish progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakflow.schemas import PUBLISH_PROGRESS, READ_LATENCY


def read_latency_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows whose two latencies are numbers; the others are skipped. Another header is an error."""
    log = spark.read.csv(path, schema=READ_LATENCY, header=True, enforceSchema=False)
    numbers = {c: F.col(c).try_cast("double") for c in ("publish_to_read_latency_ms", "arrival_latency_ms")}
    return log.withColumns(numbers).dropna(subset=list(numbers))


def read_progress_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=PUBLISH_PROGRESS, header=True)
