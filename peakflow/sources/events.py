"""Raw order events: JSON lines in, typed events out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakflow.functions.times import parse_event_time
from peakflow.schemas import ORDER_EVENT

CORRUPT = "_corrupt_record"


def with_event_ts(events: DataFrame) -> DataFrame:
    return events.withColumn("event_ts", parse_event_time(F.col("event_time")))


def read_events(spark: SparkSession, path: str, keep_corrupt: bool = False) -> DataFrame:
    """All records, good and bad; a line that is no JSON becomes a row of NULLs.

    With `keep_corrupt` the text of such a line is kept for the quarantine.
    """
    schema = ORDER_EVENT
    if keep_corrupt:
        schema = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    return with_event_ts(spark.read.schema(schema).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT))


def with_keys(events: DataFrame) -> DataFrame:
    """Only events that can be placed: both ids and a readable time."""
    return events.dropna(subset=["event_id", "order_id", "event_ts"])


def read_strict_events(spark: SparkSession, path: str) -> DataFrame:
    return with_keys(read_events(spark, path))


def stamped(events: DataFrame, run_ts=None) -> DataFrame:
    """Add `updated_at`: the given time of the run, else the current one."""
    return events.withColumn("updated_at", run_time(run_ts))


def run_time(run_ts=None):
    return F.current_timestamp() if run_ts is None else F.lit(run_ts).cast("timestamp")


def first_events(events: DataFrame, n: int, order: Sequence[str] = ("event_time", "event_id")) -> DataFrame:
    """The `n` earliest events; 0 means all. Every task hands on `n` rows at most."""
    return events.orderBy(*order).limit(n) if n else events


def head_and_tail(events: DataFrame, n: int, order: Sequence[str] = ("event_time", "event_id")) -> DataFrame:
    """The `n` earliest and the `n` latest events; a short table shows up twice, as in a list slice."""
    head = events.orderBy(*order).limit(n).withColumn("part", F.lit("head"))
    tail = events.orderBy(*[F.desc(c) for c in order]).limit(n).withColumn("part", F.lit("tail"))
    return head.unionByName(tail)
