"""File streams. On a broker the same pipelines take its source instead."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakflow.schemas import ORDER_EVENT
from peakflow.sources.events import with_event_ts

_FILE = "_metadata.file_path"


def parquet_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    files_per_batch: int | None = None,
    since: datetime.datetime | None = None,
) -> DataFrame:
    """Files as they land, the oldest first, `files_per_batch` in a batch.

    Reading starts at the earliest file. With `since`, files that landed before that time are passed
    over; a stream that is to start at the latest takes the current time, and keeps it when it goes
    on. `path` is a folder of files or a pattern; a single file has to be given as a pattern.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.parquet(path)
    return rows.where(F.col("_metadata.file_modification_time") >= F.lit(since)) if since else rows


def latest_stream(
    spark: SparkSession, path: str, schema: T.StructType, position: str, files_per_batch: int | None = None
) -> DataFrame:
    """Files that landed after this stream was first started.

    The first start writes down at `position`, a folder beside the checkpoint, which files the source
    holds; every start reads past those, so a restart goes on from the same place, whatever the clocks
    of the writers say.
    """
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{position}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        held = spark.read.schema(schema).parquet(path).select(F.col(_FILE).alias("held")).distinct()
        held.write.mode("overwrite").parquet(position)
    held = spark.read.schema("held string").parquet(position)
    rows = parquet_stream(spark, path, schema, files_per_batch).withColumn("_file", F.col(_FILE))
    return rows.join(held, F.col("_file") == F.col("held"), "left_anti").drop("_file")


def json_event_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(ORDER_EVENT)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return with_event_ts(reader.json(path))
