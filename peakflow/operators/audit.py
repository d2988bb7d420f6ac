"""Checks on results: row counts per view and load per stream key."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from peakflow.session import materialise

SKETCH_COUNTERS = 64


class RowCounts:
    """Rows of views, counted while something else reads them through; no scan is made for the count."""

    def __init__(self):
        self.seen: dict[str, Observation] = {}

    def of(self, df: DataFrame, name: str) -> DataFrame:
        """`df`, whose rows the first action on what becomes of it counts."""
        self.seen[name] = Observation(name)
        return df.observe(self.seen[name], F.count("*").alias("rows"))

    def read(self, spark: SparkSession) -> DataFrame:
        rows = [(name, seen.get["rows"]) for name, seen in self.seen.items()]
        return spark.createDataFrame(rows, "view string, rows long")


def key_load(records: DataFrame, key: str = "store_id") -> DataFrame:
    """Records per stream key, their share of all, and how far the key lies above the mean key.

    The counts are stored: the totals come from them, so the records are read once.
    """
    per_key = records.groupBy(F.col(key).alias("partition_key")).agg(F.count("*").alias("records"))
    per_key = materialise(per_key, "keys")
    whole = per_key.agg(F.struct(F.sum("records").alias("all"), F.avg("records").alias("mean"))).scalar()
    return per_key.withColumns(
        {"share": F.col("records") / whole["all"], "skew": F.col("records") / whole["mean"]}
    )


def key_sketches(records: DataFrame, groups: Sequence[str], key: str = "store_id", counters: int = SKETCH_COUNTERS) -> DataFrame:
    """A sketch of the heavy keys and the number of records for each group; both can be merged over groups."""
    known = records.where(F.col(key).isNotNull())
    sketch = F.expr(f"approx_top_k_accumulate({key}, {counters})").alias("sketch")
    return known.groupBy(*groups).agg(sketch, F.count("*").alias("records"))


def sketch_error(records: Column, counters: int = SKETCH_COUNTERS) -> Column:
    """By how much an estimate may be off: 3.5 times the records over the size of the sketch's table.

    The table is the next power of two that is at most three quarters full with all counters.
    """
    return F.ceil(records * F.lit(3.5 / (1 << (math.ceil(counters / 0.75) - 1).bit_length())))


def heavy_keys(sketches: DataFrame, share: float, counters: int = SKETCH_COUNTERS) -> DataFrame:
    """partition_key, estimate, error and all_records of every key that may hold `share` of the records.

    No key with that share is missing, as its estimate is off by the error at most. There are as many
    rows as counters at most. Sketches of days, files or batches are merged here.
    """
    merged = sketches.groupBy(F.lit(0).alias("all")).agg(  # grouped, so that no sketch gives no row
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {counters}), {counters})").alias("top"),
        F.sum("records").alias("all_records"),
    )
    keys = merged.withColumn("error", sketch_error(F.col("all_records"), counters)).select("*", F.inline("top"))
    return keys.where(F.col("count") + F.col("error") >= F.col("all_records") * share).select(
        F.col("item").alias("partition_key"), F.col("count").alias("estimate"), "error", "all_records"
    )


def hot_key_plan(records: DataFrame, heavy: DataFrame, shards: int, key: str = "store_id") -> DataFrame:
    """Exact records of the heavy keys beside their estimates, and over how many salts each is spread.

    A key gets a salt for each `1 / shards` of all records, so that no salted key has more than an even
    shard. Only the records of the heavy keys are counted. `heavy` comes from `heavy_keys`.
    """
    heavy = materialise(heavy, "heavy-keys")
    exact = records.join(F.broadcast(heavy), F.col(key) == F.col("partition_key"))  # as many as counters at most
    counted = exact.groupBy("partition_key", "estimate", "error", "all_records").agg(F.count("*").alias("records"))
    salts = F.ceil(F.col("records") * shards / F.col("all_records")).cast("int")
    return counted.withColumn("salts", salts)


def salted(records: DataFrame, plan: DataFrame, spread: Column, key: str = "store_id") -> DataFrame:
    """Records with `shard_key`: a heavy key with the salt that `spread`, a whole number of each record, gives."""
    keys = F.broadcast(plan.select(F.col("partition_key").alias("_heavy"), "salts"))
    salt = F.concat_ws("#", F.col(key), F.pmod(spread, F.col("salts")))
    rows = records.join(keys, F.col(key) == F.col("_heavy"), "left")
    return rows.withColumn("shard_key", F.when(F.col("salts") > 1, salt).otherwise(F.col(key))).drop("_heavy", "salts")
