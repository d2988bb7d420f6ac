"""Ranks, running totals and percentiles over orders too long for one task.

A window function puts each of its partitions into one task. Here a group may be most of the
table, so the rows are sorted over the cluster (or cut into blocks by a given sequence number),
each slice is summed up, and only the short list of slices goes through a window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakflow.session import materialise

BLOCK_ROWS = 10_000
_TASK_BITS = 33  # monotonically_increasing_id keeps the task number above these bits


def join_facts(left: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of rows with the facts of their slice, on equal keys where NULL equals NULL.

    The facts are stored first: from the size of the files Spark sees that the list is short and
    sends it to the rows, where by its estimate for an aggregate it would shuffle the rows.
    """
    renamed = materialise(facts, "slices").withColumnsRenamed({k: f"_right_{k}" for k in keys})
    matches = reduce(and_, [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys])
    return left.join(renamed, matches).drop(*[f"_right_{k}" for k in keys])


def sorted_slices(df: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """Sort `df` over the cluster and store it with each row's place `_pos` and `_slice`.

    Stored, because the place depends on how the sort happened to cut the rows.
    """
    placed = df.orderBy(*order).withColumn("_pos", F.monotonically_increasing_id())
    return materialise(placed, label).withColumn("_slice", F.shiftright("_pos", _TASK_BITS))


def _before(column: str, group: Sequence[str], by: str) -> Column:
    earlier = Window.partitionBy(*group).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(earlier), F.lit(0))


def with_row_number(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "row_no") -> DataFrame:
    """Number the rows of each group from 0 in `order`.

    Rows that `order` does not tell apart, such as many copies of one event, go by their place in
    the input, so that they need not share a task. `df` should read stored data, whose places stay.
    """
    told_apart = df.withColumn("_copy", F.monotonically_increasing_id())
    placed = sorted_slices(told_apart, [*group, *order, "_copy"], "numbered")
    slices = placed.groupBy(*group, "_slice").agg(F.min("_pos").alias("_first"), F.count("*").alias("_rows"))
    starts = slices.select(*group, "_slice", "_first", _before("_rows", group, "_slice").alias("_start"))
    numbered = join_facts(placed, starts, [*group, "_slice"])
    return numbered.withColumn(name, F.col("_start") + F.col("_pos") - F.col("_first")).drop(
        "_pos", "_slice", "_first", "_start", "_copy"
    )


def with_running_sums(
    df: DataFrame, run: str, seq: str, sums: Mapping[str, str], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Running sums along `seq`, which numbers the rows of a run; `sums` maps new names to columns."""
    blocks = df.withColumn("_block", F.floor(F.col(seq) / block_rows))
    totals = blocks.groupBy(run, "_block").agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()])
    starts = totals.select(run, "_block", *[_before(f"_sum_{n}", [run], "_block").alias(f"_start_{n}") for n in sums])
    in_block = Window.partitionBy(run, "_block").orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = {n: F.col(f"_start_{n}") + F.sum(c).over(in_block) for n, c in sums.items()}
    return (
        join_facts(blocks, starts, [run, "_block"])
        .withColumns(running)
        .drop("_block", *[f"_start_{n}" for n in sums])
    )


def with_previous(
    df: DataFrame, run: str, seq: str, columns: Mapping[str, str], default: int = 0, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The value of the row before along `seq`; `columns` maps new names to columns."""
    blocks = df.withColumn("_block", F.floor(F.col(seq) / block_rows))
    lasts = blocks.groupBy(run, "_block").agg(*[F.max_by(c, seq).alias(f"_last_{n}") for n, c in columns.items()])
    in_run = Window.partitionBy(run).orderBy("_block")
    carried = lasts.select(
        run, "_block", *[F.lag(f"_last_{n}", 1, default).over(in_run).alias(f"_carry_{n}") for n in columns]
    )
    in_block = Window.partitionBy(run, "_block").orderBy(seq)
    opens = F.row_number().over(in_block) == 1
    previous = {
        n: F.when(opens, F.col(f"_carry_{n}")).otherwise(F.lag(c).over(in_block)) for n, c in columns.items()
    }
    return (
        join_facts(blocks, carried, [run, "_block"])
        .withColumns(previous)
        .drop("_block", *[f"_carry_{n}" for n in columns])
    )


def percentiles(
    placed: DataFrame, group: Sequence[str], value: str, weight: str, points: Mapping[str, int]
) -> DataFrame:
    """Exact percentiles, interpolated between neighbours, from how often each value occurs.

    `placed` holds values with their counts in the order of `sorted_slices(counts, [*group, value])`;
    `points` maps names to percents. Only the slices that hold a wanted rank are looked through.
    """
    slices = placed.groupBy(*group, "_slice").agg(F.sum(weight).alias("_rows"))
    total = F.sum("_rows").over(Window.partitionBy(*group))
    slices = slices.withColumns({"_start": _before("_rows", group, "_slice"), "_total": total})

    # Rank of the percentile, its two neighbours, and how far it lies towards the upper one.
    def wanted(name: str, percent: int) -> list[Column]:
        rank = (F.col("_total") - 1) * F.lit(percent) / F.lit(100.0)
        share = rank - F.floor(rank)
        return [
            F.struct(F.lit(name).alias("name"), (F.lit(1.0) - share).alias("share"), F.floor(rank).alias("rank")),
            F.struct(F.lit(name).alias("name"), share.alias("share"), F.ceil(rank).alias("rank")),
        ]

    asked = F.array(*[w for n, p in points.items() for w in wanted(n, p)])
    here = F.filter(asked, lambda w: (w["rank"] >= F.col("_start")) & (w["rank"] < F.col("_start") + F.col("_rows")))
    targets = slices.select(*group, "_slice", "_start", here.alias("_asked")).where(F.size("_asked") > 0)

    upto = F.sum(weight).over(Window.partitionBy(*group, "_slice").orderBy("_pos"))
    ranked = join_facts(placed, targets, [*group, "_slice"]).withColumn("_end", F.col("_start") + upto)
    held = F.filter(
        "_asked", lambda w: (w["rank"] < F.col("_end")) & (w["rank"] >= F.col("_end") - F.col(weight))
    )
    parts = ranked.select(*group, value, F.explode(held).alias("_w"))
    return parts.groupBy(*group).agg(
        *[F.sum(F.when(F.col("_w.name") == n, F.col(value) * F.col("_w.share"))).alias(n) for n in points]
    )
