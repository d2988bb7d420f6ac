"""Mixing sources to target weights by weighted fair queueing.

Each copy of a document gets the virtual time at which a fair queue would have sent it: the words of
its source up to and including it, divided by the source's target. Sorting all copies by that time
and cutting the list at the total budget gives every source its share.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakflow.llm.arrow_text import blocks, utf8, words
from peakflow.operators.ordering import join_facts, sorted_slices, with_row_number
from peakflow.session import materialise


KEY = ("source", "doc_id", "text_key")  # rows that agree in it are copies, and told apart by a number
_ROW = ("doc_id", "text_key", "row_no")


def _text_key() -> Column:
    return F.xxhash64("text").alias("text_key")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        _, _, first = words(*utf8(batch.column("text")))
        names = ["doc_id", "source", "text_key"]
        sizes = pa.array(np.diff(first).astype(np.int64))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), sizes], [*names, "size"])


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, a hash of the text and the size in words of each row."""
    rows = docs.select("doc_id", "source", "text", _text_key())
    return rows.mapInArrow(_count_words, "doc_id long, source string, text_key long, size long")


def _running_total(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Total of `value` up to each row of its group; the cluster sorts, windows see slices only."""
    placed = sorted_slices(df, [*group, *order], "mix-sorted")
    totals = placed.groupBy(*group, "_slice").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*group, "_slice", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_slice").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    return (
        join_facts(placed, starts, [*group, "_slice"])
        .withColumn(name, F.col("_start") + F.sum(value).over(inside))
        .drop("_pos", "_slice", "_start")
    )


def source_targets(sources: DataFrame, weights: Sequence[int], budget_share: float, most_copies: int) -> DataFrame:
    """(source, source_size) with `target`: shares by weight, none above `most_copies` times its source.

    Weights go round over the sources in the order of code points, null last. What a full source
    leaves is shared by weight among the others; full sources are found round by round, and only
    the three totals of a round reach the driver.
    """
    ranked = sources.withColumns({"_all": F.lit(0), "_last": F.col("source").isNull()})
    ranked = with_row_number(ranked, ["_all"], ["_last", "source"], "_rank")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = materialise(
        ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most_copies).alias("most")),
        "mix-sources",
    )
    total = ranked.agg(F.sum("source_size").alias("size")).first().size or 0
    budget, level, full = total * budget_share, 0.0, -1
    while True:
        is_full = F.col("most") <= F.lit(level) * F.col("weight")
        facts = ranked.agg(
            F.count_if(is_full).alias("full"),
            F.coalesce(F.sum(F.when(is_full, F.col("most"))), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~is_full, F.col("weight"))), F.lit(0)).alias("open"),
        ).first()
        if facts.full == full or not facts.open:
            break
        full, level = facts.full, (budget - facts.held) / facts.open
    target = F.least(F.col("most").cast("double"), F.lit(float(level)) * F.col("weight"))
    return materialise(ranked.select("source", "source_size", target.alias("target")), "mix-targets")


def mix_plan(
    sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), budget_share: float = 1.0, most_copies: int = 3
) -> DataFrame:
    """How many copies of each document the mix takes: source, doc_id, text_key, row_no, size, source_size, target, copies.

    `sizes` has doc_id, source, text_key and size. Every row is queued on its own: rows that share a
    doc_id, or have none, go by their text, and full repeats are numbered from 0 (`row_no`). The order
    within a source is that of a hash of doc_id and text, so a rerun takes the same documents.
    Documents without words take no part: copies 0.
    """
    items = sizes.groupBy(*KEY).agg(F.first("size").alias("size"), F.count("*").alias("rows"))
    items = items.withColumn("row_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).drop("rows")
    items = materialise(items.withColumn("_hash", F.xxhash64(F.lit(42), "doc_id", "text_key")), "mix-items")
    sources = items.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources, weights, budget_share, most_copies)
    budget = targets.agg(F.sum("source_size").alias("size")).first().size or 0
    queued = _running_total(items.where("size > 0"), ["source"], ["_hash", *_ROW], "size", "_upto")
    queued = join_facts(queued, targets, ["source"])
    copies = queued.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(most_copies - 1)))).withColumns(
        {
            "_time": (F.col("_copy") * F.col("source_size") + F.col("_upto")) / F.col("target"),
            "_last": F.col("source").isNull(),
            "_all": F.lit(0),
        }
    )
    copies = copies.select("_all", "_time", "_last", "source", "_hash", *_ROW, "_copy", "size")
    taken = _running_total(copies, ["_all"], ["_time", "_last", "source", "_hash", *_ROW, "_copy"], "size", "_sent")
    taken = taken.where(F.col("_sent") <= F.lit(budget * budget_share))
    taken = taken.groupBy("source", *_ROW).agg(F.count("*").alias("copies"))
    plan = _matched(join_facts(items, targets, ["source"]), taken, [*KEY, "row_no"], "left")
    facts = ["source_size", "target", F.coalesce("copies", F.lit(0)).alias("copies")]
    return plan.select(*KEY, "row_no", "size", *facts)


def _matched(rows: DataFrame, facts: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """`rows` with the facts of the same key, where a null matches a null."""
    facts = facts.withColumnsRenamed({c: f"_fact_{c}" for c in keys})
    same = reduce(and_, [rows[c].eqNullSafe(facts[f"_fact_{c}"]) for c in keys])
    return rows.join(facts, same, how).drop(*[f"_fact_{c}" for c in keys])


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """A row for each row of `docs`: doc_id, source, size, source_size, target, taken (words, copies counted).

    A null text has size 0; a null source is a source of its own, in the last place.
    """
    plan = mix_plan(materialise(word_counts(docs), "mix-sizes"), **options)
    return plan.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of `docs`.

    Rows that agree in source, doc_id and text are numbered over the cluster before they meet the plan.
    """
    plan = mix_plan(materialise(word_counts(docs), "mix-sizes"), **options).select(*KEY, "row_no", "copies")
    plan = materialise(plan.withColumnsRenamed({c: f"_plan_{c}" for c in (*KEY, "row_no", "copies")}), "mix-plan")
    several = plan.where("_plan_row_no > 0").select(*[F.col(f"_plan_{c}").alias(f"_several_{c}") for c in KEY]).distinct()
    several = materialise(several, "mix-repeated")
    rows = docs.withColumns({f"_own_{c}": F.col(c) for c in KEY[:2]} | {"_own_text_key": _text_key()})
    own = [f"_own_{c}" for c in KEY]
    repeats = reduce(and_, [rows[f"_own_{c}"].eqNullSafe(several[f"_several_{c}"]) for c in KEY])
    alone = rows.join(several, repeats, "left_anti").withColumn("_own_row_no", F.lit(0).cast("long"))
    copies = materialise(rows.join(several, repeats, "left_semi"), "mix-copies")
    numbered = with_row_number(copies, own, [], "_own_row_no").select(alone.columns)
    taken = plan.where("_plan_copies > 0")
    same = reduce(and_, [F.col(f"_own_{c}").eqNullSafe(F.col(f"_plan_{c}")) for c in (*KEY, "row_no")])
    out = alone.unionByName(numbered).join(taken, same)
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_plan_copies").cast("int")))).select(*docs.columns)
