"""Exact deduplication by most-significant-digit radix partitioning of the texts.

Every round splits each open group of documents by its next run of bytes. A group of one is done; so
is a group whose texts have ended, and those are equal: no digest decides. The runs grow eightfold,
so a text of n bytes takes log n rounds, and only groups of two or more carry their texts on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakflow.llm.arrow_text import blocks
from peakflow.session import materialise

FIRST_RUN = 64
GROWTH = 8
LONGEST_RUN = 1 << 30  # substring counts in ints


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        texts = pc.ascii_lower(pc.fill_null(batch.column("text"), "")).cast(pa.binary())
        digests = [hashlib.sha256(t.as_buffer()).hexdigest() for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(digests, pa.string()), texts], ["doc_id", "text_sha256", "rest"]
        )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """A row for each row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after lower-casing A-Z; null counts as empty. The row with the
    largest doc_id stays. Rows that repeat a doc_id and its text count in group_size and share the
    value of `kept`. A null doc_id never stays beside a known one; in a group of nulls alone
    keep_id is null and `kept` false. Other columns are ignored.
    """
    open_rows = docs.select("doc_id", "text").mapInArrow(_normalised, "doc_id long, text_sha256 string, rest binary")
    open_rows = open_rows.withColumn("part", F.lit(0).cast("long"))
    done, run = [], FIRST_RUN
    while True:
        head, ended = F.substring("rest", 1, run), F.length("rest") <= run
        groups = (
            open_rows.groupBy("part", head.alias("head"), ended.alias("ended"))
            .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
            .where("group_size > 1")
            .withColumn("next", F.monotonically_increasing_id())
        )
        groups = materialise(groups, "radix-groups").withColumnRenamed("part", "_part")
        same = (F.col("part") == F.col("_part")) & (head == F.col("head")) & (ended == F.col("ended"))
        rest = F.when(~F.col("ended"), F.expr(f"substring(rest, {run + 1})"))
        # By sorting at every size: the groups grow with the input, so they are not sent to the rows whole.
        split = open_rows.join(groups.hint("merge"), same, "left").select(
            "doc_id", "text_sha256", "keep_id", "group_size", F.col("next").alias("part"), rest.alias("rest")
        )
        split = materialise(split, "radix-rows")
        done.append(split.where("rest is null").drop("part", "rest"))
        if groups.where("not ended").isEmpty():
            break
        open_rows = split.where("rest is not null").drop("keep_id", "group_size")
        run = min(run * GROWTH, LONGEST_RUN)
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return reduce(DataFrame.unionAll, done).select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id") == keep, alone).alias("kept"),
        "text_sha256",
    )
