"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakflow.session import materialise


def components(links: DataFrame) -> DataFrame:
    """Rows (id, component) for every id in `links` (a, b); component is the smallest id reachable.

    Each round gives a node the smallest label among its own and its neighbours', then the label of
    that label, so that a chain shortens by half. Labels are summed up on the map side, so a node
    with many links is no hot key; nothing is collected but whether a label has changed.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialise(both.where("a <> b").distinct(), "links")
    labels = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(near, "a").select("a", F.least("label", "near").alias("step"), "label")
        jump = labels.select(F.col("a").alias("step"), F.col("label").alias("jump"))
        moved = stepped.join(jump, "step", "left").select(
            "a", F.least("step", F.coalesce("jump", "step")).alias("label"), F.col("label").alias("was")
        )
        moved = materialise(moved, "labels")
        labels = moved.select("a", "label")
        if moved.where("label <> was").isEmpty():
            return labels.select(F.col("a").alias("id"), F.col("label").alias("component"))
