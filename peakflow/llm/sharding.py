"""Shards of near equal bytes by Karmarkar-Karp differencing, with equal texts in one shard.

Documents are bundled by a hash of their text, so that copies share a bundle, into a fixed number of
bundles; only their sizes, as many at any size of the table, meet in one task. There every bundle is a
partial partition with one full shard. The two partial partitions whose shards differ most are put
together, the fullest shard of one with the emptiest of the other, until one is left.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakflow.operators.ordering import with_row_number
from peakflow.session import materialise

BUNDLES = 1 << 14
ROW_BYTES = 16


def differencing(sizes: Iterable[int], shards: int) -> np.ndarray:
    """The shard of each size; shards come out near equal in total, the fullest first.

    A node of the merging keeps how its two parts were put together, and the shards of the sizes are
    found by going down from the last node. Equal spreads go by age, so the outcome is fixed.
    """
    sizes = np.asarray(list(sizes), np.int64)
    n = len(sizes)
    if not n:
        return np.empty(0, np.int64)
    # Loads of a partial partition, largest first. Those of a single size follow when it is drawn.
    loads: dict[int, np.ndarray] = {}
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    parts: list[tuple[int, int, np.ndarray]] = []

    def taken() -> tuple[int, np.ndarray]:
        _, node = heapq.heappop(heap)
        if node < n:
            alone = np.zeros(shards, np.int64)
            alone[0] = sizes[node]
            return node, alone
        return node, loads.pop(node)

    while len(heap) > 1:
        (a, left), (b, right) = taken(), taken()
        together = left + right[::-1]
        order = np.argsort(-together, kind="stable")
        node = n + len(parts)
        parts.append((a, b, order))
        loads[node] = together[order]
        heapq.heappush(heap, (-int(together[order[0]] - together[order[-1]]), node))

    places: dict[int, np.ndarray] = {heap[0][1]: np.arange(shards)}
    shard = np.zeros(n, np.int64)
    for node in range(n + len(parts) - 1, n - 1, -1):
        a, b, order = parts[node - n]
        own = np.empty(shards, np.int64)
        own[order] = places.pop(node)  # where the shards of `a` went; those of `b` lie the other way round
        for child, at in ((a, own), (b, own[::-1])):
            if child < n:
                shard[child] = at[0]
            else:
                places[child] = at
    return shard


def _bundle(bundles: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("bundle"), F.coalesce("text", F.lit(""))), F.lit(bundles)).cast("int")


def _size() -> Column:
    return (F.octet_length(F.coalesce("text", F.lit(""))) + ROW_BYTES).cast("long")


def _dealt(shards: int):
    def run(loads: pa.Table) -> pa.Table:
        bundle, load = loads["bundle"].to_numpy(), loads["load"].to_numpy()
        order = np.lexsort((bundle, -load))
        shard = differencing(load[order], shards)
        return pa.table([pa.array(bundle[order], pa.int32()), pa.array(shard, pa.int32())], ["bundle", "shard"])

    return run


def _plan(sizes: DataFrame, shards: int) -> DataFrame:
    """(bundle, shard) for rows of bundle and size. Sizes are summed by bundle before they meet in one task."""
    loads = sizes.groupBy("bundle").agg(F.sum("size").alias("load"))
    plan = loads.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_dealt(shards), "bundle int, shard int")
    return F.broadcast(materialise(plan, "shard-plan"))  # two numbers for each of `bundles` bundles at most


def shard_rows(docs: DataFrame, shards: int = 40, bundles: int = BUNDLES) -> DataFrame:
    """A row for each row of `docs`: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    `size` is the UTF-8 bytes of the text plus 16; a null text counts as an empty one, also for
    what is equal. Equal texts share a shard; so do the few texts of a bundle. A shard that one
    group of copies alone makes larger than the others gets nothing else. `slot` counts a shard's
    rows from 0 in the order of doc_id, null first; rows alike in all keep the order of reading.
    `law` is `bytes`, and grown_shard, which only a law by key has, null. Other columns are ignored.
    """
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32")
    rows = docs.select("doc_id", _size().alias("size"), crc, _bundle(bundles).alias("bundle"))
    rows = materialise(rows, "shard-sizes")
    placed = rows.join(_plan(rows, shards), "bundle").drop("bundle")
    return with_row_number(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, bundles: int = BUNDLES) -> None:
    """Write the documents with all their columns, a folder `shard=<n>` for each shard.

    The shards are those of `shard_rows`. A column of `docs` called shard is written as `_shard`, as the folder
    has its name. Large shards are written by several tasks.
    """
    sizes = materialise(docs.select(_bundle(bundles).alias("bundle"), _size().alias("size")), "shard-sizes")
    plan = _plan(sizes, shards).withColumnsRenamed({"bundle": "_its_bundle"})
    rows = docs.withColumnsRenamed({"shard": "_shard"}).withColumn("_own_bundle", _bundle(bundles))
    rows = rows.join(plan, F.col("_own_bundle") == F.col("_its_bundle")).drop("_own_bundle", "_its_bundle")
    rows.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)
