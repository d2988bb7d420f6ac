"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are put into bands of like length. A vector is scaled by the largest norm of its band and
given one more coordinate that makes it a unit vector; a query is scaled to length one and gets a 0
there, so that within a band the largest inner product is the nearest direction. A table turns it by
three rounds of random signs and a Hadamard transform, and its bucket is the nearest signed axis. A
query looks into the buckets of its nearest axes, in every table and band; what lies there is ranked
by the exact inner product of the original vectors.

The vectors of a table are dealt to cells by groups of buckets. A group with more rows than a cell
should hold is cut at random, and its queries go to every part; very many queries are cut into
blocks too. Nothing is dropped: of equal vectors in a cell, those are put aside that cannot be among
the nearest because enough equal ones with a smaller id are there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakflow.session import materialise

TABLES = 6
LEAST_PROBES = 40
LEAST_CANDIDATES = 600
BAND_RATIO = 1.25
MOST_BANDS = 32  # the shortest vectors share the last one
GROUPS = 4
CELL_ROWS = 16_384
CELL_QUERIES = 4_096


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as packed doubles; those that are null, zero or not finite are left out."""
    for batch in batches:
        ids, packed = [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
            if i is None or not v.is_valid or v.values.null_count or not len(v.values):
                continue
            x = v.values.to_numpy(zero_copy_only=False).astype("<f8")
            if np.isfinite(x).all() and x.any():
                ids.append(i)
                packed.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], ["vec_id", "vector"])


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = [np.frombuffer(x.as_buffer(), "<f8") for x in column]
    return np.stack(rows) if rows else np.empty((0, 0))


def _norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(batch.column("vector"))
        longest = float(np.sqrt((x * x).sum(axis=1)).max()) if len(x) else 0.0
        yield pa.RecordBatch.from_arrays([pa.array([longest])], ["norm"])


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row; the width is a power of two."""
    rows, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(rows, -1, 2, step)
        x = np.concatenate([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(rows, width)
        step *= 2
    return x / np.sqrt(width)


def nearness(vectors: np.ndarray, last: np.ndarray | float, table: int) -> np.ndarray:
    """How near each vector, with one coordinate more, lies to each signed axis of a table: 2 x width columns."""
    width = 1 << vectors.shape[1].bit_length()  # room for one coordinate more
    x = np.zeros((len(vectors), width))
    x[:, : vectors.shape[1]] = vectors
    x[:, vectors.shape[1]] = last
    signs = np.random.default_rng([8, table]).choice([-1.0, 1.0], (3, width))
    for s in signs:
        x = hadamard(x * s)
    return np.concatenate([x, -x], axis=1)


def _steps(vectors: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """The norm of each vector, and how many times `BAND_RATIO` it is below the longest."""
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    return norms, np.floor(np.log(longest / norms) / np.log(BAND_RATIO) + 1e-9).astype(np.int32)


def _band_sizes(longest: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                norms, step = _steps(_matrix(batch.column("vector")), longest)
                yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(norms)], ["step", "norm"])

    return run


def _buckets(longest: float, steps: np.ndarray, norm: np.ndarray, tables: int):
    """The bucket of each vector in each table, counted on from band to band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("vector"))
            band = np.minimum(np.searchsorted(steps, _steps(vectors, longest)[1]), len(steps) - 1)
            scaled = vectors / norm[band][:, None]
            rest = np.sqrt(np.maximum(1 - (scaled * scaled).sum(axis=1), 0))
            for t in range(tables):
                near = nearness(scaled, rest, t)
                bucket = near.argmax(axis=1) + band * near.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(band), t, np.int32)), pa.array(bucket.astype(np.int32)), *batch.columns],
                    ["table", "bucket", "vec_id", "vector"],
                )

    return run


def _probes(counts: np.ndarray, groups: int):
    """For each query, table and group the buckets to look into; every band has `groups` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, bands, buckets = counts.shape
        per_group = buckets // groups
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("vector"))
            directions = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
            for t in range(tables):
                order = np.argsort(-nearness(directions, 0.0, t), axis=1, kind="stable")
                asked = np.zeros((len(order), bands, buckets), bool)
                for b in range(bands):
                    held = np.cumsum(counts[t, b][order], axis=1)
                    probes = np.maximum((held < LEAST_CANDIDATES).sum(axis=1) + 1, LEAST_PROBES)
                    np.put_along_axis(asked[:, b], order, np.arange(buckets)[None] < probes[:, None], axis=1)
                asked &= counts[t] > 0
                asked = asked.reshape(len(order), bands * groups, per_group)
                row, group = np.nonzero(asked.any(axis=2))
                masks = [m.tobytes() for m in np.packbits(asked[row, group], axis=1)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(row), t, np.int32)),
                        pa.array(group.astype(np.int32)),
                        batch.column("vec_id").take(pa.array(row)),
                        batch.column("vector").take(pa.array(row)),
                        pa.array(masks, pa.binary()),
                    ],
                    ["table", "group", "query_id", "vector", "asked"],
                )

    return run


def _nearest_in_cell(k: int, per_group: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(data) or not len(queries):
            return schema.empty_table()
        ids, vectors = data.column("vec_id").to_numpy(), _matrix(data.column("vector"))
        bucket = data.column("bucket").to_numpy() % per_group
        keep = _first_copies(vectors, ids, k + 1)
        ids, vectors, bucket = ids[keep], vectors[keep], bucket[keep]
        query, wanted = queries.column("query_id").to_numpy(), _matrix(queries.column("vector"))
        asked = [np.frombuffer(x.as_buffer(), np.uint8) for x in queries.column("asked").combine_chunks()]
        asked = np.unpackbits(np.stack(asked), axis=1)[:, :per_group].astype(bool)
        found = []
        for b in np.unique(bucket).tolist():
            here, who = np.flatnonzero(bucket == b), np.flatnonzero(asked[:, b])
            for a in range(0, len(who), 512):
                some = who[a : a + 512]
                rough = wanted[some] @ vectors[here].T
                if len(here) > k + 1:  # one of them may be the query itself
                    least = np.partition(rough, len(here) - k - 1, axis=1)[:, len(here) - k - 1]
                    q, d = np.nonzero(rough >= (least - 1e-9 * (1 + np.abs(least)))[:, None])
                else:
                    q, d = np.nonzero(np.ones(rough.shape, bool))
                q, d = some[q], here[d]
                other = query[q] != ids[d]
                found.append(_best(q[other], d[other], wanted, vectors, ids, k))
        if not found:
            return schema.empty_table()
        q, d, score = (np.concatenate(x) for x in zip(*found))
        q, d, score = _ranked(q, d, score, ids, k)
        return pa.table([pa.array(query[q]), pa.array(ids[d]), pa.array(score)], schema=schema)

    return run


def _first_copies(vectors: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Rows without those that have `most` equal vectors with smaller ids."""
    rows = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel()
    _, same = np.unique(rows, return_inverse=True)
    order = np.lexsort((ids, same))
    starts = np.flatnonzero(np.r_[True, np.diff(same[order]) != 0])
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[place < most]


def _best(q, d, wanted, vectors, ids, k):
    return _ranked(q, d, np.einsum("ij,ij->i", wanted[q], vectors[d]), ids, k)


def _ranked(q, d, score, ids, k):
    """The k nearest of each query, ties to the smaller id."""
    order = np.lexsort((ids[d], -score, q))
    q, d, score = q[order], d[order], score[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return q[place < k], d[place < k], score[place < k]


def _last_step(steps: DataFrame) -> int:
    """The step from which on all vectors share a band: that of the last of the `MOST_BANDS` longest bands."""
    return steps.select("step").distinct().orderBy("step").limit(MOST_BANDS).agg(F.max("step").alias("s")).first().s


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, tables: int = TABLES) -> DataFrame:
    """For each query its `k` nearest: query_id, rank (from 1), vec_id, score (inner product in doubles).

    Queries are the rows whose vec_id is divisible by `every`; candidates are all rows but those with
    the query's own id. Vectors that are null, zero, or hold null or non-finite components take no
    part, nor do rows without an id or with another number of components than most rows have. Of
    rows that repeat an id, the smallest vector (by its bytes) counts. Equal scores go to the smaller
    vec_id. With fewer than `k` candidates all are given. Other columns are ignored.
    """
    rows = vectors.select("vec_id", "embedding").mapInArrow(_clean, "vec_id long, vector binary")
    rows = materialise(rows.groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors")
    common = rows.groupBy(F.length("vector").alias("bytes")).count().orderBy(F.desc("count"), "bytes").first()
    if common is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.length("vector") == common.bytes)
    total = common["count"]
    longest = rows.mapInArrow(_norms, "norm double").agg(F.max("norm").alias("norm")).first().norm
    buckets = 2 << (common.bytes // 8).bit_length()
    per_group = buckets // GROUPS

    found = rows.mapInArrow(_band_sizes(longest), "step int, norm double")
    found = found.withColumn("step", F.least("step", F.lit(_last_step(found)))).groupBy("step")
    found = found.agg(F.max("norm").alias("norm")).orderBy("step").collect()
    steps, norm = np.array([r.step for r in found]), np.array([r.norm for r in found])
    hashed = rows.mapInArrow(
        _buckets(longest, steps, norm, tables), "table int, bucket int, vec_id long, vector binary"
    )
    hashed = materialise(hashed, "vector-buckets")
    counts = np.zeros((tables, len(steps) * buckets), np.int64)
    for r in hashed.groupBy("table", "bucket").count().collect():  # tables x bands x buckets at most
        counts[r.table, r.bucket] = r["count"]
    sizes = counts.reshape(tables, len(steps) * GROUPS, per_group).sum(axis=2)
    counts = counts.reshape(tables, len(steps), buckets)
    parts = F.array(*[F.array(*[F.lit(int(-(-n // CELL_ROWS)) or 1) for n in row]) for row in sizes.tolist()])
    queries = rows.where(F.col("vec_id") % every == 0)
    query_blocks = -(-queries.count() // CELL_QUERIES) or 1

    data = hashed.withColumn("group", (F.col("bucket") / per_group).cast("int"))
    data = data.withColumn("part", F.pmod(F.xxhash64("vec_id"), parts[F.col("table")][F.col("group")]).cast("int"))
    data = data.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = queries.mapInArrow(
        _probes(counts, GROUPS), "table int, group int, query_id long, vector binary, asked binary"
    )
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), parts[F.col("table")][F.col("group")] - 1)))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int"))
    cell = ["table", "group", "part", "block"]
    found = data.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInArrow(
        _nearest_in_cell(k, per_group), "query_id long, vec_id long, score double"
    )
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
