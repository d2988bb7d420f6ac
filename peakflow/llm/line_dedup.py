"""Line deduplication through sharded minimal perfect hashes.

Every distinct line is counted once per document. The line hashes are dealt to shards; a shard keeps
a minimal perfect hash over its lines and, in the order it gives, an array of fingerprints and one
of counts. Documents are grouped in blocks. The distinct lines of a block probe the arrays of their
shards, and only those found often enough come back to the block, where they are sorted before its
documents. So no line text is joined, a very frequent line is one row per block, and what a task holds
is one shard, or the frequent lines of a block and the documents of one batch, however long they are.

Lines are known by 128 bits of a hash: one half places a line, the other is its fingerprint.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakflow.llm.arrow_text import SPACES, blocks
from peakflow.llm.perfect_hash import PerfectHash
from peakflow.session import materialise

SHARD_LINES = 1 << 16
BLOCK_DOCUMENTS = 1000


def line_keys(text: bytes, least: int) -> tuple[list[bytes], list[bytes]]:
    """Lines of a text, and for each the 16 bytes it is known by; empty for a key below `least` code points."""
    lines = text.split(b"\n")
    keys = []
    for line in lines:
        key = line.strip(SPACES).lower()  # of bytes: A-Z only
        keys.append(b"" if _points(key) < least else xxhash.xxh3_128_digest(key))
    return lines, keys


def _points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def _bytes_of(column: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column.cast(pa.binary())]


def _halves(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)


def _line_rows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(block, place, mark, found): the distinct lines of a batch by block, and in how many of its documents."""
        for batch in blocks(batches):
            seen: Counter = Counter()
            for block, text in zip(batch.column("block").to_pylist(), _bytes_of(batch.column("text"))):
                seen.update((block, k) for k in set(line_keys(text, least)[1]) if k)
            marks = _halves([k for _, k in seen])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([b for b, _ in seen], pa.int64()),
                    pa.array(marks[:, 0]),
                    pa.array(marks[:, 1]),
                    pa.array(list(seen.values()), pa.int64()),
                ],
                ["block", "place", "mark", "found"],
            )

    return run


def _key(place: np.ndarray, mark: np.ndarray, salt: int) -> np.ndarray:
    """One number for both halves; those of two lines may be equal under one salt, but not under every."""
    return place.view(np.uint64) ^ (mark.view(np.uint64) * np.uint64(0xFF51AFD7ED558CCD + 2 * salt))


def _distinct_keys(place: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, int]:
    """The keys of distinct lines under the first salt that tells them all apart."""
    salt = 0
    while len(np.unique(keys := _key(place, mark, salt))) < len(keys):
        salt += 1
    return keys, salt


def _build_shard(table: pa.Table) -> pa.Table:
    place, mark, count = (table.column(c).to_numpy() for c in ("place", "mark", "count"))
    keys, salt = _distinct_keys(place, mark)
    rule = PerfectHash.build(keys)
    at = rule.index(keys)
    prints, counts = np.empty(len(keys), np.uint32), np.empty(len(keys), np.uint32)
    prints[at] = mark.astype(np.uint64) & np.uint64(0xFFFFFFFF)
    counts[at] = np.minimum(count, 0xFFFFFFFF)
    return pa.table(
        {
            "shard": table.column("shard").slice(0, 1),
            "salt": pa.array([salt], pa.int64()),
            "sizes": pa.array([rule.sizes], pa.list_(pa.int64())),
            "bits": pa.array([rule.packed], pa.binary()),
            "prints": pa.array([prints.tobytes()], pa.binary()),
            "counts": pa.array([counts.tobytes()], pa.binary()),
        }
    )


def _probe(at_least: int):
    def run(lines: pa.Table, index: pa.Table) -> pa.Table:
        lines = lines.select(["block", "place", "mark"])
        if not len(index) or not len(lines):
            return lines.slice(0, 0)
        place, mark = (lines.column(c).to_numpy() for c in ("place", "mark"))
        row = {c: index.column(c)[0].as_py() for c in ("salt", "sizes", "bits", "prints", "counts")}
        rule = PerfectHash(row["sizes"], row["bits"])
        at = rule.index(_key(place, mark, row["salt"]))
        prints, counts = np.frombuffer(row["prints"], np.uint32), np.frombuffer(row["counts"], np.uint32)
        same = (at >= 0) & (prints[at] == (mark.astype(np.uint64) & np.uint64(0xFFFFFFFF)))
        return lines.filter(pa.array(same & (counts[at] >= at_least)))

    return run


def _strip(least: int):
    def stripped(rows: pa.StructArray, gone: set[bytes]) -> pa.RecordBatch:
        names = [f.name for f in rows.type]
        fields = dict(zip(names, rows.flatten()))
        kept, total, dropped = [], [], []
        for text in _bytes_of(fields["text"]):
            lines, keys = line_keys(text, least)
            left = [line for line, k in zip(lines, keys) if k not in gone] if gone else lines
            kept.append(b"\n".join(left))
            total.append(len(lines))
            dropped.append(len(lines) - len(left))
        fields["text"] = pa.array(kept, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(
            [
                pa.StructArray.from_arrays(list(fields.values()), names),
                pa.array(total, pa.int64()),
                pa.array(dropped, pa.int64()),
            ],
            ["row", "n_lines", "n_dropped"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block, its frequent lines (without a row) before its documents."""
        current, gone = None, set()
        for batch in batches:
            block = batch.column("block").to_numpy()
            line = pc.is_null(batch.column("row")).to_numpy(zero_copy_only=False)
            turns = np.flatnonzero((block[1:] != block[:-1]) | (line[1:] != line[:-1])) + 1
            for first, last in zip([0, *turns.tolist()], [*turns.tolist(), len(block)]):
                if last > first and block[first] != current:
                    current, gone = block[first], set()
                part = batch.slice(first, last - first)
                if last > first and line[first]:
                    halves = np.column_stack([part.column(c).to_numpy() for c in ("place", "mark")])
                    gone.update(x.tobytes() for x in halves)
                elif last > first:
                    yield stripped(part.column("row"), gone)

    return run


def line_index(lines: DataFrame) -> tuple[DataFrame, int]:
    """The shards of the index over rows (place, mark, found), and how many there are.

    A shard is a row: shard, salt of its keys, sizes and bits of its perfect hash, prints, counts.
    """
    counts = materialise(lines.groupBy("place", "mark").agg(F.sum("found").alias("count")), "line-counts")
    shards = counts.count() // SHARD_LINES + 1
    dealt = counts.withColumn("shard", F.pmod("place", F.lit(shards)))
    index = dealt.groupBy("shard").applyInArrow(
        _build_shard, "shard long, salt long, sizes array<long>, bits binary, prints binary, counts binary"
    )
    return materialise(index, "line-index"), shards


def drop_common_lines(docs: DataFrame, least_points: int = 1, at_least: int = 10) -> DataFrame:
    """`docs` with the kept lines in text, and with n_lines and n_dropped beside its columns.

    A text is split at \\n; null and empty texts are one empty line and come back empty. A line's key
    is the line without ASCII white space at both ends and with A-Z lower-cased. Lines whose key has
    at least `least_points` code points and is found in at least `at_least` rows of `docs` are
    dropped everywhere. A repeated row counts as another document; a line that a document repeats
    counts once. Columns of `docs` called n_lines or n_dropped get a leading underscore.
    """
    names = {c: f"_{c}" for c in ("n_lines", "n_dropped") if c in docs.columns}
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(docs.count() // BLOCK_DOCUMENTS + 1))
    lines = materialise(
        docs.select(block.alias("block"), "text").mapInArrow(
            _line_rows(least_points), "block long, place long, mark long, found long"
        ),
        "lines",
    )
    index, shards = line_index(lines)
    probes = lines.select("block", "place", "mark").distinct().withColumn("shard", F.pmod("place", F.lit(shards)))
    frequent = probes.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(
        _probe(at_least), "block long, place long, mark long"
    )
    rows = docs.withColumnsRenamed(names)
    rows = rows.select(block.alias("block"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    dealt = frequent.unionByName(rows, allowMissingColumns=True).repartition("block")
    dealt = dealt.sortWithinPartitions("block", F.col("row").isNotNull())
    out = dealt.mapInArrow(
        _strip(least_points), f"row {rows.schema['row'].dataType.simpleString()}, n_lines long, n_dropped long"
    )
    return out.select("row.*", "n_lines", "n_dropped")
