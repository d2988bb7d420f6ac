"""Texts of Arrow batches as byte arrays: words, prefix hashes, and blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_U64 = (1 << 64) - 1

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
SPACES = b" \t\n\x0b\x0c\r"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


@lru_cache(maxsize=1)
def _powers_of(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.ones(size, np.uint64)
        filled = 1
        while filled < size:
            step = min(filled, size - filled)
            p[filled : filled + step] = p[:step] * np.uint64(pow(base, filled, 1 << 64))
            filled += step
        out.append(p)
    return out[0], out[1]


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least `size` of each."""
    return _powers_of(-(-size // (2 * BLOCK_BYTES)) * 2 * BLOCK_BYTES)


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Polynomial prefix hashes modulo 2^64 of 64-bit values; entry i covers the first i of them."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end), the same wherever a span stands."""
    _, down = powers(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column in a row, and where each text begins and ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a piece have about `size` bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
            last = max(last, first + 1)
            yield batch.slice(first, last - first)
            first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end, and for each text the number of its first word (one entry more)."""
    space = SPACE[data]
    first = np.ones(len(data), bool)
    first[1:] = space[:-1]
    last = np.ones(len(data), bool)
    last[:-1] = space[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = True
    last[inner - 1] = True
    start = np.flatnonzero(first & ~space)
    end = np.flatnonzero(last & ~space) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, with A-Z lower-cased."""
    prefix = prefix_hashes(BYTE_VALUES[LOWER[data]])
    return mix(span_hashes(prefix, start, end) + (end - start).astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
