"""Sets of word shingles of texts, as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from peakflow.llm.arrow_text import mix, utf8, word_hashes, words

_STEP = 0xD6E8FEB86659FD93


def shingle_sets(batch: pa.RecordBatch, size: int = 5, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text in a row, sorted within the text, and where each set begins.

    Words are lower-cased (A-Z) and split at ASCII white space. A text of fewer than `size` words
    has its whole sequence as one shingle; one without words, or null, has none.
    """
    data, offsets = utf8(batch.column(column))
    start, end, first = words(data, offsets)
    hashes = word_hashes(data, start, end)
    weights = np.array([pow(_STEP, j, 1 << 64) for j in range(size)], np.uint64)
    whole = max(len(hashes) - size + 1, 0)
    shingles = np.zeros(whole, np.uint64)
    for j in range(size):
        shingles += hashes[j : j + whole] * weights[j]
    shingles = mix(shingles)

    counts = np.diff(first)
    sizes = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    begins = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(begins[-1], np.uint64)
    for i in np.flatnonzero(counts):
        a, z = first[i], first[i + 1]
        if z - a >= size:
            out[begins[i] : begins[i + 1]] = shingles[a : z - size + 1]
            out[begins[i] : begins[i + 1]].sort()
        else:
            out[begins[i]] = mix((hashes[a:z] * weights[: z - a]).sum(keepdims=True) + np.uint64(z - a))[0]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], kept[begins]


def set_ids(sets: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A hash of each set that does not depend on the order; 0 for an empty set."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(sets ^ np.uint64(_STEP)), dtype=np.uint64)])
    total = sums[begins[1:]] - sums[begins[:-1]]
    return np.where(np.diff(begins) > 0, mix(total + np.diff(begins).astype(np.uint64)), np.uint64(0))
