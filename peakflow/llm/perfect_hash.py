"""Minimal perfect hash of a shard of keys: levels of bit arrays, each key in the first level where it is alone."""

from __future__ import annotations

import numpy as np

from peakflow.llm.arrow_text import mix

_SLOTS_PER_KEY = 2
_LEVEL_STEP = 0x9E3779B97F4A7C15


def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    spread = mix(keys + np.uint64(level * _LEVEL_STEP & (1 << 64) - 1))
    return (((spread >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)


class PerfectHash:
    """Maps each of n distinct 64-bit keys to its own number below n; other keys to any, or to -1."""

    def __init__(self, sizes: list[int], bits: bytes):
        self.sizes = sizes
        self.packed = bits
        flat = np.unpackbits(np.frombuffer(bits, np.uint8))[: sum(sizes)].astype(bool)
        self.bits = np.split(flat, np.cumsum(sizes)[:-1]) if sizes else []
        counts = np.cumsum(np.r_[0, [int(b.sum()) for b in self.bits]]).tolist()
        self.ranks = [np.cumsum(b) - 1 + c for b, c in zip(self.bits, counts)]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, bits, level = [], [], 0
        while len(keys):
            if level == 64:
                raise ValueError("keys must be distinct")
            size = max(_SLOTS_PER_KEY * len(keys), 64)
            slots = _slots(keys, level, size)
            alone = np.bincount(slots, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            keys, level = keys[~alone[slots]], level + 1
        flat = np.concatenate(bits) if bits else np.empty(0, bool)
        return cls(sizes, np.packbits(flat).tobytes())

    def index(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            slots = _slots(keys[left], level, size)
            here = self.bits[level][slots]
            out[left[here]] = self.ranks[level][slots[here]]
            left = left[~here]
        return out
