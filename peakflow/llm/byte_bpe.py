"""Ids of byte-level BPE for whole blocks of texts.

The vocabulary's pattern cuts a text into short pieces, and each piece is encoded alone. Pieces
repeat, so a block of texts is cut with array operations, every distinct piece is looked up once,
and only pieces not met before go to the tokenizer library.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from peakflow.llm.arrow_text import mix, prefix_hashes, span_hashes

_OTHER, _LETTER, _NUMBER, _SPACE, _EDGE = range(5)
_MOST_PIECES = 1_500_000


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point in the pattern `'s|... | ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+`."""
    codes = np.r_[np.arange(0xD800), np.arange(0xE000, 0x110000)]
    every = "".join(map(chr, codes.tolist()))
    table = np.zeros(0x110000, np.uint8)
    for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _SPACE)):
        for m in regex.finditer(pattern, every):
            table[codes[m.start() : m.end()]] = kind
    return table


def piece_starts(points: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Whether each code point begins a piece; `edge` marks the code points between texts."""
    kind = _classes()[points]
    kind[edge] = _EDGE
    n = len(points)
    before, after = np.r_[np.uint8(_EDGE), kind[:-1]], np.r_[kind[1:], np.uint8(_EDGE)]
    start = (kind != before) | edge
    solid = kind < _SPACE
    blank = points == 0x20
    start[1:] &= ~(solid[1:] & blank[:-1])  # a blank goes with what follows
    start |= (kind == _SPACE) & (after < _SPACE)  # of several spaces, the last stands apart
    # 's 't 'm 'd 're 've 'll where a piece begins at the quote
    quote = np.flatnonzero((points == 0x27) & start & (np.r_[False, ~blank[:-1]] | (before == _EDGE)))
    padded = np.r_[points, np.zeros(2, points.dtype)]
    edges = np.r_[kind == _EDGE, True, True]
    first, second = padded[quote + 1], padded[quote + 2]
    one = np.isin(first, [ord(c) for c in "stmd"]) & ~edges[quote + 1]
    two = np.zeros(len(quote), bool)
    for a, b in ("re", "ve", "ll"):
        two |= (first == ord(a)) & (second == ord(b))
    two &= ~edges[quote + 1] & ~edges[quote + 2]
    for at, length in ((quote[one], 2), (quote[two & ~one], 3)):
        start[at + 1] = False
        stop = at + length
        start[stop[stop < n]] = True
    return start


class Encoder:
    """Encodes blocks of texts; keeps the ids of pieces it has met, up to a fixed number.

    The pieces are known by a 64-bit hash. Sorted hashes, and for each where its ids lie in one flat
    array, take few bytes a piece. With `plain`, texts that hold an added token such as <|endoftext|>
    go whole through the library, which gives the token's own id; without, its letters are text.
    """

    def __init__(self, path: str, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.plain = Tokenizer.from_file(path)
        self.added = [t.content for t in self.plain.get_added_tokens_decoder().values()] if plain else []
        self.values = mix(np.arange(1, 0x110001, dtype=np.uint64))
        self._forget()

    def _forget(self) -> None:
        # 0 stands for the mark between texts, which has no ids.
        self.keys, self.begins, self.sizes = np.zeros(1, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where known keys stand, and which of the given are known."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        found, sizes = [], []
        for i in range(0, len(pieces), 4096):
            for e in self.tokenizer.encode_batch_fast(pieces[i : i + 4096], add_special_tokens=False):
                ids = e.ids
                found += ids
                sizes.append(len(ids))
        sizes = np.array(sizes, np.int64)
        begins = len(self.ids) + np.cumsum(sizes) - sizes
        self.ids = np.concatenate([self.ids, np.array(found, np.uint32)])
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, at, keys[order])
        self.begins = np.insert(self.begins, at, begins[order])
        self.sizes = np.insert(self.sizes, at, sizes[order])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where those of each text begin (one entry more); null is empty."""
        texts = pc.fill_null(texts, "")
        whole = np.zeros(len(texts), bool)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._by_pieces(texts)
        ids, bounds = self._by_pieces(pc.if_else(pa.array(whole), "", texts))
        parts = np.split(ids, bounds[1:-1])
        for i in np.flatnonzero(whole).tolist():
            parts[i] = np.array(self.plain.encode(texts[i].as_py(), add_special_tokens=False).ids, ids.dtype)
        return np.concatenate(parts), np.r_[0, np.cumsum([len(x) for x in parts])]

    def _by_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        import pandas as pd

        # One code point between texts, so that no piece crosses them.
        joined = "\n".join([*texts.to_pylist(), ""])
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths + 1) - 1
        edge = np.zeros(len(points), bool)
        edge[ends] = True
        starts = np.flatnonzero(piece_starts(points, edge))
        stops = np.r_[starts[1:], len(points)]
        prefix = prefix_hashes(self.values[points])
        keys = mix(span_hashes(prefix, starts, stops) + (stops - starts).astype(np.uint64))
        keys[edge[starts]] = 0
        codes, distinct = pd.factorize(keys)
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        if len(self.keys) > _MOST_PIECES:
            self._forget()
        new = np.flatnonzero(~self._places(distinct)[1])
        pieces = [joined[a:z] for a, z in zip(starts[first[new]].tolist(), stops[first[new]].tolist())]
        if pieces:
            self._learn(distinct[new], pieces)
        at = self._places(distinct)[0][codes]
        begins, counts, table = self.begins[at], self.sizes[at], self.ids
        total = np.r_[0, np.cumsum(counts)]
        out = table[np.repeat(begins - total[:-1], counts) + np.arange(total[-1])]
        bounds = total[np.searchsorted(starts, np.r_[0, ends])]
        return out, bounds
