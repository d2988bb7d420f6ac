"""Language-model scores from a probabilistic suffix tree over words.

A context is the last one, two, ... words before a token. It is counted when the training documents
have it `least_count` times, and its distribution is smoothed by that of the next shorter context:

    P(symbol | context) = max(n - discount, 0) / total + discount * followers / total * P(symbol | shorter)

down to the smoothed word counts, so the chances of every context add up to one. A context passes the
divergence test when the training tokens after it gain `least_divergence` bits on average over the
shorter context. The states of the tree are the contexts that pass and all their suffixes, also those
that do not pass themselves. A token is scored in the longest state that ends before it.

The tree grows with the corpus: nothing but frequency and divergence decides what is a state, and
neither tree nor counts are ever sent whole. Documents are stored in blocks, dealt to buckets once.
A block asks for the words, then for each length for the pairs of a context and its symbol, as packed
sorted lists, one to each cell of words or contexts; a cell adds up what all blocks have and answers
in the order asked, so answers carry no keys. Words, and pairs that can be contexts, get numbers in
their cell: a longer context is the number of a pair, and no two contexts are taken for one another.
Pairs come with the chance of the symbol after the shorter context, so the cell that counts a context
also tests it. With a context come its suffixes that are not known to pass; when the context passes,
they are marked, and blocks that wait for the marks of such contexts are told before they score.
A context with very many tokens is dealt to several cells by its symbols, and tested when all counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakflow.llm.arrow_text import blocks, mix, utf8, word_hashes, words
from peakflow.session import bucket_table, discard, drop_shuffles, materialise, materialise_in_buckets

BLOCK_BYTES = 8 << 20
CELL_BYTES = 12 << 20  # of text for each cell
HOT_TOKENS = 1 << 17  # a context with more tokens is dealt to more cells
END = np.uint64(0xE4D0F7E27ED0F7E3)  # stands after the last word of a text
ROUNDS = (2, 3, 2)  # by length of context: in each a part of the cells is asked, so that less is on disk at once
BITS = 20  # of a gain behind the point: sums of whole numbers do not depend on their order
_LOW = np.int64((1 << 32) - 1)
_SMALLER, _LARGER = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def held_out(modulus: int = 5, remainder: int = 1) -> Column:
    """Whether a row is kept from training; a null doc_id counts as an empty text."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return (F.crc32(name) % modulus) == remainder


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and its end, all in a row; where each text begins, one entry more."""
    data, offsets = utf8(texts)
    start, end, first = words(data, offsets)
    hashes = word_hashes(data, start, end)
    bounds = first + np.arange(len(first))
    out = np.full(bounds[-1], END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[bounds[1:] - 1] = False
    out[inside] = hashes
    return out, bounds


def packed(values: np.ndarray, rising: bool = False) -> bytes:
    """Whole numbers by as many planes of bytes as they need, compressed; of rising ones the differences."""
    values = np.ascontiguousarray(values, np.int64)
    if rising and len(values):
        values = np.r_[values[:1], np.diff(values)]
    width = 8
    if not len(values) or values.min() >= 0:
        width = max((int(values.max(initial=0)).bit_length() + 7) // 8, 1)
    planes = np.empty((width, len(values)), np.uint8)
    for i in range(width):
        planes[i] = values >> (8 * i)
    return bytes([width]) + _SMALLER.compress(planes)


def unpacked(data: bytes, rising: bool = False) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(_LARGER.decompress(memoryview(data)[1:]), np.uint8).reshape(width, -1)
    values = planes[0].astype(np.int64)
    for i in range(1, width):
        values |= planes[i].astype(np.int64) << (8 * i)
    return np.cumsum(values) if rising else values


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers, none below zero, and the place of each number among them."""
    shift = len(keys).bit_length()
    if not len(keys) or int(keys.max()).bit_length() + shift > 63:
        return np.unique(keys, return_inverse=True)
    both = np.sort((keys << shift) | np.arange(len(keys)))  # much faster than sorting places by key
    order = both & ((1 << shift) - 1)
    both >>= shift
    new = np.r_[True, both[1:] != both[:-1]]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return both[new], place


def _distinct_hashes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes, and the place of each hash among them."""
    low = np.uint64((1 << len(hashes).bit_length()) - 1)
    order = (np.sort((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)) & low).view(np.int64)
    found = hashes[order]
    if not len(hashes) or (found[1:] < found[:-1]).any():  # two that differ in their low bits only
        return np.unique(hashes, return_inverse=True)
    new = np.r_[True, found[1:] != found[:-1]]
    place = np.empty(len(hashes), np.int64)
    place[order] = np.cumsum(new) - 1
    return found[new], place


def _turned(order: np.ndarray) -> np.ndarray:
    """The place of each number in a permutation."""
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place


def _pieces(cell: np.ndarray) -> list[tuple[int, int, int]]:
    """(cell, first, last + 1) of each run in a sorted list of cells."""
    cuts = np.flatnonzero(np.diff(cell)) + 1
    return list(zip(cell[np.r_[0, cuts]].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(cell)])) if len(cell) else []


def _spread(numbers: np.ndarray, salt: np.ndarray | int, cells: int) -> np.ndarray:
    """The cell of each number; with a salt above zero another one."""
    mixed = mix(numbers.view(np.uint64) + np.uint64(1) + mix(np.atleast_1d(salt).astype(np.uint64)))
    return (mixed % np.uint64(cells)).astype(np.int64)


BLOCKS = pa.schema(
    [("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_()))]
    + [(c, pa.binary()) for c in ("sizes", "words", "own", "counts", "codes")]
)
_BLOCKS = "block long, doc_id array<long>, held_out array<boolean>, sizes binary, words binary, own binary, counts binary, codes binary"


def _into_blocks(cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block: its distinct words by cell and hash, and its tokens as their places by count."""
        number = TaskContext.get().partitionId() << 32
        for batch in blocks(batches, size=BLOCK_BYTES):
            hashes, bounds = tokens_of(batch.column("text"))
            distinct, codes = _distinct_hashes(hashes)
            order = np.argsort(distinct % np.uint64(cells), kind="stable")
            count = np.bincount(codes, minlength=len(distinct))[order]
            rank = _turned(np.argsort(-count, kind="stable"))[_turned(order)]
            held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            own = np.bincount(codes[np.repeat(~held, np.diff(bounds))], minlength=len(distinct))[order]
            row = (
                number, batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(),
                packed(np.diff(bounds)), packed(distinct[order].view(np.int64), True), packed(own), packed(count), packed(rank[codes]),
            )
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, BLOCKS.types)], schema=BLOCKS)
            number += 1

    return run


ASKS = pa.schema([("block", pa.int64()), ("level", pa.int64()), ("cell", pa.int64()), *[(c, pa.binary()) for c in "abcdef"]])
_ASKS = "block long, level long, cell long, a binary, b binary, c binary, d binary, e binary, f binary"
# kind: answer (to a block), fact, wish, mark, part; n and m: sums
ANSWERS = pa.schema(
    [("kind", pa.string()), *[(c, pa.int64()) for c in ("block", "level", "cell", "n", "m")], *[(c, pa.binary()) for c in "abc"]]
)
_ANSWERS = "kind string, block long, level long, cell long, n long, m long, a binary, b binary, c binary"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema) if rows else schema.empty_table()


@dataclass
class Walk:
    """The tokens of a block, counted and given chances level by level by what the cells answered."""

    cells: int
    tokens: int = 0
    distinct: int = 0
    least_count: int = 4
    discount: float = 0.5

    def read(self, docs: pa.Table) -> None:
        """Tokens as codes of the block's distinct words, which stand by cell and hash."""
        row = docs.select(["block", "sizes", "counts", "codes"]).to_pylist()[0]
        sizes, self.block = unpacked(row["sizes"]), row["block"]
        self.bounds = np.r_[0, np.cumsum(sizes)]
        by_count = np.argsort(-unpacked(row["counts"]), kind="stable")
        self.words, self.codes = len(by_count), by_count[unpacked(row["codes"])]
        held = docs.column("held_out").chunk(0).flatten().to_numpy(zero_copy_only=False)
        self.learn = np.repeat(~held.astype(bool), sizes)
        self.place = np.arange(len(self.codes)) - np.repeat(self.bounds[:-1], sizes)

    def hear(self, known: pa.Table) -> None:
        """Sort the answers by level and cell; give all tokens their chances by word counts."""
        rows = known.select(["level", "cell", "a", "b", "c"]).to_pylist()
        self.known: dict[int, list[dict]] = {}
        for r in sorted(rows, key=lambda r: (r["level"], r["cell"])):
            self.known.setdefault(r["level"], []).append(r)
        count, number = self.told(0, "a"), self._numbers(0, np.ones(self.words, bool))
        order = np.argsort(number)  # codes rise with the numbers from here on
        self.number, self.symbol = number[order], _turned(order)[self.codes]
        seen = count[order]
        self.seen = seen[self.symbol]
        root = self.chance_by_count(seen)
        self.root = np.log10(root)[self.symbol]
        self.chance = self.longest = root[self.symbol]
        self.context, self.total = self.number, seen
        self.before = np.r_[0, self.symbol[:-1]]
        self.level, self.suffixes = 0, np.empty((0, len(self.number)), np.int64)  # of each context, from the shortest on
        self.open = self.place >= 1

    def chance_by_count(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.5) / (self.tokens + 0.5 * (self.distinct + 1))

    def told(self, level: int, column: str) -> np.ndarray:
        parts = [unpacked(r[column]) for r in self.known.get(level, [])]
        return np.concatenate(parts) if parts else np.empty(0, np.int64)

    def _numbers(self, level: int, which: np.ndarray) -> np.ndarray:
        """Numbers, unlike from cell to cell, of the words or pairs that got one."""
        out = np.full(len(which), -1, np.int64)
        parts = [unpacked(r["b"], True) * self.cells + r["cell"] for r in self.known.get(level, [])]
        out[which] = np.concatenate(parts) if parts else 0
        return out

    def pairs(self, part: int = 0, parts: int = 1) -> None:
        """Distinct pairs of a context and its symbol by cell, context and symbol, and the contexts of each cell.

        Pairs of other cells than those of the part are left out.
        """
        after = np.flatnonzero(self.open)
        self.at = after[self.total[self.before[after]] >= self.least_count]
        code, symbol = self.before[self.at], self.symbol[self.at]
        self.shares = shares = -(-self.total // HOT_TOKENS)
        asked = np.zeros(len(self.context), bool)
        asked[code] = True
        self.asked = asked = np.flatnonzero(asked)
        of = np.repeat(asked, shares[asked])  # a context of many cells is told about in each
        salt = np.arange(len(of)) - np.repeat(np.cumsum(shares[asked]) - shares[asked], shares[asked])
        entries = np.sort((_spread(self.context[of], salt, self.cells) << 32) | of)
        self.entries = entries[np.diff(entries, prepend=-1) != 0]
        entry = np.zeros(len(self.context), np.int64)
        entry[self.entries & _LOW] = np.arange(len(self.entries))
        entry = entry[code]
        if (shares[asked] > 1).any():
            hot = np.flatnonzero(shares[code] > 1)
            salt = _spread(self.number[symbol[hot]], 1, 1 << 40) % shares[code[hot]]
            dealt = (_spread(self.context[code[hot]], salt, self.cells) << 32) | code[hot]
            entry[hot] = np.searchsorted(self.entries, dealt)
        if parts > 1:
            keep = ((self.entries >> 32) % parts == part)[entry]
            self.at, entry, symbol = self.at[keep], entry[keep], symbol[keep]
        self.distinct_pairs, self.pair = _distinct(entry * len(self.number) + symbol)

    def asked_pairs(self, part: int = 0, parts: int = 1) -> list[tuple]:
        """What the block asks of a part of the cells; about the chance of a symbol its count says it all at first."""
        self.pairs(part, parts)
        own = np.bincount(self.pair[self.learn[self.at]], minlength=len(self.distinct_pairs))
        entry = self.distinct_pairs // len(self.number)
        symbol_code = self.distinct_pairs - entry * len(self.number)
        symbol = self.number[symbol_code]
        many = np.bincount(entry, minlength=len(self.entries))
        step = np.r_[symbol[:1], np.where(np.diff(entry) == 0, np.diff(symbol), symbol[1:])]
        first = np.r_[0, np.cumsum(many)]
        one = np.empty(len(self.distinct_pairs), np.int64)
        one[self.pair] = self.at
        told = _bits(self.chance[one]) if self.level else self.seen[one]
        code = self.entries & _LOW
        context, suffixes = self.context[code], np.concatenate([self.shares[None, code] > 1, self.suffixes[:, code]])
        out = []
        for c, i, j in _pieces(self.entries >> 32):
            if c % parts != part:
                continue
            x, y = first[i], first[j]
            chances = told[x:y]
            if not self.level:  # once for each symbol, as they rise
                by_symbol = np.full(len(self.number), -1)
                by_symbol[symbol_code[x:y]] = chances
                chances = by_symbol[by_symbol >= 0]
            lists = packed(context[i:j], True), packed(many[i:j]), packed(step[x:y]), packed(own[x:y])
            out.append((self.block, self.level + 1, c, *lists, packed(chances), packed(suffixes[:, i:j].ravel())))
        return out

    def wished(self, which: np.ndarray, level: int) -> list[tuple]:
        """Contexts of which the block waits to hear whether they are marked."""
        code, cell = self._by_cell(which)
        return [
            (self.block, -level, c, packed(self.context[code[i:j]], True), b"", b"", b"", b"", b"")
            for c, i, j in _pieces(cell)
        ]

    def _by_cell(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Contexts by the cell of their marks, and these cells."""
        cell = _spread(self.context[which], 0, self.cells)
        order = np.argsort(cell, kind="stable")
        return which[order], cell[order]

    def step(self, level: int) -> None:
        """Take the answers about the pairs of this length; the pairs seen often enough are the next contexts."""
        self.pairs()
        n, told = self.told(level, "a"), self.told(level, "c")
        code = self.entries & _LOW
        followers = np.bincount(code, told >> 1, len(self.context))
        self.passed = np.zeros(len(self.context), bool)
        self.passed[code[(told & 1) > 0]] = True
        here = self.before[self.at]
        left = self.discount * followers / np.maximum(self.total, 1)
        longer = np.maximum(n - self.discount, 0)[self.pair] / self.total[here] + left[here] * self.chance[self.at]
        self.chance = self.chance.copy()
        self.chance[self.at] = longer
        self.here, self.level = here, level

    def unsure(self) -> np.ndarray:
        """The contexts of this length that are not known to pass."""
        return self.asked[~self.passed[self.asked]]

    def choose(self, depth: int) -> None:
        """Score the tokens after a state of this length."""
        state = self.passed.copy()
        waiting = self.unsure() if self.level < depth else self.asked[self.shares[self.asked] > 1]
        state[self._by_cell(waiting)[0]] = self.told(-self.level, "a") > 0
        on = state[self.here]
        here = self.at[on]
        self.longest = self.longest.copy()
        self.longest[here] = self.chance[here]

    def lengthen(self) -> None:
        """Go from contexts to those of one word more: the pairs that have a number."""
        n = self.told(self.level, "a")
        number = self._numbers(self.level, n >= self.least_count)
        found = np.flatnonzero(number >= 0)
        order = found[np.argsort(number[found])]
        code = np.full(len(n), -1)
        code[order] = np.arange(len(order))
        place = np.empty(len(n), np.int64)
        place[self.pair] = self.at + 1  # before which token a pair stands as a context
        shorter = self.before[np.minimum(place[order], len(self.before) - 1)]
        before = np.full(len(self.symbol) + 1, -1)
        before[self.at + 1] = code[self.pair]
        unsure = np.where(self.passed, 0, self.context + 1)  # zero stands for a suffix known to pass
        self.suffixes = np.concatenate([self.suffixes[:, shorter], unsure[None, shorter]])
        self.context, self.total = number[order], n[order]
        self.before, self.open = np.maximum(before[:-1], 0), (before[:-1] >= 0) & (self.place > self.level)

    def scores(self, docs: pa.Table) -> pa.Table:
        begins = self.bounds[:-1]
        return pa.table(
            {
                "doc_id": docs.column("doc_id").chunk(0).flatten(),
                "held_out": docs.column("held_out").chunk(0).flatten(),
                "n_tokens": pa.array(np.diff(self.bounds)),
                "n_known": pa.array(np.add.reduceat((self.seen > 0).astype(np.int64), begins)),
                "train_tokens": pa.array(np.full(len(begins), self.tokens, np.int64)),
                "base_score": pa.array(np.add.reduceat(self.root, begins)),
                "score": pa.array(np.add.reduceat(np.log10(self.longest), begins)),
            }
        )


def _ask_words(cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block's words and how often they are in its training documents, for their cells."""
        for batch in batches:
            for r in batch.to_pylist():
                words, own = unpacked(r["words"], True), unpacked(r["own"])
                cell = (words.view(np.uint64) % np.uint64(cells)).astype(np.int64)
                out = [
                    (r["block"], 0, c, packed(words[i:j], True), packed(own[i:j]), b"", b"", b"", b"")
                    for c, i, j in _pieces(cell)
                ]
                yield from _table(out, ASKS).to_batches()

    return run


def _visit(walk: Walk, what, empty: pa.Table):
    """What a block has to say when it has heard the answers."""

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        if not len(docs):
            return empty
        docs = docs.combine_chunks()
        walk.read(docs)
        walk.hear(known)
        return what(docs)

    return run


def _block_pairs(walk: Walk, level: int, depth: int, part: int = 0, parts: int = 1):
    def what(docs: pa.Table) -> pa.Table:
        out = []
        for shorter in range(1, level):
            walk.step(shorter)
            if level == depth and not part:
                out += walk.wished(walk.unsure(), shorter)
            walk.lengthen()
        out += walk.asked_pairs(part, parts)
        if level == depth and not part:
            out += walk.wished(walk.asked[walk.shares[walk.asked] > 1], level)
        return _table(out, ASKS)

    return _visit(walk, what, ASKS.empty_table())


def _block_scores(walk: Walk, depth: int):
    def what(docs: pa.Table) -> pa.Table:
        for level in range(1, depth + 1):
            walk.step(level)
            walk.choose(depth)
            if level < depth:
                walk.lengthen()
        return walk.scores(docs)

    return _visit(walk, what, SCORES.empty_table())


SCORES = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), *[(c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")]]
    + [("base_score", pa.float64()), ("score", pa.float64())]
)
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Parts in a row, and where each begins, one entry more."""
    return np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]


def _count_words(asks: pa.Table) -> pa.Table:
    """Counts and numbers of the words of a cell; as a fact, the cell's tokens and its words seen in training."""
    rows = asks.to_pylist()
    words, bounds = _joined([unpacked(r["a"], True).view(np.uint64) for r in rows])
    n, _ = _joined([unpacked(r["b"]) for r in rows])
    distinct, at = np.unique(words, return_inverse=True)
    count = np.zeros(len(distinct), np.int64)
    np.add.at(count, at, n)
    out = [
        ("answer", r["block"], 0, r["cell"], 0, 0, packed(count[at[i:j]]), packed(at[i:j], True), b"")
        for r, i, j in zip(rows, bounds[:-1], bounds[1:])
    ]
    cell = rows[0]["cell"]
    return _table([*out, ("fact", -1 - cell, 0, cell, int(count.sum()), int((count > 0).sum()), b"", b"", b"")], ANSWERS)


def _bits(chance: np.ndarray) -> np.ndarray:
    return np.rint(-np.log2(chance) * (1 << BITS)).astype(np.int64)


def _gains(count: np.ndarray, bits: np.ndarray, total, followers, discount: float) -> np.ndarray:
    """What the training tokens of each pair gain over the shorter context, whose chances are 2 ** -bits."""
    chance = np.maximum(count - discount, 0) / total + discount * followers / total * np.exp2(-bits / (1 << BITS))
    return count * np.rint(np.log2(chance) * (1 << BITS) + bits).astype(np.int64)


def _marks(level: int, contexts: np.ndarray, cells: int) -> list[tuple]:
    """Contexts of one length, each for the cell where blocks wait for its mark."""
    cell = _spread(contexts, 0, cells)
    order = np.argsort(cell, kind="stable")
    return [
        ("mark", -1 - c, level, c, 0, 0, packed(contexts[order[i:j]], True), b"", b"") for c, i, j in _pieces(cell[order])
    ]


def _count_pairs(walk: Walk, level: int, least_divergence: float):
    def run(asks: pa.Table) -> pa.Table:
        """Counts of the pairs of a cell, numbers of those that can be contexts, followers and test of each context.

        Wishes go on as they are. A context that is dealt to more cells leaves what is here of it as a part.
        """
        rows = asks.to_pylist()
        out = [("wish", r["block"], -r["level"], r["cell"], 0, 0, r["a"], b"", b"") for r in rows if r["level"] < 0]
        rows = [r for r in rows if r["level"] > 0]
        if not rows:
            return _table(out, ANSWERS)
        entries, entry_bounds = _joined([unpacked(r["a"], True) for r in rows])
        many, _ = _joined([unpacked(r["b"]) for r in rows])
        step, bounds = _joined([unpacked(r["c"]) for r in rows])
        own, _ = _joined([unpacked(r["d"]) for r in rows])
        told = [unpacked(r["e"]) for r in rows]
        suffixes = np.concatenate([unpacked(r["f"]).reshape(level, -1) for r in rows], axis=1)
        begin = np.cumsum(many) - many
        symbol = np.cumsum(step)
        symbol -= np.repeat(np.where(begin > 0, symbol[begin - 1], 0), many)
        contexts, context = _distinct(entries)
        one = np.empty(len(contexts), np.int64)
        one[context] = np.arange(len(context))
        suffixes = suffixes[:, one]
        base = int(symbol.max()) + 1
        pairs, at = _distinct(np.repeat(context, many) * base + symbol)
        of = pairs // base
        count, bits = np.zeros(len(pairs), np.int64), np.empty(len(pairs), np.int64)
        np.add.at(count, at, own)
        if level == 1:
            told = [_bits(walk.chance_by_count(t))[_distinct(symbol[i:j])[1]] for t, i, j in zip(told, bounds, bounds[1:])]
        bits[at] = np.concatenate(told)
        seen = count > 0
        followers = np.bincount(of[seen], minlength=len(contexts))
        total, gain = np.zeros(len(contexts), np.int64), np.zeros(len(contexts), np.int64)
        np.add.at(total, of, count)
        each = of[seen]
        np.add.at(gain, each, _gains(count[seen], bits[seen], total[each], followers[each], walk.discount))
        hot = suffixes[0] > 0
        passed = (gain >= least_divergence * (1 << BITS) * total) & ~hot
        number = np.cumsum(count >= walk.least_count) - 1
        answer = followers * 2 + passed
        cell = rows[0]["cell"]
        for k, r in enumerate(rows):
            here = at[bounds[k] : bounds[k + 1]]
            n = count[here]
            numbers = number[here[n >= walk.least_count]]
            mine = answer[context[entry_bounds[k] : entry_bounds[k + 1]]]
            out.append(("answer", r["block"], level, cell, 0, 0, packed(n), packed(numbers, True), packed(mine)))
        for shorter in range(1, level):
            marked = suffixes[shorter, passed]
            out += _marks(shorter, np.unique(marked[marked > 0]) - 1, walk.cells)
        for k in np.flatnonzero(hot):
            i, j = np.searchsorted(of, [k, k + 1])
            which = np.flatnonzero(seen[i:j]) + i
            lists = packed(suffixes[1:, k]), packed(count[which]), packed(bits[which])
            out.append(("part", -1 - cell, level, int(contexts[k]), int(total[k]), int(followers[k]), *lists))
        return _table(out, ANSWERS)

    return run


def _part_gains(discount: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gain = [
                int(_gains(unpacked(r["b"]), unpacked(r["c"]), r["total"], r["followers"], discount).sum())
                for r in batch.select(["b", "c", "total", "followers"]).to_pylist()
            ]
            columns = [batch.column(c) for c in ("level", "cell", "a", "total")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gain, pa.int64())], ["level", "cell", "a", "total", "gain"])

    return run


def _part_marks(cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contexts of many cells that passed, and their suffixes not known to pass."""
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                for level, number in enumerate([*unpacked(r["a"]).tolist(), r["cell"] + 1], 1):
                    out += _marks(level, np.array([number - 1]), cells) if number else []
            yield from _table(out, ANSWERS).to_batches()

    return run


def _states(wishes: pa.Table, marks: pa.Table) -> pa.Table:
    """For each block which of the contexts it waits for are marked, under the level below zero."""
    states = np.unique(np.concatenate([np.empty(0, np.int64), *[unpacked(x, True) for x in marks.column("a").to_pylist()]]))
    return _table(
        [
            ("answer", r["block"], -r["level"], r["cell"], 0, 0, packed(np.isin(unpacked(r["a"], True), states)), b"", b"")
            for r in wishes.to_pylist()
        ],
        ANSWERS,
    )


def suffix_tree_scores(
    docs: DataFrame,
    depth: int = 3,
    least_count: int = 4,
    least_divergence: float = 0.01,
    discount: float = 0.5,
) -> DataFrame:
    """A row for each row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Words are lower-cased (A-Z) and split at ASCII white space; each text has an end token after its
    words, so a null or empty text is scored too. `base_score` is the log10 probability of the tokens
    by smoothed word counts alone, `score` that of the tree, whose longest states have `depth` words.
    A null doc_id is in training; repeated rows are learned and scored as often. With nothing to learn
    from, every token is unknown. Other columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out().alias("held_out"))
    drop_shuffles(docs.sparkSession)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells, buckets = size // CELL_BYTES + 1, 2 * (size // BLOCK_BYTES) + 1
    kept = materialise(rows.mapInArrow(_into_blocks(cells), _BLOCKS), "lm-blocks")
    with bucket_table(docs.sparkSession, "lm-told", buckets, "block") as tell:
        asked = kept.select("block", "words", "own").mapInArrow(_ask_words(cells), _ASKS).repartition(cells, "cell")
        told = tell(asked.groupBy("cell").applyInArrow(_count_words, _ANSWERS))
        stored = materialise_in_buckets(kept.drop("words", "own"), "lm-tokens", buckets, "block")
        discard(kept)  # with the words themselves, which nobody asks for again
        facts = told.where("kind = 'fact'").agg(F.sum("n").alias("tokens"), F.sum("m").alias("distinct")).first()
        walk = Walk(cells, facts.tokens or 0, facts.distinct or 0, least_count, discount)

        def visit(run, schema: str) -> DataFrame:
            known = told.where("kind = 'answer'").groupBy("block")
            return stored.groupBy("block").cogroup(known).applyInArrow(run, schema)

        for level in range(1, depth + 1):
            parts = min(ROUNDS[min(level, len(ROUNDS)) - 1], cells)
            for part in range(parts):
                asked = visit(_block_pairs(walk, level, depth, part, parts), _ASKS).repartition(cells, "cell")
                more = tell(asked.groupBy("cell").applyInArrow(_count_pairs(walk, level, least_divergence), _ANSWERS))
            told = more
        parts = told.where("kind = 'part'").select("level", "cell", "n", "m", "a", "b", "c")
        sums = parts.groupBy("level", "cell").agg(F.sum("n").alias("total"), F.sum("m").alias("followers"))
        gains = parts.join(sums, ["level", "cell"]).mapInArrow(
            _part_gains(discount), "level long, cell long, a binary, total long, gain long"
        )
        gains = gains.groupBy("level", "cell").agg(F.sum("gain").alias("gain"), F.first("total").alias("total"), F.first("a").alias("a"))
        passed = gains.where(F.col("gain") >= least_divergence * (1 << BITS) * F.col("total")).select("level", "cell", "a")
        marks = passed.mapInArrow(_part_marks(cells), _ANSWERS).unionAll(told.where("kind = 'mark'"))
        wishes = told.where("kind = 'wish'").groupBy("level", "cell")
        told = tell(wishes.cogroup(marks.groupBy("level", "cell")).applyInArrow(_states, _ANSWERS))
    return visit(_block_scores(walk, depth), _SCORES)
