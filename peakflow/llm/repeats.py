"""Removal of repeated byte strings by a hash-compared suffix sort.

A string of `length` bytes that starts at two places of the corpus is removed at both. Sorting all
suffixes would bring such places together; here only those are sorted that can have a partner:

1. Every window of `length` bytes chooses an anchor, the gram in it with the smallest hash. Equal
   windows choose the same gram at the same place, so windows are compared only under one gram.
   Neighbouring windows with one anchor make a segment of text.
2. Equal segments under a gram are one variant; when there are two or more, all their windows are
   repeated. Only under a gram with several variants are the bytes of each variant fetched, once.
3. Of the variants left under a gram, the windows are suffixes to be sorted. Those with the anchor
   at the same distance make a bucket. A mergesort over all buckets at once compares two suffixes by
   prefix polynomial hashes: a binary search finds how far they agree, the next byte decides.
   Neighbours that agree for `length` bytes are verified byte by byte. A bucket where a hash has
   misled the order is settled by its bytes. Under a gram with more than MOST_VARIANTS variants the
   windows are counted one by one, over all tasks, instead.

Windows of a text depend on the text alone, so texts are known by a hash, and copies share results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakflow.llm.arrow_text import BLOCK_BYTES, BYTE_VALUES, blocks, mix, powers, prefix_hashes, signed, span_hashes, utf8
from peakflow.session import materialise

GRAM = 32
BITMAP_BITS = 1 << 25
MOST_VARIANTS = 20_000
_PLACE_BITS = 28
_BLOCK_SLOTS = 1 << 15
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by the minima from both ends of blocks of that width."""
    count = len(values) - width + 1
    pad = -len(values) % width
    rows = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:count], ahead[width - 1 : width - 1 + count])


class Segments:
    """The segments of a block of texts, in the order of the texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
        self.text = self.start = self.size = self.key = self.content = self.anchor = np.empty(0, np.int64)
        if len(data) < length:
            return
        prefix = prefix_hashes(BYTE_VALUES[data])
        places = np.arange(len(data) - gram + 1)
        grams = mix(span_hashes(prefix, places, places + gram))
        least = _sliding_min((grams & ~_PLACE) | (places.astype(np.uint64) & _PLACE), length - gram + 1)
        windows = np.maximum(np.diff(offsets) - length + 1, 0)
        text = np.repeat(np.arange(len(windows)), windows)
        if not len(text):
            return
        at = offsets[text] + np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
        chosen = (least[at] & _PLACE).astype(np.int64)
        anchor = at + ((chosen - at) & int(_PLACE))  # places are known by their low bits only
        first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
        last = np.r_[first[1:], len(at)] - 1
        self.text, self.start, self.anchor = text[first], at[first], anchor[first] - at[first]
        self.size = at[last] + length - self.start
        self.key = signed(grams[anchor[first]])
        whole = span_hashes(prefix, self.start, self.start + self.size)
        shape = (self.size.astype(np.uint64) << np.uint64(32)) + self.anchor.astype(np.uint64)
        self.content = signed(mix(whole + mix(shape)))


def _packed(slots: pa.Table) -> pa.Table:
    """One block of the bitmap from the slots that are set in it."""
    slot = slots.column("slot").to_numpy()
    bits = np.zeros(_BLOCK_SLOTS, bool)
    bits[slot % _BLOCK_SLOTS] = True
    return pa.table([pa.array([int(slot[0]) // _BLOCK_SLOTS]), pa.array([np.packbits(bits).tobytes()])], ["block", "bits"])


def _bitmap(keys: DataFrame) -> bytes:
    """The low bits of the keys as a map; its blocks are packed by many tasks, and all are four MiB at most."""
    slots = keys.select(F.col("key").bitwiseAND(BITMAP_BITS - 1).alias("slot")).distinct()
    blocks_ = slots.withColumn("block", F.floor(F.col("slot") / _BLOCK_SLOTS))
    packed = blocks_.groupBy("block").applyInArrow(_packed, "block long, bits binary")
    held = np.zeros((BITMAP_BITS // _BLOCK_SLOTS, _BLOCK_SLOTS // 8), np.uint8)
    for row in packed.toLocalIterator():
        held[row.block] = np.frombuffer(row.bits, np.uint8)
    return held.tobytes()


def _places(length: int, gram: int):
    """All segments, without their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            data, offsets = utf8(batch.column("text"))
            found = Segments(data, offsets, length, gram)
            columns = [pa.array(x) for x in (found.key, found.content, found.start - offsets[found.text], found.size)]
            text_id = batch.column("text_id").take(pa.array(found.text))
            yield pa.RecordBatch.from_arrays([*columns, text_id], ["key", "content", "start", "size", "text_id"])

    return run


def _bytes(length: int, gram: int, bits: bytes):
    """Segments whose gram is in the map, which lets some others through, with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        for batch in blocks(batches):
            data, offsets = utf8(batch.column("text"))
            found = Segments(data, offsets, length, gram)
            use = np.flatnonzero(wanted[found.key & (BITMAP_BITS - 1)])
            cut = [data[a : a + n].tobytes() for a, n in zip(found.start[use], found.size[use])]
            columns = [pa.array(x[use]) for x in (found.key, found.content, found.anchor)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cut, pa.binary())], ["key", "content", "anchor", "bytes"])

    return run


class SuffixSort:
    """Sorts places of a text by the `length` bytes that follow, within buckets."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        self.prefix = prefix_hashes(BYTE_VALUES[data])
        self.down = powers(len(self.prefix))[1]
        padded = np.r_[data, np.zeros(8, np.uint8)]
        heads = np.ndarray((len(data),), ">u8", padded, strides=(1,)).astype(np.uint64)
        self.heads = heads >> np.uint64(8 * max(8 - length, 0))  # up to eight bytes as one number

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """How many bytes agree after places p and q, `length` at most: binary search over hashes."""
        prefix = self.prefix

        def equal(at: np.ndarray, size: int | np.ndarray) -> np.ndarray:
            own, other = ((prefix[x[at] + size] - base[at]) * scale[at] for x, base, scale in sides)
            return own == other

        sides = [(x, prefix[x], self.down[x]) for x in (p, q)]
        low = np.full(len(p), self.length, np.int64)
        left = np.flatnonzero(~equal(np.arange(len(p)), self.length))
        lo, hi = np.zeros(len(left), np.int64), np.full(len(left), self.length - 1, np.int64)
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = equal(left, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        low[left] = lo
        return low

    def after(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether the suffix at p comes after the one at q; hashes are asked where the first bytes agree."""
        mine, theirs = self.heads[p], self.heads[q]
        out = mine > theirs
        tied = np.flatnonzero(mine == theirs)
        p, q = p[tied], q[tied]
        common = self.common(p, q)
        at = np.minimum(common, self.length - 1)
        out[tied] = (common < self.length) & (self.data[p + at] > self.data[q + at])
        return out

    def sorted(self, place: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """`place`, whose buckets lie together, sorted within each: runs of 1, 2, 4, ... are merged."""
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        sizes = np.diff(np.r_[starts, len(place)])
        begin, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
        rank = np.arange(len(place)) - begin
        run = 1
        active = np.flatnonzero(size > run)
        while len(active):
            begin, size, rank = begin[active], size[active], rank[active]
            here = begin + rank
            mine = place[here]
            own = rank // run * run  # where the element's run begins
            pair = own // (2 * run) * (2 * run)
            right = own != pair
            other = np.where(right, pair, own + run)
            other_size = np.clip(size - other, 0, run)
            lo, hi = np.zeros(len(here), np.int64), other_size
            while True:  # how many of the other run come before; equal ones do if they stand on the left
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) // 2
                theirs = place[begin[open_] + other[open_] + mid]
                before = np.where(
                    right[open_], ~self.after(theirs, mine[open_]), self.after(mine[open_], theirs)
                )
                lo[open_] = np.where(before, mid + 1, lo[open_])
                hi[open_] = np.where(before, hi[open_], mid)
            to = begin + pair + (rank - own) + lo
            merged = place.copy()
            merged[to] = mine
            place = merged
            run *= 2
            active = np.flatnonzero(size > run)
        return place

    def repeated(self, place: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Places whose `length` bytes another place of the bucket has too."""
        order = np.argsort(bucket, kind="stable")
        place, bucket = place[order], bucket[order]
        place = self.sorted(place, bucket)
        near = np.flatnonzero(bucket[1:] == bucket[:-1])
        near = near[self.common(place[near], place[near + 1]) == self.length]
        equal = np.ones(len(near), bool)
        strings = np.lib.stride_tricks.sliding_window_view(self.data, self.length)
        for i in range(0, len(near), 1 << 15):
            some = near[i : i + (1 << 15)]
            equal[i : i + (1 << 15)] = (strings[place[some]] == strings[place[some + 1]]).all(axis=1)
        misled = np.unique(bucket[near[~equal]])
        near = near[equal & ~np.isin(bucket[near], misled)]
        found = [place[near], place[near + 1]]
        for b in misled.tolist():  # two strings share a hash: by the bytes themselves
            here = place[bucket == b]
            strings = [self.data[p : p + self.length].tobytes() for p in here]
            count = Counter(strings)
            found.append(here[[count[s] > 1 for s in strings]])
        return np.unique(np.concatenate(found))


def _covered(starts: np.ndarray, whose: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes that windows beginning at sorted `starts` cover, as maximal runs of one owner: owner, start, end."""
    first = np.ones(len(starts), bool)
    first[1:] = (np.diff(starts) > length) | (whose[1:] != whose[:-1])
    last = np.r_[first[1:], True][: len(starts)]
    return whose[first], starts[first], starts[last] + length


def _sort_variants(length: int):
    """Of variants sorted by gram: which of their bytes are repeated, as (key, content, spans)."""
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def solve(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        data, offsets = utf8(rows.column("bytes").combine_chunks())
        key, anchor = rows.column("key").to_numpy(), rows.column("anchor").to_numpy()
        windows = np.diff(offsets) - length + 1
        owner = np.repeat(np.arange(len(rows)), windows)
        shift = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        group = np.cumsum(np.r_[0, key[1:] != key[:-1]])
        bucket = group[owner] * (length + 1) + anchor[owner] - shift
        found = SuffixSort(data, length).repeated(offsets[owner] + shift, bucket)
        whose = np.searchsorted(offsets, found, side="right") - 1
        several = rows.column("copies").to_numpy() > 1
        copied, single = np.flatnonzero(several), ~several[whose]
        whose, start, end = (
            np.concatenate(x)
            for x in zip(
                (copied, offsets[copied], offsets[copied + 1]), _covered(found[single], whose[single], length)
            )
        )
        order = np.argsort(whose, kind="stable")
        whose = whose[order]
        start, end = ((x[order] - offsets[whose]).astype(np.int32) for x in (start, end))
        ends = np.cumsum(np.bincount(whose, minlength=len(rows)))
        out = pa.ListArray.from_arrays(
            pa.array(np.r_[0, ends], pa.int32()), pa.StructArray.from_arrays([start, end], ["start", "end"])
        )
        columns = [rows.column("key").combine_chunks(), rows.column("content").combine_chunks(), out.cast(spans)]
        return pa.RecordBatch.from_arrays(columns, ["key", "content", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in blocks(batches, "bytes", BLOCK_BYTES // 8):
            key = batch.column("key").to_numpy()
            if size > BLOCK_BYTES:  # solve what is complete
                rest = int(np.argmax(key != key[0])) if (key != key[0]).any() else len(key)
                if held[-1].column("key")[-1].as_py() != key[0]:
                    rest = 0
                if rest < len(key):
                    yield solve(pa.Table.from_batches([*held, batch.slice(0, rest)]))
                    held, size, batch = [], 0, batch.slice(rest)
            held.append(batch)
            size += pc.sum(pc.binary_length(batch.column("bytes"))).as_py()
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        data, offsets = utf8(batch.column("text"))
        kept, removed, runs = [], [], []
        for i, spans in enumerate(batch.column("spans")):
            text = data[offsets[i] : offsets[i + 1]]
            if spans.is_valid and len(spans.values):
                start, end = (spans.values.field(c).to_numpy().astype(np.int64) for c in ("start", "end"))
                depth = np.zeros(len(text) + 1, np.int64)
                np.add.at(depth, start, 1)
                np.add.at(depth, end, -1)
                gone = np.cumsum(depth[:-1]) > 0
            else:
                gone = np.zeros(len(text), bool)
            kept.append(text[~gone].tobytes())
            removed.append(int(gone.sum()))
            runs.append(int((gone & ~np.r_[False, gone[:-1]]).sum()))
        rest = [c for c in batch.schema.names if c not in ("text", "spans")]
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(c) for c in rest],
                pa.array(kept, pa.binary()),
                pa.array(np.diff(offsets)),
                pa.array(removed, pa.int64()),
                pa.array(runs, pa.int64()),
            ],
            [*rest, "kept", "n_bytes", "n_removed", "n_spans"],
        )


def _window_rows(length: int):
    """Each window of a variant with two hashes of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "bytes"):
            data, offsets = utf8(batch.column("bytes"))
            windows = np.diff(offsets) - length + 1
            owner = np.repeat(np.arange(len(windows)), windows)
            start = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
            at = offsets[owner] + start
            ids = [span_hashes(prefix_hashes(v[data]), at, at + length) for v in (BYTE_VALUES, mix(BYTE_VALUES))]
            rest = batch.select(["key", "content", "copies"]).take(pa.array(owner))
            columns = [*rest.columns, pa.array(start), *(pa.array(signed(mix(x))) for x in ids)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "content", "copies", "start", "first_id", "second_id"])

    return run


def _spread_spans(variants: DataFrame, length: int) -> DataFrame:
    """Repeated windows of variants under a gram that has too many of them for one task to sort.

    Every window is counted by 128 bits of hash, summed up before the rows are dealt; a window that
    very many variants share is then joined back by sorting, where Spark splits the hot key.
    """
    ids = ["first_id", "second_id"]
    rows = variants.select("key", "content", "copies", "bytes").mapInArrow(
        _window_rows(length), "key long, content long, copies long, start long, first_id long, second_id long"
    )
    rows = materialise(rows, "windows")
    repeated = rows.groupBy(*ids).agg(F.sum("copies").alias("times")).where("times > 1")
    span = F.struct(F.col("start").cast("int").alias("start"), (F.col("start") + length).cast("int").alias("end"))
    return rows.join(repeated, ids).groupBy("key", "content").agg(F.collect_list(span).alias("spans"))


def repeated_spans(texts: DataFrame, length: int = 200, gram: int = GRAM) -> DataFrame:
    """(text_id, spans): for rows (text_id, text), the bytes to remove; spans may overlap.

    Equal texts must have the same text_id; a text without repeated bytes has no row.
    """
    places = "key long, content long, start long, size long, text_id binary"
    members = materialise(texts.mapInArrow(_places(length, gram), places), "segments")
    variants = members.groupBy("key", "content").agg(F.count("*").alias("copies"), F.first("size").alias("size"))
    variants = materialise(variants, "variants")
    grams = materialise(variants.groupBy("key").agg(F.count("*").alias("variants")).where("variants > 1"), "grams")
    # Bytes are wanted only under grams with several variants, once for each; so the texts are cut a second time.
    cut = texts.mapInArrow(_bytes(length, gram, _bitmap(grams)), "key long, content long, anchor long, bytes binary")
    held = cut.groupBy("key", "content").agg(
        F.count("*").alias("copies"), F.first("anchor").alias("anchor"), F.first("bytes").alias("bytes")
    )
    held = materialise(held, "variant-bytes")
    few = grams.where(F.col("variants") <= MOST_VARIANTS).select("key")
    sort = held.join(few, "key", "left_semi").repartition("key").sortWithinPartitions("key")
    sort = sort.select("key", "content", "copies", "anchor", "bytes")
    spans = "array<struct<start:int,end:int>>"
    found = sort.mapInArrow(_sort_variants(length), f"key long, content long, spans {spans}").where(F.size("spans") > 0)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("size").cast("int").alias("end"))).cast(spans)
    alone = variants.where("copies > 1").join(grams, "key", "left_anti").select("key", "content", whole.alias("spans"))
    many = held.join(grams.where(F.col("variants") > MOST_VARIANTS), "key", "left_semi")
    verdicts = materialise(found.unionAll(alone).unionAll(_spread_spans(many, length)), "verdicts")
    spread = members.select("key", "content", "text_id", "start").join(verdicts, ["key", "content"])
    placed = spread.select("text_id", "start", F.explode("spans").alias("span")).select(
        "text_id",
        (F.col("start") + F.col("span.start")).alias("start"),
        (F.col("start") + F.col("span.end")).alias("end"),
    )
    placed = placed.distinct()
    return placed.groupBy("text_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = GRAM) -> DataFrame:
    """A row for each row of `docs`: doc_id, kept (bytes), n_bytes, n_removed, n_spans.

    Every byte covered by a string of `length` bytes that starts anywhere else, in the same text or
    another, is removed; strings never cross texts and are judged on the input. n_spans counts the
    maximal runs removed. A null text is empty. Repeated rows repeat each other's strings. What is
    left may not be valid UTF-8, so it is binary. Other columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("text_id", F.unhex(F.md5("text")))
    spans = repeated_spans(rows.select("text_id", "text"), length, gram)
    joined = rows.join(spans, "text_id", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_remove, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
