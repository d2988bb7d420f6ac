"""N-gram Jaccard join by PartEnum signatures.

A document is its set of distinct word shingles. Sets are put into bands of size. Within a band,
two sets of Jaccard similarity t or more differ in at most k elements, so when the domain of
shingles is cut into more than k parts, at least one part holds the same elements of both. Each set
therefore gets one signature per part: the hash of what it has there. Sets that share no signature
are never compared.

An empty part says nothing, so its signature is left out. That is safe when a set has fewer empty
parts than any partner must share with it; the few other sets give the signatures of their empty
parts too.

Sets that share a signature are linked in two steps, so that a family of copies never becomes all
its pairs. First every member is compared with the smallest member of its signature, and the links
found are joined to components. Then members of one signature that still lie in different
components are compared, in cells of bounded size, and first by parity sketches: an element that
only one set has flips one bit, so two sketches never differ in more bits than the sets differ in
elements. What passes is compared exactly on the sets.

Sets and shingles are held as 64-bit hashes; equal sets (same size and hash) are one class.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakflow.llm.arrow_text import blocks, mix, signed
from peakflow.llm.graph import components
from peakflow.llm.shingles import set_ids, shingle_sets
from peakflow.session import materialise

BAND_RATIO = 1.6
LEAST_BITS = 512
CELL_ROWS = 4096
TASKS_OF_A_HEAD = 4
_PAIRS_IN_MIND = 1_000_000
_BITMAP_BITS = 1 << 23
_SHARED = ["signature", "set_id", "head", "place"]


def _bands() -> np.ndarray:
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, int(edges[-1] * BAND_RATIO)))
    return np.array(edges, np.int64)


class PartEnum:
    """Signatures for a threshold given as a ratio of whole numbers, such as 80 / 100."""

    def __init__(self, threshold: Fraction):
        self.threshold = threshold
        self.edges = _bands()
        largest = (self.edges[1:] - 1).tolist()
        # The smaller set of a pair has n elements, the larger at most n / t; they differ in n (1 - t) / t at most.
        self.most = np.array([int(n * (1 - threshold) / threshold) for n in largest], np.int64)
        k = self.most + 1
        self.parts = (np.ceil(1.07 * k + 0.5 * np.sqrt(k)) + 1).astype(np.int64)

    def signatures(self, sets: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signatures and the number of the set each belongs to."""
        sizes = np.diff(begins)
        own = np.searchsorted(self.edges, sizes, side="right") - 1
        t = self.threshold
        reach = np.array([int((n - 1) / t) for n in self.edges.tolist()], np.int64)  # of the band below an edge
        below = (own >= 1) & (sizes <= reach[np.maximum(own, 0)])
        found = [self._in_band(sets, begins, own, sizes > 0), self._in_band(sets, begins, own - 1, below)]
        return tuple(np.concatenate(x) for x in zip(*found))

    def _in_band(self, sets, begins, band, chosen) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.diff(begins)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        use = chosen[owner]
        owner, elements = owner[use], sets[use]
        if not len(owner):
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        parts = self.parts[np.maximum(band, 0)].astype(np.uint64)
        part = ((elements >> np.uint64(32)) * parts[owner]) >> np.uint64(32)
        starts = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])])
        content = np.add.reduceat(mix(elements), starts)
        at = owner[starts]
        found = _signature(content, part[starts], band[at])
        filled = np.bincount(at, minlength=len(sizes))
        t = self.threshold
        allowed = np.minimum(self.most[np.maximum(band, 0)], (sizes * (t.denominator - t.numerator)) // t.numerator)
        more_s, more_o = [found], [at]
        for i in np.flatnonzero(chosen & (filled <= allowed)):  # as many empty parts as a partner shares, or more
            empty = np.setdiff1d(np.arange(self.parts[band[i]], dtype=np.uint64), part[starts][at == i])
            more_s.append(_signature(np.zeros(len(empty), np.uint64), empty, np.full(len(empty), band[i])))
            more_o.append(np.full(len(empty), i))
        return np.concatenate(more_s), np.concatenate(more_o)


def _signature(content: np.ndarray, part: np.ndarray, band: np.ndarray) -> np.ndarray:
    place = mix(part + band.astype(np.uint64) * np.uint64(1 << 40) + np.uint64(1))
    return mix(content + place)


def sketches(sets: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parity of each set's elements by bin, packed in a row, and where each sketch begins.

    A set has twice as many bins as elements, rounded up to a power of two and at least LEAST_BITS.
    """
    sizes = np.diff(begins)
    bits = np.maximum(1 << np.ceil(np.log2(np.maximum(2 * sizes, 1))).astype(np.int64), LEAST_BITS)
    starts = np.concatenate([[0], np.cumsum(bits)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    bins = starts[owner] + (sets & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(bins, minlength=starts[-1]) & 1
    return np.packbits(odd.astype(np.uint8)), starts // 8


def sketch_difference(data: np.ndarray, starts: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits sketches x and y differ; the longer one is folded to the length of the other."""
    out = np.zeros(len(x), np.int64)
    size = np.diff(starts)
    swap = size[x] > size[y]
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    for short, long in sorted(set(zip(size[x].tolist(), size[y].tolist()))):
        these = np.flatnonzero((size[x] == short) & (size[y] == long))
        step = max((1 << 22) // long, 1)
        for i in range(0, len(these), step):
            some = these[i : i + step]
            a = data[starts[x[some]][:, None] + np.arange(short)].view(np.uint64)
            b = data[starts[y[some]][:, None] + np.arange(long)].view(np.uint64)
            b = np.bitwise_xor.reduce(b.reshape(len(some), long // short, short // 8), axis=1)
            out[some] = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return out


def _set_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            sets, begins = shingle_sets(batch, size)
            packed, starts = sketches(sets, begins)
            sketch = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(packed)]
            ).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array(np.diff(begins)),
                    pa.array(signed(set_ids(sets, begins))),
                    sketch,
                ],
                ["doc_id", "text_key", "n_shingles", "set_id", "sketch"],
            )

    return run


def _signature_rows(size: int, threshold: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule, seen = PartEnum(threshold), set()
        for batch in blocks(batches):
            sets, begins = shingle_sets(batch, size)
            ids = set_ids(sets, begins)
            new = np.zeros(len(ids), bool)
            for i, x in enumerate(ids.tolist()):  # copies within a task give their signatures once
                new[i] = x not in seen
                seen.add(x)
            if len(seen) > 1_000_000:
                seen.clear()
            use = np.repeat(new, np.diff(begins))
            kept = np.concatenate([[0], np.cumsum(np.diff(begins)[new])])
            found, owner = rule.signatures(sets[use], kept)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(found)), pa.array(signed(ids[new][owner]))], ["signature", "set_id"]
            )

    return run


def _shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by signature and set, once each, those whose signature another set has too.

    Adds the smallest set of the signature (`head`) and the place of the row, from 0 for the head.
    Only one row is held back at a time, however many share a signature.
    """
    held = np.empty((4, 0), np.int64)
    for batch in batches:
        new = np.zeros((4, batch.num_rows), np.int64)
        new[0], new[1] = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        rows = np.concatenate([held, new], axis=1)
        rows = rows[:, np.r_[True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)][: rows.shape[1]]]
        if not rows.shape[1]:
            continue
        same = rows[0, 1:] == rows[0, :-1]
        starts = np.flatnonzero(np.r_[True, ~same])
        sizes = np.diff(np.r_[starts, rows.shape[1]])
        head, place = rows[1, starts], np.zeros(len(starts), np.int64)
        if held.shape[1]:  # the first group goes on from the row held back
            head[0], place[0] = held[2, 0], held[3, 0]
        rows[2] = np.repeat(head, sizes)
        rows[3] = np.arange(rows.shape[1]) - np.repeat(starts - place, sizes)
        shared = (rows[3] > 0) | np.r_[same, False]
        yield _shared_rows(rows[:, :-1][:, shared[:-1]])
        held = rows[:, -1:]
    if held.shape[1] and held[3, 0] > 0:
        yield _shared_rows(held)


def _shared_rows(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(r)) for r in rows], _SHARED)


def _may_link(size_a, size_b, differ, threshold: Fraction) -> np.ndarray:
    """Whether sets that differ in `differ` elements or more may reach the threshold.

    Sets that do differ in at most (1 - t) / (1 + t) of the sum of their sizes.
    """
    n, d = threshold.numerator, threshold.denominator
    return np.maximum(differ, np.abs(size_a - size_b)) * (d + n) <= (size_a + size_b) * (d - n)


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _pairs_in_cells(threshold: Fraction, best_only: bool):
    """Pairs of one cell, in different components, that sizes and sketches leave open.

    Rows come sorted by cell; row i is compared with row i + 1, i + 2, ... of its cell. With
    `best_only`, of all pairs that would join the same two components only the closest is given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = None, set()
        for batch in batches:
            rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            key = np.stack([rows.column(c).to_numpy() for c in ("signature", "low", "high")])
            if not len(rows):
                continue
            last = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])[-1]
            held = rows.slice(last)
            yield pairs(rows.slice(0, last), seen)
        if held is not None:
            yield pairs(held, seen)

    def pairs(rows: pa.Table, seen: set[tuple[int, int]]) -> pa.RecordBatch:
        found = []
        if len(rows) > 1:
            rows = rows.combine_chunks()
            key = np.stack([rows.column(c).to_numpy() for c in ("signature", "low", "high")])
            cell = np.cumsum(np.r_[0, (key[:, 1:] != key[:, :-1]).any(axis=0)])
            one_chunk = key[1] == key[2]
            ids, label, size, chunk = (rows.column(c).to_numpy() for c in ("set_id", "component", "n_shingles", "chunk"))
            data, starts = _binary(rows.column("sketch").combine_chunks())
            a = np.arange(len(ids) - 1)
            step = 1
            while len(a):
                a = a[a + step < len(ids)]
                a = a[cell[a] == cell[a + step]]
                b = a + step
                open_ = (label[a] != label[b]) & (one_chunk[a] | (chunk[a] != chunk[b]))
                open_ &= _may_link(size[a], size[b], 0, threshold)
                x, y = a[open_], b[open_]
                differ = sketch_difference(data, starts, x, y)
                ok = _may_link(size[x], size[y], differ, threshold)
                x, y, differ = x[ok], y[ok], differ[ok]
                low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
                share = differ / (size[x] + size[y])
                found.append(np.rec.fromarrays([low, high, share, ids[x], ids[y]], names="low,high,share,a,b"))
                step += 1
        both = np.empty((2, 0), np.int64)
        if found:
            all_ = np.concatenate(found)
            if best_only:
                all_ = all_[np.lexsort((all_["b"], all_["a"], all_["share"], all_["high"], all_["low"]))]
                same = (all_["low"][1:] == all_["low"][:-1]) & (all_["high"][1:] == all_["high"][:-1])
                all_ = all_[np.r_[True, ~same]] if len(all_) else all_
            both = np.unique(np.sort(np.stack([all_["a"], all_["b"]]), axis=0), axis=1)
            if len(seen) > _PAIRS_IN_MIND:
                seen.clear()
            new = [p not in seen for p in zip(*both.tolist())]
            both = both[:, np.array(new, bool)]
            seen.update(zip(*both.tolist()))
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    return run


def _passing(threshold: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size_a, size_b = batch.column("size_a").to_numpy(), batch.column("size_b").to_numpy()
            data, starts = _binary(pa.concat_arrays([batch.column("sketch_a"), batch.column("sketch_b")]))
            first = np.arange(batch.num_rows)
            ok = _may_link(size_a, size_b, sketch_difference(data, starts, first, first + batch.num_rows), threshold)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(_BITMAP_BITS, bool)
    for batch in batches:
        bits[batch.column(0).to_numpy() & (_BITMAP_BITS - 1)] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])


def _wanted_sets(size: int, bits: bytes):
    """Sets whose id may be wanted; the bitmap has a fixed size and lets some others through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool), set()
        for batch in blocks(batches):
            sets, begins = shingle_sets(batch, size)
            ids = signed(set_ids(sets, begins))
            take = []
            for i in np.flatnonzero(wanted[ids & (_BITMAP_BITS - 1)] & (np.diff(begins) > 0)).tolist():
                if ids[i] not in seen:
                    seen.add(ids[i])
                    take.append(i)
            if len(seen) > 1_000_000:
                seen.clear()
            held = [sets[begins[i] : begins[i + 1]].tobytes() for i in take]
            yield pa.RecordBatch.from_arrays([pa.array(ids[take]), pa.array(held, pa.binary())], ["set_id", "elements"])

    return run


def _linked(threshold: Fraction):
    n, d = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                ok.append(d * common >= n * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _verified(docs: DataFrame, pairs: DataFrame, size: int, threshold: Fraction) -> DataFrame:
    """The pairs (a, b) of set ids whose sets reach the threshold."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    maps = ids.coalesce(8).mapInArrow(_bitmap, "bits binary").collect()  # eight maps of one MiB at most
    none = np.zeros(_BITMAP_BITS // 8, np.uint8)
    bits = np.bitwise_or.reduce([none, *(np.frombuffer(m.bits, np.uint8) for m in maps)])
    sets = docs.select("text").mapInArrow(_wanted_sets(size, bits.tobytes()), "set_id long, elements binary")
    sets = materialise(sets.groupBy("set_id").agg(F.first("elements").alias("elements")), "sets")
    a = sets.select(F.col("set_id").alias("a"), F.col("elements").alias("set_a"))
    b = sets.select(F.col("set_id").alias("b"), F.col("elements").alias("set_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(
        _linked(threshold), "a long, b long"
    )


def _open_pairs(rows: DataFrame, facts: DataFrame, labels: DataFrame, threshold: Fraction, best_only: bool) -> DataFrame:
    """Pairs of sets that share a signature, lie in different components and may be linked."""
    placed = rows.join(labels, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    mixed = placed.groupBy("signature").agg(
        F.min("component").alias("_low"), F.max("component").alias("_high"), F.count("*").alias("members")
    )
    mixed = mixed.where("_low <> _high")
    mixed = materialise(mixed.select("signature", F.ceil(F.col("members") / CELL_ROWS).cast("int").alias("chunks")), "mixed")
    chunk = F.pmod(F.xxhash64("set_id"), F.col("chunks")).cast("int")
    open_rows = placed.join(mixed, "signature").withColumn("chunk", chunk).join(facts, "set_id")
    cells = open_rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "signature", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"),
        "set_id", "component", "n_shingles", "chunk", "sketch", "head",
    )
    # Signatures that similar sets share have mostly one head, so a pair meets itself in few tasks.
    near = F.pmod("signature", F.lit(TASKS_OF_A_HEAD))
    cells = cells.repartition("head", near, "low", "high").sortWithinPartitions("signature", "low", "high")
    pairs = cells.mapInArrow(_pairs_in_cells(threshold, best_only), "a long, b long")
    return materialise(pairs.distinct(), "open-pairs")


def _classes(docs: DataFrame, size: int, threshold: tuple[int, int]) -> DataFrame:
    """(doc_id, text_key, n_shingles, component) of every row of `docs`, with a component for each linked group."""
    share = Fraction(*threshold)
    docs = docs.select("doc_id", "text")
    info = materialise(
        docs.withColumn("text_key", F.xxhash64("text")).mapInArrow(
            _set_rows(size), "doc_id long, text_key long, n_shingles long, set_id long, sketch binary"
        ),
        "set-info",
    )
    signatures = docs.select("text").mapInArrow(_signature_rows(size, share), "signature long, set_id long")
    dealt = signatures.repartition("signature").sortWithinPartitions("signature", "set_id")
    rows = materialise(dealt.mapInArrow(_shared_only, ", ".join(f"{c} long" for c in _SHARED)), "shared")

    facts = info.where("n_shingles > 0").groupBy("set_id").agg(
        F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")
    )
    stars = rows.where("place > 0").select(F.col("head").alias("a"), F.col("set_id").alias("b"))

    def side(name: str) -> DataFrame:
        return facts.select(
            F.col("set_id").alias(name), F.col("n_shingles").alias(f"size_{name}"), F.col("sketch").alias(f"sketch_{name}")
        )

    described = stars.distinct().join(side("a"), "a").join(side("b"), "b")
    near = materialise(described.mapInArrow(_passing(share), "a long, b long"), "star-pairs")
    links = materialise(_verified(docs, near, size, share), "star-links")
    labels = components(links).withColumnRenamed("id", "set_id")

    # First the closest pair of any two components, then, where they are still apart, all their pairs.
    several = rows.where("place = 2").select("signature")  # of two sets, the smaller was the other's head
    rows = materialise(rows.drop("place").join(several, "signature", "left_semi"), "several")
    for best_only in (True, False):
        pairs = _open_pairs(rows, facts, labels, share, best_only)
        links = materialise(links.union(_verified(docs, pairs, size, share)), "links")
        labels = components(links).withColumnRenamed("id", "set_id")

    classes = info.select("doc_id", "text_key", "n_shingles", "set_id").join(labels, "set_id", "left")
    component = F.coalesce("component", "set_id").alias("component")
    return materialise(classes.select("doc_id", "text_key", "n_shingles", component), "classes")


def jaccard_components(docs: DataFrame, size: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """Link documents of shingle similarity `threshold` or more; a row for each row of `docs`.

    Gives doc_id, n_shingles (size of the set) and component_id (the smallest doc_id reachable by
    links, itself included). Null or wordless texts have no shingles, are linked with nothing and
    stand alone under their own doc_id. Rows with a null doc_id are linked like others; a component
    of such rows alone has a null id. Repeated rows give repeated rows. Other columns are ignored.
    """
    classes = _classes(docs, size, threshold)
    smallest = classes.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return classes.join(smallest, "component", "left").select("doc_id", "n_shingles", own.alias("component_id"))


def one_of_each_component(docs: DataFrame, size: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of `docs` without those that are linked to one that stays.

    Of linked rows one stays: that of the smallest doc_id (known ids before null) and, where it has
    several texts, of the smallest hash of the text. Rows are judged one by one, so texts of one
    doc_id may have different fates. Texts without words stay. Rows that repeat a doc_id and its
    text become one.
    """
    classes = _classes(docs, size, threshold)
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key")
    first = classes.where("n_shingles > 0").groupBy("component").agg(F.min(order).alias("first"))
    wordless = classes.where("n_shingles = 0").select("doc_id", "text_key").distinct()
    stay = first.select("first.doc_id", "first.text_key").unionAll(wordless).toDF("_stays", "_stays_key")
    rows = docs.withColumn("_text_key", F.xxhash64("text"))
    same = rows["doc_id"].eqNullSafe(stay["_stays"]) & (rows["_text_key"] == stay["_stays_key"])
    return rows.join(stay, same, "left_semi").dropDuplicates(["doc_id", "_text_key"]).select(*docs.columns)
