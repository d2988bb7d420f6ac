"""Ranked lexical search by NRA over impact-sorted lists of blocks of documents.

The documents are read once into rows of (number of terms, the query terms among them). When the
totals of the corpus are known, each block of documents is turned into one list per term, the largest
impact first, and every item reads its lists side by side, never at random: what it has read of a
document is the lower end of the document's score, and that plus the last impact read from each list
in which the document has not been met is the upper end. Reading goes on until the best documents are
known, every tie among them is settled, and their two ends are one. A task carries the best of the
blocks it has seen along as a floor, and the best of all tasks are the result.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from peakflow.llm.arrow_text import blocks
from peakflow.session import materialise

ITEM_CHARS = 1 << 20
BLOCK_POSTINGS = 1 << 22
FIRST_STEP = 256
_NO_ID = 1 << 63  # larger than any doc_id: a document without one stands last among equals

# Every byte that is no part of a term becomes a space; A-Z become a-z. Bytes from 128 on belong to letters.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms(text: str | bytes | None) -> list[bytes]:
    if text is None:
        return []
    return (text if isinstance(text, bytes) else text.encode()).translate(_TERM_BYTES).split()


def _indexing(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            lengths, offsets, held, times = [], [0], [], []
            for text in batch.column("text").cast(pa.large_binary()).to_pylist():
                found = terms(text)
                own = Counter(map(vocabulary.get, found))
                own.pop(None, None)
                lengths.append(len(found))
                held.extend(own)
                times.extend(own.values())
                offsets.append(len(held))
            lists = (pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32())) for x in (held, times))
            columns = [batch.column("doc_id"), pa.array(lengths, pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "times"])

    return run


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms of the whole text), and the terms of the vocabulary in it with how often each occurs."""
    return docs.select("doc_id", "text").mapInArrow(
        _indexing(vocabulary), "doc_id long, n long, terms array<int>, times array<int>"
    )


def weights(df: Sequence[int], documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * f + 1))) for f in df], np.int64)


class Lists:
    """The impact-sorted lists of one block of documents."""

    def __init__(self, batch: pa.RecordBatch, weight: np.ndarray, documents: int, total: int):
        lengths = batch.column("n").to_pylist()
        damping = np.array([25 + 75 * n * documents // total for n in lengths], np.int64)  # exact whatever the sizes
        held, times = batch.column("terms"), batch.column("times")
        row = np.repeat(np.arange(batch.num_rows), np.diff(held.offsets.to_numpy()))
        term, tf = held.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * damping[row]))
        order = np.lexsort((row, -impact, term))
        self.rows, self.impacts = row[order], impact[order]
        self.starts = np.searchsorted(term[order], np.arange(len(weight) + 1))
        self.ids = [-_NO_ID if x is None else -x for x in batch.column("doc_id").to_pylist()]
        self.count = batch.num_rows

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        span = slice(self.starts[term], self.starts[term + 1])
        return self.rows[span], self.impacts[span]


def best_of_block(
    lists: Lists, item: Sequence[tuple[int, int]], k: int, best: list[tuple[int, int]] = (), first_step: int = FIRST_STEP
) -> list[tuple[int, int]]:
    """The `k` best (score, -doc_id) of an item's earlier best and of a block, largest first.

    `item` holds its terms with their number. Each round reads on in all lists, twice as far as the
    round before. A document may still matter if its upper end reaches the k-th best lower end, and
    one not yet met has the last impacts of all lists as its upper end. The block is done when all
    that may matter have equal ends, so that scores and ties are final.
    """
    own = [(rows, impacts * times) for rows, impacts, times in ((*lists.of(t), q) for t, q in item) if len(rows)]
    if not own:
        return list(best)
    lower = np.zeros(lists.count, np.int64)
    unread = np.ones((len(own), lists.count))  # 1 where the list may still hold the document
    last = np.zeros(len(own))
    earlier = np.array([score for score, _ in best], np.int64)
    read, step = 0, first_step
    while True:
        for i, (rows, impacts) in enumerate(own):
            if read < len(rows):
                span = slice(read, read + step)
                lower[rows[span]] += impacts[span]
                unread[i, rows[span]] = 0
                last[i] = impacts[read + step - 1] if read + step < len(rows) else 0
        read, step = read + step, 2 * step
        known = np.concatenate([lower, earlier])
        kth = int(np.partition(known, -k)[-k]) if len(known) >= k else 0
        still = last @ unread  # whole numbers below 2^53, so the sums are exact
        may = lower + still >= max(kth, 1)  # a score of 0 is no hit
        if not still[may].any():
            break
    hits = [(int(lower[r]), lists.ids[r]) for r in np.flatnonzero(may)]
    return heapq.nlargest(k, [*best, *hits])


def _ranking(items: list[list[tuple[int, int]]], weight: np.ndarray, documents: int, total: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        for batch in batches:
            for block in _cut(batch):
                lists = Lists(block, weight, documents, total)
                for i, item in enumerate(items):
                    best[i] = best_of_block(lists, item, k, best[i])
        rows = [(i, -doc, score) for i, own in enumerate(best) for score, doc in own]
        place, doc, score = zip(*rows, strict=True) if rows else ((), (), ())
        ids = pa.array([None if d == _NO_ID else d for d in doc], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), ids, pa.array(score, pa.int64())], ["place", "doc_id", "score"])

    return run


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Blocks of at most `BLOCK_POSTINGS` postings, or of one document."""
    ends = np.cumsum([len(x) for x in batch.column("terms")]) if batch.num_rows else []
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        after = max(int(np.searchsorted(ends, before + BLOCK_POSTINGS, side="right")), first + 1)
        block = batch.slice(first, after - first)
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in block.columns], block.schema.names)
        first = after


def _search_block(items: list[Row], docs: DataFrame, k: int) -> DataFrame:
    """The result for items that fit into memory; `docs` is read whole."""
    found = [Counter(terms(item.text)) for item in items]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*found)))}
    index = materialise(forward_index(docs, vocabulary), "forward-index")
    totals = index.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("terms")).first()
    holding = [0] * len(vocabulary)
    for r in index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toLocalIterator():
        holding[r.term] = r.df
    asked = [[(vocabulary[t], q) for t, q in own.items()] for own in found]
    run = _ranking(asked, weights(holding, totals.documents or 0), totals.documents or 0, totals.terms or 1, k)
    hits = index.where("n > 0").mapInArrow(run, "place int, doc_id long, score long")
    order = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = docs.sparkSession.createDataFrame([(i, item.item_id) for i, item in enumerate(items)], "place int, item_id long")
    # A block of items has a bounded number of them: an empty text counts as one character.
    return ranked.join(F.broadcast(names), "place").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The `k` best documents for each row of `items`: item_id, rank, doc_id, score.

    Scores are whole numbers above 0; equal ones go by doc_id, null last. Every row of `docs` is a
    document of its own, and rows that repeat a doc_id are ranked each. An item without terms, or of
    terms found nowhere, has no row; rows of `items` that repeat an item_id, or have none, are searched
    each. Items go through in blocks of 2^20 characters, and for each block all documents are read.
    Other columns are ignored.
    """
    done, block, size = [], [], 0
    for item in items.select("item_id", "text").toLocalIterator():
        own = max(len(item.text or ""), 1)
        if block and size + own > ITEM_CHARS:
            done.append(materialise(_search_block(block, docs, k), "search"))
            block, size = [], 0
        block.append(item)
        size += own
    return reduce(DataFrame.unionAll, [*done, _search_block(block, docs, k)])
