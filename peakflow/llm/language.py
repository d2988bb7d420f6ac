"""Language identification by a conditional random field over the words of a text.

Every run of letters is a word and gets a distribution over languages: features of the word (its
affixes, its letter pairs, itself as an entry of the lexicon) and learned transitions between
neighbours go through forward-backward, so words of a code-switched text can differ. A text's
language is the one with the largest share of its letters.

The model is fitted on a bounded sample of labelled rows; pieces of documents in different languages
are strung together, so that moves between languages are learned too.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakflow.llm.arrow_text import blocks, mix, prefix_hashes, span_hashes
from peakflow.llm.crf import posteriors

TABLE_BITS = 17
UNKNOWN = "und"
_DRAW = 1 << 30
_TABLES: list[np.ndarray] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point whether it is a letter, and whether it belongs to words: marks do, but make none."""
    if not _TABLES:
        codes = np.r_[np.arange(0xD800), np.arange(0xE000, 0x110000)]
        every = "".join(map(chr, codes.tolist()))
        for pattern in (r"\p{L}+", r"[\p{L}\p{M}]+"):
            table = np.zeros(0x110000, bool)
            for m in regex.finditer(pattern, every):
                table[codes[m.start() : m.end()]] = True
            _TABLES.append(table)
    return _TABLES[0], _TABLES[1]


@dataclass
class Words:
    """The words of a block: distinct ones by their spans in `points`, and the sequence of all."""

    points: np.ndarray
    start: np.ndarray  # of distinct words
    end: np.ndarray
    codes: np.ndarray  # of all words: which distinct word
    first: np.ndarray  # for each text the number of its first word, one entry more


def split_words(texts: pa.Array) -> Words:
    import pandas as pd

    texts = pc.utf8_lower(pc.fill_null(texts, ""))
    points = np.frombuffer("\n".join([*texts.to_pylist(), ""]).encode("utf-32-le", "replace"), np.uint32)
    ends = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    letter, inside = (table[points] for table in _letters())
    turns = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    start, end = turns[::2], turns[1::2]
    letters = np.r_[0, np.cumsum(letter)]
    word = letters[end] > letters[start]  # marks alone are none
    start, end = start[word], end[word]
    prefix = prefix_hashes(mix(points.astype(np.uint64) + np.uint64(1)))
    codes, distinct = pd.factorize(mix(span_hashes(prefix, start, end) + (end - start).astype(np.uint64)))
    one = np.empty(len(distinct), np.int64)
    one[codes[::-1]] = np.arange(len(codes))[::-1]
    return Words(points, start[one], end[one], codes, np.searchsorted(start, np.r_[0, ends]))


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the features of each distinct word in a row, and whose they are (sorted)."""
    points, start, end = words.points, words.start, words.end
    prefix = prefix_hashes(mix(points.astype(np.uint64) + np.uint64(1)))
    size = end - start
    slots, owner = [], []

    def add(kind: int, hashes: np.ndarray, of: np.ndarray) -> None:
        slots.append((mix(hashes + np.uint64(kind * 0x9E3779B1)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64))
        owner.append(of)

    every = np.arange(len(start))
    add(1, span_hashes(prefix, start, end), every)  # the lexicon
    for n in (1, 2, 3):
        long = every[size >= n]
        add(10 + n, span_hashes(prefix, start[long], start[long] + n), long)
        add(20 + n, span_hashes(prefix, end[long] - n, end[long]), long)
    pairs = np.maximum(size - 1, 0)
    of = np.repeat(every, pairs)
    at = start[of] + np.arange(len(of)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    add(30, span_hashes(prefix, at, at + 2), of)
    slots, owner = np.concatenate(slots), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return slots[order], owner[order]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # feature slot x language
    moves: np.ndarray
    opens: np.ndarray

    def scores(self, words: Words) -> np.ndarray:
        """Of each distinct word and language."""
        slots, owner = features(words)
        if not len(words.start):
            return np.zeros((0, len(self.languages)), np.float32)
        begins = np.searchsorted(owner, np.arange(len(words.start)))
        return np.add.reduceat(self.weights[slots], begins, axis=0)

    def _letters(self, texts: pa.Array) -> np.ndarray:
        """Of each text the letters that each language holds, and at last those the best language of each word holds."""
        words = split_words(texts)
        if not self.languages or not len(words.codes):
            return np.zeros((len(words.first) - 1, len(self.languages) + 1))
        begins = np.zeros(len(words.codes), bool)
        begins[words.first[:-1][words.first[:-1] < len(words.codes)]] = True
        probability, _, _ = posteriors(self.scores(words)[words.codes], begins, self.moves, self.opens)
        letters = (words.end - words.start)[words.codes]
        held = np.concatenate([probability, probability.max(axis=1, keepdims=True)], axis=1) * letters[:, None]
        sums = np.concatenate([np.zeros((1, held.shape[1])), np.cumsum(held, axis=0, dtype=float)])
        return sums[words.first[1:]] - sums[words.first[:-1]]

    def fit_of(self, texts: pa.Array) -> np.ndarray:
        """How well the words of each text fit any of the languages: the share of its letters that lie in words of
        one, whichever that is. Texts of several languages have a high one; 0 without a letter."""
        held = self._letters(texts)
        total = held[:, :-1].sum(axis=1)
        return np.clip(np.where(total > 0, held[:, -1] / np.maximum(total, 1e-30), 0.0), 0, 1)

    def label(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language of each text and the share of its letters that it holds."""
        share = self._letters(texts)[:, :-1]
        total = share.sum(axis=1)
        if not self.languages:
            return [UNKNOWN] * len(share), np.zeros(len(share))
        best = share.argmax(axis=1)
        score = np.where(total > 0, share.max(axis=1) / np.maximum(total, 1e-30), 0.0)
        return [self.languages[b] if t > 0 else UNKNOWN for b, t in zip(best, total)], np.clip(score, 0, 1)


def fit(
    rows: list[tuple[str, str]], epochs: int = 30, rate: float = 0.15, decay: float = 1e-4, seed: int = 7
) -> Model:
    """Maximise the likelihood of the labels of (language, text) rows by full-batch adaptive steps."""
    languages = sorted({lang for lang, _ in rows})
    number = {lang: i for i, lang in enumerate(languages)}
    k = len(languages)
    model = Model(languages, np.zeros((1 << TABLE_BITS, k), np.float32), np.zeros((k, k), np.float32), np.zeros(k, np.float32))
    words = split_words(pa.array([text for _, text in rows], pa.string()))
    rng = np.random.default_rng(seed)
    pieces = []
    for i, (lang, _) in enumerate(rows):
        at = words.first[i]
        while at < words.first[i + 1]:
            stop = min(at + int(rng.integers(5, 40)), words.first[i + 1])
            pieces.append((at, stop, number[lang]))
            at = stop
    if not pieces:
        return model
    pieces = [pieces[i] for i in rng.permutation(len(pieces))]
    codes = np.concatenate([words.codes[a:z] for a, z, _ in pieces])
    truth = np.repeat([y for _, _, y in pieces], [z - a for a, z, _ in pieces])
    begins = np.zeros(len(codes), bool)
    begins[np.cumsum([0] + [z - a for a, z, _ in pieces])[:-1:8]] = True  # eight pieces to a sequence
    slots, owner = features(words)
    bounds = np.searchsorted(owner, np.arange(len(words.start)))
    seen = np.zeros((k, k))
    inside = np.flatnonzero(~begins)
    np.add.at(seen, (truth[inside - 1], truth[inside]), 1)
    opened = np.bincount(truth[begins], minlength=k)
    observed = np.zeros((len(words.start), k))
    np.add.at(observed, (codes, truth), 1)
    squares = [np.full_like(x, 1e-8) for x in (model.weights, model.moves, model.opens)]
    for _ in range(epochs):
        emit = np.add.reduceat(model.weights[slots], bounds, axis=0)
        probability, moved, first = posteriors(emit[codes], begins, model.moves, model.opens)
        expected = np.stack([np.bincount(codes, probability[:, y], len(words.start)) for y in range(k)], axis=1)
        gap = (observed - expected)[owner]
        slope = np.stack([np.bincount(slots, gap[:, y], 1 << TABLE_BITS) for y in range(k)], axis=1)
        steps = (slope - decay * len(codes) / k * model.weights, seen - moved, opened - first)
        for value, step, square in zip((model.weights, model.moves, model.opens), steps, squares):
            square += step**2
            value += rate * step / np.sqrt(square)
    return model


def held_out(modulus: int = 4, remainder: int = 2) -> Column:
    """Whether a row is kept from training; a null doc_id counts as an empty text."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return (F.crc32(name) % modulus) == remainder


def _windows(most_words: int, most_points: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = []
            for text, draw in zip(batch.column("text").to_pylist(), batch.column("draw").to_pylist()):
                tokens = text.split()
                at = draw % max(len(tokens) - most_words + 1, 1)
                window = " ".join(tokens[at : at + most_words])
                at = draw % max(len(window) - most_points + 1, 1)
                cut.append(window[at : at + most_points])
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("draw"), pa.array(cut, pa.string())], ["lang", "draw", "text"]
            )

    return run


def train(
    docs: DataFrame, per_language: int = 250, words_per_document: int = 300, points_per_document: int = 6000, **options
) -> Model:
    """Fit on at most `per_language` rows of each language, and a window of each row's words.

    Rows are drawn by a hash of doc_id and text among those with a language and a text that are not
    held out; of equal draws the smaller windows go first. A window lies anywhere in its text and has
    at most `words_per_document` words between white space and `points_per_document` code points, so
    that a text without spaces is no larger. This sample is the only thing collected.
    """
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    draw = F.pmod(F.xxhash64(F.lit("fit"), "doc_id", "text"), F.lit(_DRAW))
    below = F.lit(0)
    for lang, n in counts.items():
        cut = int(_DRAW * min(1.0, 1.2 * per_language / n))
        below = F.when(F.col("lang") == lang, cut).otherwise(below)
    drawn = known.select("lang", "text", draw.alias("draw")).where(F.col("draw") < below)
    drawn = drawn.mapInArrow(
        _windows(words_per_document, points_per_document), "lang string, draw long, text string"
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))
    drawn = drawn.withColumn("place", place).where(F.col("place") <= per_language)
    rows = sorted((r.lang, r.draw, r.text) for r in drawn.collect())
    return fit([(lang, text) for lang, _, text in rows], **options)


def _label_rows(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            names, scores = model.label(batch.column("text"))
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in rest], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                [*rest, "lang_pred", "score"],
            )

    return run


def identify(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """A row for each row of `docs`: the columns in `keep`, lang_pred and score.

    `score` is the share of the text's letters that the predicted language holds. Null texts, texts
    without a letter, and all texts when no row has a language, are `und` with score 0. Only the
    text goes into a prediction.
    """
    rows = docs.select(*keep, "text")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(_label_rows(model), f"{kept}, lang_pred string, score double")


def _accept_rows(model: Model, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            fit = model.fit_of(batch.column("text"))
            yield batch.filter(pa.array((fit > 0) & (fit >= least), pa.bool_()))

    return run


def accepted(docs: DataFrame, model: Model, least_score: float = 0.5) -> DataFrame:
    """The rows of `docs` whose words fit known languages, one or several, with at least `least_score`."""
    return docs.mapInArrow(_accept_rows(model, least_score), docs.schema)
