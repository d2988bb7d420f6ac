"""Fill-in-the-middle over texts kept as seekable compressed frames.

A text is stored as zstandard frames that stand alone, each with the number of units (code points)
before it. To move a span only the frames that hold its two cuts are opened; the frames between go to
the output as they are. The output is again a list of frames, and digests and texts are read from it
frame by frame, so nothing but one frame is ever decompressed at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakflow.llm.arrow_text import blocks

FRAME_UNITS = 1 << 14
P, S, M = "<P>", "<S>", "<M>"
_FRAMES = "frames array<struct<first:long,units:int,data:binary>>"
_FRAME = pa.struct([("first", pa.int64()), ("units", pa.int32()), ("data", pa.binary())])

# What stands in the output of a form: marks, and the parts of the text between them.
ORDER = {"psm": ((P, "prefix"), (S, "suffix"), (M, "middle")), "spm": ((S, "suffix"), (P, "prefix"), (M, "middle"))}


class FramedText:
    """A text as frames: where each begins, its units, and its compressed bytes."""

    def __init__(self, units: Iterable[int], data: list[bytes]):
        self.data = data
        self.bounds = np.concatenate([[0], np.cumsum(np.fromiter(units, np.int64))])

    def __len__(self) -> int:
        return int(self.bounds[-1])

    def opened(self, unzip: zstandard.ZstdDecompressor, start: int = 0, end: int | None = None) -> Iterator[str]:
        """The text from unit `start` to unit `end`, a frame at a time."""
        end = len(self) if end is None else end
        if start >= end:
            return
        for i in range(int(np.searchsorted(self.bounds, start, "right")) - 1, len(self.data)):
            first = int(self.bounds[i])
            if first >= end:
                return
            text = unzip.decompress(self.data[i]).decode()
            yield text[max(start - first, 0) : end - first]

    def span(self, tool: _Tool, start: int, end: int) -> Iterator[tuple[int, bytes]]:
        """The frames of a span: those inside it as they are, those that it cuts opened and cut."""
        at = start
        while at < end:
            i = int(np.searchsorted(self.bounds, at, "right")) - 1
            upto = min(int(self.bounds[i + 1]), end)
            if upto - at == self.bounds[i + 1] - self.bounds[i]:
                yield upto - at, self.data[i]
            else:
                yield upto - at, tool.zip.compress("".join(self.opened(tool.unzip, at, upto)).encode())
            at = upto


class _Tool:
    """Compressor and decompressor of a task, and the frames of the marks."""

    def __init__(self):
        self.zip, self.unzip = zstandard.ZstdCompressor(), zstandard.ZstdDecompressor()
        self.marks = {mark: (len(mark), self.zip.compress(mark.encode())) for mark in (P, S, M)}


def _frames_of(column: pa.Array) -> Iterator[FramedText]:
    parts, offsets = column.values, column.offsets.to_numpy()
    units, data = parts.field("units").to_numpy(), parts.field("data")
    for a, z in zip(offsets[:-1], offsets[1:], strict=True):
        yield FramedText(units[a:z], data[int(a) : int(z)].to_pylist())


def _column_of(texts: Iterable[Iterable[tuple[int, bytes]]]) -> pa.Array:
    offsets, first, units, data = [0], [], [], []
    for frames in texts:
        at = 0
        for n, held in frames:
            first.append(at)
            units.append(n)
            data.append(held)
            at += n
        offsets.append(len(data))
    parts = [pa.array(first, pa.int64()), pa.array(units, pa.int32()), pa.array(data, pa.binary())]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(_FRAME)))


def _framing(frame_units: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _Tool()
        for batch in blocks(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            cut = ([t[i : i + frame_units] for i in range(0, len(t), frame_units)] for t in texts)
            frames = _column_of([(len(x), tool.zip.compress(x.encode())) for x in pieces] for pieces in cut)
            marked = [any(mark in t for mark in (P, S, M)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(marked), frames],
                ["doc_id", "n", "marked", "frames"],
            )

    return run


def frame_texts(docs: DataFrame, frame_units: int = FRAME_UNITS) -> DataFrame:
    """A row for each row of `docs`: doc_id, n (code points), marked, frames.

    A frame holds up to `frame_units` code points and stands alone; `first` counts those before it.
    A null or empty text has no frame. `marked` tells whether the text holds a mark of its own.
    Other columns are ignored.
    """
    run = _framing(frame_units)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, n long, marked boolean, {_FRAMES}")


def _drawn(seed: int, place: int) -> Column:
    """One of the 8-digit groups of the hash of a document's id, as a number."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(key, 256), 8 * place - 7, 8), 16, 10).cast("long")


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tool = _Tool()

    def output(text: FramedText, form: str, low: int | None, high: int | None) -> Iterator[tuple[int, bytes]]:
        if form == "plain":
            yield from text.span(tool, 0, len(text))
            return
        spans = {"prefix": (0, low), "middle": (low, high), "suffix": (high, len(text))}
        for mark, part in ORDER[form]:
            yield tool.marks[mark]
            yield from text.span(tool, *spans[part])

    for batch in batches:
        cuts = (batch.column(c).to_pylist() for c in ("form", "low", "high"))
        rows = zip(_frames_of(batch.column("frames")), *cuts, strict=True)
        moved = _column_of(output(*row) for row in rows)
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), moved], [*names, "frames"])


def fill_in_middle(framed: DataFrame, seed: int = 1, percent: int = 90, percent_spm: int = 20) -> DataFrame:
    """Frames of `frame_texts` with prefix, middle and suffix moved: doc_id, n, form, prefix_chars, middle_chars, frames.

    The two cuts and the form are drawn from a hash of `seed` and doc_id, so a rerun draws the same;
    a null doc_id draws like an empty one, and rows of one doc_id draw alike. Form is `plain` for an
    empty text, one that holds a mark, and all but `percent` of the rest; of the others
    `percent_spm` begin with the suffix (`spm`), the rest with the prefix (`psm`). Lengths of a
    plain row are null, and its frames are those of the text.
    """
    a, b = (F.pmod(_drawn(seed, i), F.col("n") + 1) for i in (1, 2))
    plain = (F.col("n") == 0) | F.col("marked") | (_drawn(seed, 3) % 100 >= percent)
    form = F.when(plain, "plain").when(_drawn(seed, 4) % 100 < percent_spm, "spm").otherwise("psm")
    rows = framed.select("doc_id", "n", form.alias("form"), F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b"), "frames")
    moved = F.col("form") != "plain"
    rows = rows.select(
        "doc_id",
        "n",
        "form",
        F.when(moved, F.col("_a")).alias("prefix_chars"),
        F.when(moved, F.col("_b") - F.col("_a")).alias("middle_chars"),
        F.when(moved, F.col("_a")).alias("low"),
        F.when(moved, F.col("_b")).alias("high"),
        "frames",
    )
    return rows.mapInArrow(_moved, f"doc_id long, n long, form string, prefix_chars long, middle_chars long, {_FRAMES}")


def find_marks(parts: Iterable[str], marks: Iterable[str]) -> list[int]:
    """Where marks stand that follow one another in a text given part by part, each found once."""
    left, found, held, before = list(marks), [], "", 0
    for part in parts:
        held += part
        while left and (at := held.find(left[0])) >= 0:
            found.append(before + at)
            cut = at + len(left.pop(0))
            held, before = held[cut:], before + cut
        keep = len(left[0]) - 1 if left else 0
        before, held = before + max(len(held) - keep, 0), held[max(len(held) - keep, 0) :]
        if not left:
            return found
    raise ValueError(f"no {left[0]} in an output")


def restored(output: FramedText, form: str, unzip: zstandard.ZstdDecompressor) -> Iterator[str]:
    """The text that was moved, part by part, from the output and its form alone."""
    if form == "plain":
        yield from output.opened(unzip)
        return
    marks = [mark for mark, _ in ORDER[form]]
    at = find_marks(output.opened(unzip), marks)
    ends = [*at[1:], len(output)]
    spans = {part: (a + len(mark), z) for (mark, part), a, z in zip(ORDER[form], at, ends, strict=True)}
    for part in ("prefix", "middle", "suffix"):
        yield from output.opened(unzip, *spans[part])


def _read(make, names: list[str]):
    """Rows with `make(text, form, decompressor)` in place of the frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            forms = batch.column("form").to_pylist()
            made = [make(t, f, unzip) for t, f in zip(_frames_of(batch.column("frames")), forms, strict=True)]
            kept = [c for c in batch.schema.names if c != "frames"]
            columns = [pa.array([m[i] for m in made], pa.string()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], [*kept, *names])

    return run


def _sha256(parts: Iterable[str]) -> str:
    digest = hashlib.sha256()
    for part in parts:
        digest.update(part.encode())
    return digest.hexdigest()


_ROW = "doc_id long, n long, form string, prefix_chars long, middle_chars long"


def with_digests(moved: DataFrame) -> DataFrame:
    """Rows of `fill_in_middle` with output_sha256 and restored_sha256 in place of the frames.

    Both are read from the output: its frames in order, and the text put together again from it.
    """
    make = lambda text, form, unzip: (_sha256(text.opened(unzip)), _sha256(restored(text, form, unzip)))
    return moved.mapInArrow(_read(make, ["output_sha256", "restored_sha256"]), f"{_ROW}, output_sha256 string, restored_sha256 string")


def with_texts(moved: DataFrame) -> DataFrame:
    """Rows of `fill_in_middle` with the output as `text` in place of the frames."""
    make = lambda text, form, unzip: ("".join(text.opened(unzip)),)
    return moved.mapInArrow(_read(make, ["text"]), f"{_ROW}, text string")
