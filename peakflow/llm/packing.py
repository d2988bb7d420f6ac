"""Packing by powers of two: documents are cut into pieces of binary length, equal lengths share a bucket.

Every piece is a sequence of its own, so no sequence crosses documents and none is padded: a batch
is drawn from one bucket, and all of its sequences have the same length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakflow.llm.arrow_text import blocks
from peakflow.llm.byte_bpe import Encoder

END_ID = 0


def piece_lengths(tokens: int, longest: int) -> list[int]:
    """As many pieces of `longest` as fit, then the powers of two of the rest, largest first."""
    rest = tokens % longest
    return [longest] * (tokens // longest) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def _pieces(longest: int, tokenizer: str | None, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer or public_tokenizers.path("byte_bpe_50k.json"), plain=True)
        for batch in blocks(batches):
            ids, bounds = encoder.encode(batch.column("text"))
            row, start, length, tokens, held = [], [], [], [], []
            for i in range(batch.num_rows):
                own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4")
                at = 0
                for n in piece_lengths(len(own), longest):
                    row.append(i)
                    start.append(at)
                    length.append(n)
                    tokens.append(len(own))
                    held.append(own[at : at + n].tobytes())
                    at += n
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row, pa.int64())),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array(held, pa.binary()),
                ],
                ["doc_id", "start", "length", "doc_tokens", "ids"],
            )

    return run


def pack(docs: DataFrame, longest: int = 1024, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: doc_id, start, length, doc_tokens, ids, sequence_id, offset.

    `ids` holds the piece's token ids as little-endian unsigned 32-bit numbers; a document's ids end
    with `end_id`. `length` is a power of two up to `longest` and names the bucket. A null or empty
    text gives one piece with the end alone. A null doc_id is kept; repeated rows are packed as
    often. `sequence_id` is unique and follows the order in which `docs` is read. Other columns are
    ignored.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    pieces = docs.select("doc_id", "text").mapInArrow(
        _pieces(longest, tokenizer, end_id), "doc_id long, start long, length long, doc_tokens long, ids binary"
    )
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the pieces as one folder per length, spread over tasks within a length."""
    spread = pieces.withColumn("bucket", F.col("length")).repartition("bucket", F.shiftright("sequence_id", 12))
    spread.write.partitionBy("bucket").parquet(path)


def with_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
