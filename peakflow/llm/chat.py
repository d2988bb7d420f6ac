"""Formatting of conversations with a loss mask aligned by character offsets.

A conversation is rendered whole and encoded once, with the characters each token covers. The spans
of its turns and those of its tokens are both sorted, so the turn a token falls into is found by
binary search, and the loss mask is the part of the token that lies in a turn to be learned.

A user's turn is `[INST] text [/INST]`, any other `<s>role\\ntext</s>`. A backslash breaks up the
template's control strings where a text holds them, and doubles itself, so every text can be read
back as it was. Roles are percent-encoded.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator, Sequence
from urllib.parse import quote, unquote

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROL = re.compile(r"<(?=/?s>)|\[(?=/?INST\])")
TURN = re.compile(r"\[INST\] (.*?) \[/INST\]|<s>([^\n]*)\n(.*?)</s>", re.DOTALL)
BATCH_CHARS = 1 << 18
FORMATTED = (
    "conv_id long, text string, ids array<int>, token_start array<int>, token_end array<int>,"
    " loss_start array<int>, loss_end array<int>"
)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(turns: Sequence[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of a conversation, and where the escaped text of each turn lies in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        before, after = ("[INST] ", " [/INST]") if role == "user" else (f"<s>{quote(role, safe='')}\n", "</s>")
        body = escape(text)
        out += [before, body, after]
        spans.append((at + len(before), at + len(before) + len(body)))
        at = spans[-1][1] + len(after)
    return "".join(out), spans


def read_turns(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    turns, at = [], 0
    while at < len(text):
        m = TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        turns.append(("user", unescape(m[1])) if m[1] is not None else (unquote(m[2]), unescape(m[3])))
        at = m.end()
    return turns


def loss_spans(tokens: np.ndarray, learned: np.ndarray) -> np.ndarray:
    """Of each token (start, end) the characters that lie in a learned span; start = end if none do."""
    out = np.repeat(tokens[:, :1], 2, axis=1)
    if len(learned):
        at = np.minimum(np.searchsorted(learned[:, 1], tokens[:, 0], side="right"), len(learned) - 1)
        start, end = np.maximum(tokens[:, 0], learned[at, 0]), np.minimum(tokens[:, 1], learned[at, 1])
        hit = start < end
        out[hit] = np.stack([start[hit], end[hit]], axis=1)
    return out


def _format(path: str | None, learn: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        tokenizer.encode_special_tokens = True

        def encoded(rows: list) -> pa.RecordBatch:
            ids, starts, ends, loss_from, loss_to = [], [], [], [], []
            found = tokenizer.encode_batch([text for _, text, _ in rows], add_special_tokens=False)
            for (_, _, learned), e in zip(rows, found):
                tokens = np.array(e.offsets, np.int64).reshape(-1, 2)
                loss = loss_spans(tokens, np.array(learned, np.int64).reshape(-1, 2))
                ids.append(np.array(e.ids, np.int32))
                for out, column in ((starts, tokens[:, 0]), (ends, tokens[:, 1]), (loss_from, loss[:, 0]), (loss_to, loss[:, 1])):
                    out.append(column.astype(np.int32))
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (ids, starts, ends, loss_from, loss_to)]
            names = ["conv_id", "text", "ids", "token_start", "token_end", "loss_start", "loss_end"]
            keys = pa.array([c for c, _, _ in rows], pa.int64()), pa.array([t for _, t, _ in rows], pa.string())
            return pa.RecordBatch.from_arrays([*keys, *lists], names)

        rows, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):  # a conversation at a time: a long one is not copied with its batch
                turns = [(t["role"] or "", t["text"] or "") for t in batch.column("turns")[i].as_py()]
                text, spans = render(turns)
                learned = [s for s, (role, _) in zip(spans, turns) if role in learn and s[0] < s[1]]
                rows.append((batch.column("conv_id")[i].as_py(), text, learned))
                size += len(text)
                if size > BATCH_CHARS:
                    yield encoded(rows)
                    rows, size = [], 0
        if rows:
            yield encoded(rows)

    return run


def format_conversations(
    turns: DataFrame, tokenizer: str | None = None, learn: Sequence[str] = ("assistant",)
) -> DataFrame:
    """A row for each conversation: conv_id, text, ids, token_start, token_end, loss_start, loss_end.

    `turns` has conv_id, turn, role and text. The lists run over the tokens; starts and ends count
    code points of `text`, and the loss of a token lies between loss_start and loss_end. Turns are
    ordered by number, nulls first; equal numbers by role and text, and repeated rows are repeated
    turns. Null texts and roles are empty. Rows without a conv_id make one conversation. Only the
    roles in `learn` carry loss. Other columns are ignored.
    """
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return whole.mapInArrow(_format(tokenizer, learn), FORMATTED)


def loss_text(text: str, start: np.ndarray, end: np.ndarray) -> str:
    """What lies under the mask, each character once though several tokens may share it."""
    start = np.maximum(start, np.r_[0, np.maximum.accumulate(end)[:-1]]) if len(end) else start
    return "".join(text[a:z] for a, z in zip(start.tolist(), end.tolist()) if a < z)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            text = batch.column("text")[i].as_py()
            turns = read_turns(text)
            start, end = (batch.column(c)[i].values.to_numpy() for c in ("loss_start", "loss_end"))
            learned = unescape(loss_text(text, start, end))
            whole = "".join(f"{role}\n{said}\n" for role, said in turns)
            rows.append(
                (
                    batch.column("conv_id")[i].as_py(),
                    len(turns),
                    hashlib.sha256(whole.encode()).hexdigest(),
                    len(learned),
                    hashlib.sha256(learned.encode()).hexdigest(),
                    len(text),
                )
            )
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kinds[j]) for j in range(6)], names)


def read_back(formatted: DataFrame) -> DataFrame:
    """From formatted rows alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    return formatted.select("conv_id", "text", "loss_start", "loss_end").mapInArrow(
        _read_back,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
