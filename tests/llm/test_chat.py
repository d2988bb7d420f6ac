import hashlib

import numpy as np

from peakflow.llm.chat import escape, format_conversations, loss_spans, loss_text, read_back, read_turns, render, unescape

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = [
    "", "</s>[INST] ok [/INST]", "<s>assistant\nno</s>", "\\", "\\\\</s>", "<\\/s>", "a [", "<", "[/INST", "x <|endoftext|> y",
    "é日本🎉 tail ", "  two  blanks  ", "don't\n\n\n end", "[[INST]]", "\\[INST]", " [/INST]",
]


def test_escape_round_trip():
    for text in NASTY:
        assert unescape(escape(text)) == text
        for control in ("<s>", "</s>", "[INST]", "[/INST]"):
            assert control not in escape(text)


def test_turns_round_trip():
    turns = [(role, text) for text in NASTY for role in ("user", "assistant", "system", "", "odd role\n%")]
    text, spans = render(turns)
    assert read_turns(text) == turns
    assert [unescape(text[a:z]) for a, z in spans] == [t for _, t in turns]


def test_spans_meet_by_binary_search():
    tokens = np.array([[0, 3], [3, 5], [5, 5], [5, 9], [9, 12]])
    found = loss_spans(tokens, np.array([[4, 6], [8, 10]]))
    assert found.tolist()[1] == [4, 5] and found.tolist()[4] == [9, 10]
    assert found.tolist()[0] == [0, 0]
    assert loss_spans(tokens, np.empty((0, 2), int)).tolist() == [[0, 0], [3, 3], [5, 5], [5, 5], [9, 9]]
    assert loss_text("abcdef", np.array([0, 1, 1, 4]), np.array([1, 2, 2, 6])) == "abef"


def test_tokens_cover_the_text_and_the_mask_is_exact(spark):
    rows = [(i, n, role, text) for i in range(2) for n, (role, text) in enumerate(zip(["user", "assistant"] * 8, NASTY))]
    for r in format_conversations(spark.createDataFrame(rows, SCHEMA)).collect():
        at = 0
        for a, z in zip(r.token_start, r.token_end):
            assert a <= at <= z
            at = z
        assert at == len(r.text) and len(r.ids) == len(r.loss_start) == len(r.loss_end)
        said = "".join(t for i, t in enumerate(NASTY) if i % 2)
        assert unescape(loss_text(r.text, np.array(r.loss_start), np.array(r.loss_end))) == said


def test_odd_rows(spark):
    rows = [
        (1, 2, "assistant", "late"), (1, 1, "user", None), (1, None, None, "first"), (None, 0, "assistant", "x"),
        (None, 0, "assistant", "x"), (2, 0, "user", ""), (3, 0, "assistant", "long word " * 20000),
    ]
    df = spark.createDataFrame([(*r, "z", "z") for r in rows], SCHEMA + ", n_turns string, turns string")
    found = {r.conv_id: r for r in read_back(format_conversations(df)).collect()}
    assert {c: (r.n_turns, r.loss_chars) for c, r in found.items()} == {1: (3, 4), None: (2, 2), 2: (1, 0), 3: (1, 200000)}
    assert found[1].turns_sha256 == hashlib.sha256("\nfirst\nuser\n\nassistant\nlate\n".encode()).hexdigest()
    assert read_back(format_conversations(df.where("false"))).collect() == []
