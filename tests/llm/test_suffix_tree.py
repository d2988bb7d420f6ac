import math
import time
import zlib
from collections import Counter

import numpy as np
import pytest

import brute
from peakflow.llm import suffix_tree
from peakflow.llm.suffix_tree import suffix_tree_scores
from rows import empty_frame, odd_documents, odd_frame

END = "</s>\n"


def in_training(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 != 1


def test_base_scores_equal_plain_counts(spark, sf_dir):
    from peakflow.llm.queries import op10_suffix_tree_lm

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    count = Counter()
    for d, t in docs.items():
        if in_training(d):
            count.update([*brute.words(t), END])
    total = sum(count.values())
    rows = op10_suffix_tree_lm(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        tokens = [*brute.words(docs[r.doc_id]), END]
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (len(count) + 1))) for w in tokens)
        known = sum(count[w] > 0 for w in tokens)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not in_training(r.doc_id), len(tokens), known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def plain_tree(docs, depth, least_count=4, least_divergence=0.01, discount=0.5):
    """Chances by every context, and the scores, from plain counts of whole contexts."""
    after = {}
    for d, text in docs:
        if in_training(d):
            tokens = [*brute.words(text), END]
            for i, w in enumerate(tokens):
                for k in range(min(i, depth) + 1):
                    after.setdefault(tuple(tokens[i - k : i]), Counter())[w] += 1
    root = after.get((), Counter())
    total = sum(root.values())

    def chance(context, w):
        if not context:
            return (root[w] + 0.5) / (total + 0.5 * (len(root) + 1))
        n = after[context]
        left = discount * len(n) / sum(n.values())
        return max(n[w] - discount, 0) / sum(n.values()) + left * chance(context[1:], w)

    frequent = [c for c, n in after.items() if c and sum(n.values()) >= least_count]
    states = set()
    for c in frequent:
        n = after[c]
        gain = sum(k * math.log2(chance(c, w) / chance(c[1:], w)) for w, k in n.items()) / sum(n.values())
        if gain >= least_divergence:
            states |= {c[i:] for i in range(len(c))}

    def state(before):
        return next((before[i:] for i in range(max(len(before) - depth, 0), len(before)) if before[i:] in states), ())

    scores = []
    for d, text in docs:
        tokens = [*brute.words(text), END]
        scores.append((d, sum(math.log10(chance(state(tuple(tokens[:i])), w)) for i, w in enumerate(tokens))))
    return states, chance, sorted(scores)


def letters(seed, count, length, words="abcdef"):
    """Texts in which two words settle much of what follows."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(count):
        w = rng.choice(list(words), 2).tolist()
        while len(w) < length:
            settled = words[(words.index(w[-1]) + 2 * words.index(w[-2])) % len(words)]
            w.append(settled if rng.random() < 0.6 else words[rng.integers(len(words))])
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("divergence", [0.0, 0.01, 0.3])
def test_scores_equal_a_plain_tree_of_depth_three(spark, monkeypatch, divergence):
    """In small blocks and cells, with contexts dealt to several cells."""
    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", 400)
    monkeypatch.setattr(suffix_tree, "CELL_BYTES", 1000)
    monkeypatch.setattr(suffix_tree, "HOT_TOKENS", 50)
    docs = [*letters(3, 60, 40), *letters(4, 1, 300), (900, ""), (901, "a b new c"), (902, "A b c d e f")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = suffix_tree_scores(df, least_divergence=divergence).select("doc_id", "score").collect()
    states, _, want = plain_tree(docs, 3, least_divergence=divergence)
    assert sorted(len(c) for c in states)[-1] == 3
    got = sorted(tuple(r) for r in rows)
    assert [d for d, _ in got] == [d for d, _ in want]
    assert [x for _, x in got] == pytest.approx([x for _, x in want], rel=1e-9)


def test_production_scores_equal_a_plain_tree(spark, sf_dir):
    from peakflow.llm.queries import op10_suffix_tree_lm

    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    _, _, want = plain_tree(docs, 3)
    got = sorted((r.doc_id, r.score) for r in op10_suffix_tree_lm(spark, sf_dir).collect())
    assert [d for d, _ in got] == [d for d, _ in want]
    assert [x for _, x in got] == pytest.approx([x for _, x in want], rel=1e-9)


def test_two_words_that_settle_the_next_one(spark):
    """The last word alone says nothing; the state of two words is kept, and its suffix with it."""
    rng = np.random.default_rng(8)
    docs = []
    for i in range(200):
        w = rng.integers(0, 2, 2).tolist()
        while len(w) < 300:
            w.append(int(w[-1] ^ w[-2] ^ (rng.random() >= 0.95)))
        docs.append((i, " ".join("uv"[x] for x in w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = [r for r in suffix_tree_scores(df).collect() if r.held_out]
    assert -0.11 < sum(r.score for r in rows) / sum(r.n_tokens for r in rows) < -0.08


def test_chances_add_up_to_one(spark):
    """Scores of a common start and one word more, less that of the start, add up over the vocabulary."""
    base, words = letters(5, 200, 30), [*"abcdef", "never"]
    states, chance, _ = plain_tree(base, 3, least_divergence=-9)
    common = sorted(c for c in states if len(c) == 3)[7]
    asked = [i for i in range(1000, 1100) if not in_training(i)]
    texts = [" ".join(common), *(" ".join([*common, w]) for w in words)]
    df = spark.createDataFrame([*base, *zip(asked, texts)], "doc_id long, text string")
    rows = {r.doc_id: r.score for r in suffix_tree_scores(df, least_divergence=-9).collect()}
    end = math.log10(chance(common, END))
    total = 10**end
    for d, w in zip(asked[1:], words):
        after = (*common[1:], w)
        while after and after not in states:
            after = after[1:]
        total += 10 ** (rows[d] - math.log10(chance(after, END)) - (rows[asked[0]] - end))
    assert total == pytest.approx(1, abs=1e-9)


def test_odd_rows(spark):
    rows = suffix_tree_scores(odd_frame(spark, extra=True)).collect()
    assert len(rows) == len(odd_documents())
    by_id = {r.doc_id: r for r in rows}
    assert by_id[4].n_tokens == by_id[5].n_tokens == by_id[6].n_tokens == 1
    assert by_id[10].n_tokens == 6001
    assert all(np.isfinite(r.score) and r.score < 0 for r in rows)


def test_nothing_to_learn_from(spark):
    assert suffix_tree_scores(empty_frame(spark)).collect() == []
    asked = next(i for i in range(100) if not in_training(i))
    [row] = suffix_tree_scores(spark.createDataFrame([(asked, "a b")], "doc_id long, text string")).collect()
    assert (row.n_known, row.train_tokens, row.n_tokens) == (0, 0, 3) and row.base_score == row.score == 0


def test_rare_contexts_are_states_however_large_the_corpus(spark, monkeypatch):
    """3,000 words with a follower of their own, each 1 / 6,700 of all tokens, seen in several blocks."""
    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", 1 << 16)
    ids = [i for i in range(20_000) if in_training(i)][:10]
    pairs = [" ".join(f"x{j} y{j}" for j in np.random.default_rng(i).permutation(3000)) for i in ids]
    asked = next(i for i in range(20_000) if not in_training(i))
    df = spark.createDataFrame([*zip(ids, pairs), (asked, "x7 y7")], "doc_id long, text string")
    row = next(r for r in suffix_tree_scores(df.repartition(4), depth=1).collect() if r.held_out)
    root = 10.5 / (60_010 + 0.5 * (6001 + 1))  # all words, and the end, are there ten times
    after = Counter(([*p.split(), END] * 2)[p.split().index("y7") + 1] for p in pairs)
    left = 0.5 * len(after) / 10
    end = (after[END] - 0.5) / 10 + left * root if END in after else left * root
    assert (row.train_tokens, row.n_known, row.n_tokens) == (60_010, 3, 3)
    assert row.base_score == pytest.approx(3 * math.log10(root), rel=1e-9)
    assert row.score == pytest.approx(math.log10(root) + math.log10(0.95 + 0.05 * root) + math.log10(end), rel=1e-9)


def test_scores_do_not_depend_on_blocks(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole = {r.doc_id: r.score for r in suffix_tree_scores(docs.coalesce(1)).collect()}
    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", 1 << 14)
    cut = {r.doc_id: r.score for r in suffix_tree_scores(docs.repartition(3)).collect()}
    assert cut.keys() == whole.keys()
    assert all(cut[d] == pytest.approx(whole[d], rel=1e-9) for d in whole)


def test_walks_leave_no_shuffle_files(spark):
    def shuffle_files():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(blocks.size()) if (name := blocks.apply(i).getName()).startswith("shuffle_")}

    spark.conf.unset("spark.sql.classic.shuffleDependency.fileCleanup.enabled")  # another test may have set it
    before = shuffle_files()
    assert suffix_tree_scores(spark.createDataFrame(letters(6, 30, 40), "doc_id long, text string")).count() == 30
    for _ in range(50):  # the files are removed in the background
        if not (left := shuffle_files() - before):
            break
        time.sleep(0.1)
    assert not left


def test_words_are_dropped_and_pairs_asked_in_rounds(spark, monkeypatch):
    """After the words are counted only their tokens are kept, and every length of context asks for a part at a time."""
    from peakflow import session

    rng = np.random.default_rng(9)
    docs = [(i, " ".join(f"word{x}" for x in rng.zipf(1.5, 300))) for i in range(60)]
    monkeypatch.setattr(suffix_tree, "CELL_BYTES", 10_000)
    asked = []
    told = suffix_tree._block_pairs
    monkeypatch.setattr(suffix_tree, "_block_pairs", lambda *a: asked.append(a[1:]) or told(*a))
    since = len(session._stored)
    rows = suffix_tree_scores(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    _, _, want = plain_tree(docs, 3)
    assert [r.score for r in sorted(rows)] == pytest.approx([x for _, x in want], rel=1e-9)
    assert [(a[0], a[2], a[3]) for a in asked] == [(1, 0, 2), (1, 1, 2), (2, 0, 3), (2, 1, 3), (2, 2, 3), (3, 0, 2), (3, 1, 2)]
    assert not [p for _, p in session._stored[since:] if "lm-blocks" in p or "lm-gains" in p]
