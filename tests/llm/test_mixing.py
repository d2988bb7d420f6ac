from collections import Counter

import pytest
from pyspark.sql import functions as F

import brute
from peakflow.llm.mixing import mixed_documents, mixed_sizes
from rows import SCHEMA, empty_frame, odd_documents, odd_frame, words_at


def level_targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight, filled up to the brim source by source."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, full = sum(sizes.values()), set()
    while True:
        rest = budget - sum(most * sizes[s] for s in full)
        level = rest / sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and level * weight[s] >= most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else level * weight[s] for s in names}
        full |= over


def test_sources_come_near_their_targets(spark):
    rows = [(i, words_at(i, 5 + i % 30), "en", f"s{min(i % 11, 5)}" if i % 11 < 9 else None, 0) for i in range(1500)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixed_sizes(docs).collect()
    sizes = Counter()
    for d, text, _, source, _ in rows:
        sizes[source] += len(text.split())
    want, taken = level_targets(sizes), Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken % r.size == 0 and r.taken <= 3 * r.size
    for source, target in want.items():
        assert abs(taken[source] - target) <= 40
    again = {(r.doc_id, r.taken) for r in mixed_sizes(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_small_sources_are_full_and_the_rest_shared(spark):
    rows = [(1, "a b", "en", "a", 0), *[(10 + i, words_at(i, 20), "en", "b", 0) for i in range(30)]]
    got = {r.doc_id: r for r in mixed_sizes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].target == 6 and got[1].taken == 6 and got[10].target == 602 - 6


def test_documents_come_as_often_as_taken(spark):
    docs = odd_frame(spark, extra=True)
    sizes = mixed_sizes(docs)
    want = Counter()
    for r in sizes.collect():
        want[r.doc_id, r.size] += r.taken // r.size if r.size else 0
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    got = Counter((r.doc_id, len(brute.words(r.text))) for r in out.collect())
    assert got == Counter({k: n for k, n in want.items() if n})


def test_odd_rows(spark):
    rows = mixed_sizes(odd_frame(spark, extra=True)).collect()
    assert len(rows) == len(odd_documents())
    by_id = {r.doc_id: r for r in rows}
    assert (by_id[4].size, by_id[4].taken) == (0, 0)
    assert by_id[11].source is None and by_id[11].size == 6001
    assert sum(r.taken for r in rows) <= sum(r.size for r in rows)


def test_empty_table(spark):
    assert mixed_sizes(empty_frame(spark)).collect() == []
    assert mixed_documents(empty_frame(spark)).collect() == []
    blank = spark.createDataFrame([(1, None, "en", "a", 0)], SCHEMA)
    assert [(r.size, r.taken) for r in mixed_sizes(blank).collect()] == [(0, 0)]


def test_rows_without_an_id_are_queued_one_by_one(spark):
    """A source of rows without ids, some of them equal, comes as near its target as others."""
    rows = [(None, words_at(i // 2, 40), "en", "a", 0) for i in range(60)]
    rows += [(7, words_at(900 + i, 20), "en", "b", 0) for i in range(60)]  # one id for all
    rows += [(100 + i, words_at(i, 10), "en", "c", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    taken, target = Counter(), {}
    for r in mixed_sizes(docs).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken % r.size == 0 and r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= 40 for s in target)
    out = Counter()
    for r in mixed_documents(docs).collect():
        out[r.source] += len(r.text.split())
    assert out == taken


def plain_queue(rows, targets, budget, key):
    """All copies sorted by virtual finish time, sent while the budget lasts."""
    sent, copies = 0, []
    for source, target in targets.items():
        own = sorted((r for r in rows if r[3] == source), key=key)
        at = 0
        for copy in range(3):
            for r in own:
                at += len(r[1].split())
                copies.append((at / target, source, key(r), copy, r[0], len(r[1].split())))
    taken = Counter()
    for *_, doc, size in sorted(copies):
        sent += size
        if sent > budget:
            break
        taken[doc] += size
    return taken


def test_equals_a_plain_queue(spark):
    rows = [(i, words_at(i, 1 + i * 7 % 23), "en", f"s{i % 5 if i % 5 < 3 else 0}", 0) for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    order = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.lit(42), "doc_id", F.xxhash64("text")).alias("h")).collect()}
    got = mixed_sizes(docs).collect()
    targets = dict(sorted({r.source: r.target for r in got}.items()))
    want = plain_queue(rows, targets, sum(r.size for r in got), lambda r: order[r[0]])
    assert {r.doc_id: r.taken for r in got if r.taken} == dict(want)
