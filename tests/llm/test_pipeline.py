import pytest

import brute
import corpus_pipeline
from corpus_pipeline import STAGES
from rows import SCHEMA, empty_frame, odd_frame, words_at

NAMES = [name for name, _ in STAGES]


def test_stages_keep_the_columns(spark, sf_dir):
    docs = odd_frame(spark, extra=True)
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    kept = {r.doc_id for r in STAGES[2][1](spark, docs, sf_dir).collect()}
    assert {1, 7, 10, 12} <= kept and not {2, 3, 8, 11} & kept
    once = STAGES[2][1](spark, docs, sf_dir).where("doc_id = 13").count()
    assert once == 1


def test_language_stage_keeps_what_has_letters(spark, sf_dir):
    """Texts of several languages stay, and everything does where no row has a language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = {r.lang: r.text for r in docs.where("lang IS NOT NULL AND length(text) > 200").collect()}
    mixed = " ".join(text[:200] for text in first.values())
    added = docs.limit(1).selectExpr("CAST(-1 AS BIGINT) AS doc_id", f"'{mixed}' AS text", "lang", "source", "n_chars")
    marks = added.selectExpr("CAST(-2 AS BIGINT) AS doc_id", "'... 12 !' AS text", "lang", "source", "n_chars")
    kept = {r.doc_id for r in STAGES[0][1](spark, docs.unionAll(added).unionAll(marks), sf_dir).collect()}
    assert -1 in kept and -2 not in kept
    unlabelled = docs.withColumn("lang", docs["lang"].substr(1, 0)).replace("", None, ["lang"])
    assert STAGES[0][1](spark, unlabelled, sf_dir).count() == docs.count()


def test_lines_stage_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute.line_dedup({r.doc_id: r.text for r in docs.collect()})
    got = STAGES[1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id: r.text for r in got} == {d: x[2] for d, x in want.items()}
    assert all(r.n_chars == len(r.text) for r in got)


def test_near_duplicates_stage_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute.jaccard_components({r.doc_id: r.text for r in docs.collect()})
    got = [r.doc_id for r in STAGES[2][1](spark, docs, sf_dir).collect()]
    assert sorted(got) == sorted(d for d, (_, c) in want.items() if c == d)


def test_near_duplicates_are_judged_by_row(spark, sf_dir):
    """A near copy goes and another text stays, though both have one doc_id or none."""
    base, other, third = words_at(1, 120), words_at(40, 120, 11), words_at(90, 120, 13)
    near = base.replace(base.split()[60], "changed", 1)
    texts = [(1, base), (5, near), (5, other), (5, other), (None, other + " tail"), (None, third), (None, third + " tail")]
    rows = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in texts], SCHEMA)
    got = [(r.doc_id, r.text) for r in STAGES[2][1](spark, rows, sf_dir).collect()]
    assert sorted(t for d, t in got if d is not None) == sorted([base, other])
    assert [t in (third, third + " tail") for d, t in got if d is None] == [True]


def test_run_packs_what_the_stages_keep(spark, sf_dir):
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    docs = {}
    for r in pieces:
        docs.setdefault(r.doc_id, []).append(r)
    all_ids = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    assert 50 < len(docs) <= len(all_ids) and docs.keys() <= all_ids
    for own in docs.values():
        copies = sum(r.start == 0 for r in own)
        assert 1 <= copies <= 3 and sum(r.length for r in own) == copies * own[0].doc_tokens


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, sf_dir, name):
    assert dict(STAGES)[name](spark, empty_frame(spark), sf_dir).collect() == []


def test_language_stage_drops_words_of_no_known_language(spark, sf_dir):
    """The model's work decides: letters alone do not keep a text, several known languages in it do."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = {r.lang: r.text for r in docs.where("lang IS NOT NULL AND length(text) > 200").collect()}
    texts = {-1: " ".join(text[:200] for text in first.values()), -2: "ελληνικα γραμματα εδω " * 10, -3: "qxzwk vypq zzkwj " * 20}
    added = spark.createDataFrame([(i, t, None, "a", len(t)) for i, t in texts.items()], SCHEMA)
    kept = {r.doc_id for r in STAGES[0][1](spark, docs.select(*added.columns).unionAll(added), sf_dir).collect()}
    assert -1 in kept and not {-2, -3} & kept
    assert len(kept) > 0.9 * docs.count()
