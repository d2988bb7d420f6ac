"""From raw documents to packed sequences: language, common lines, near duplicates, mix, packing.

Every stage takes (spark, docs, sf_dir), where docs is what the stage before it kept, and returns a
frame with the columns of docs; the last returns packed pieces. Columns beyond doc_id, text, lang,
source and n_chars go along untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakflow.llm.language import accepted, train
from peakflow.llm.line_dedup import drop_common_lines
from peakflow.llm.mixing import mixed_documents
from peakflow.llm.ngram_join import one_of_each_component
from peakflow.llm.packing import pack, with_digest
from peakflow.session import materialise


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter and those whose words fit no known language go; a text of several languages stays.

    Where no row has a language, nothing can be learned and all documents stay.
    """
    model = train(docs)
    return accepted(docs, model) if model.languages else docs


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; n_chars follows the text. Null texts come back empty."""
    counts = ("n_lines", "n_dropped")
    kept = drop_common_lines(docs).drop(*counts).withColumnsRenamed({f"_{c}": c for c in counts if c in docs.columns})
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar shingles the one with the smallest doc_id stays.

    Every row is judged by its own text, also where rows share a doc_id or have none. Rows that
    repeat a doc_id and its text become one; documents without words are linked with nothing.
    """
    return one_of_each_component(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the weights 5, 2, 1, in turn; a document is there as often as the mix takes it."""
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with the digest of their token ids."""
    return with_digest(pack(docs))


STAGES = [
    ("language", known_language),
    ("lines", without_common_lines),
    ("near_duplicates", one_of_each_group),
    ("mix", mixed_sources),
    ("pack", packed),
]

ORACLE_SQL = None  # language, mixing and packing cannot be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
