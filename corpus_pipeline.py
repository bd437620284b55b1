"""A training-data pipeline over ``documents``: rules, classifier, near-duplicates, mixing, packing.

Every stage reads the rows that the one before kept, and all but the last return the
columns of ``documents``.  Run it stage by stage with :data:`STAGES`, or whole with
:func:`run`, which writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusward.llm import cotraining, fertility, minhash, mixing, packing
from corpusward.llm.tables import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules or a fertility band reject go."""
    return fertility.keep_good(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are likelier of low quality go."""
    return cotraining.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays, of the document with the smallest id; shingles of five words."""
    return minhash.keep_one(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken, left or repeated so that the sources meet their target shares."""
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in packed sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixing_sources),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot express the tokeniser, classifier and packing stages. A test compares the rows of every stage with a
#: brute-force version over the rows of the stage before (the classifier's with the scores of its own model).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
