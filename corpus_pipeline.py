"""A training-data pipeline over ``documents`` from the corpus operators.

Every stage takes all that its predecessor kept; all but the last return the columns
of ``documents``.  No part of it is SQL: model fitting and tokenization are not.

Rows with null or empty texts pass every stage but the mixture, which reads none of a
leaf without words, and end as a piece of the end id alone; null ids, languages and sources are values like others; rows repeated in id and text
are one document from the second stage on; ties fall as each operator's docstring says;
further columns are carried to the last stage, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from cairn.functions.lineage import discard, settle
from cairn.llm.mixing import Mix, mix_sources
from cairn.llm.ngram_join import keep_one
from cairn.llm.packing import pack
from cairn.llm.resampling import keep_sampled
from cairn.llm.secrets import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling rejects go."""
    return keep_sampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word Jaccard >= 0.75 stays."""
    return keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return redact_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, within one epoch: no document is repeated."""
    return mix_sources(docs, Mix(epochs=1))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their window and offset."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixture),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written and read back for the next.

    Tables on the way are deleted as soon as the stage that reads them is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, settle(spark, partial(stage, spark, docs, sf_dir))
        discard(before)
    out = STAGES[-1][1](spark, docs, sf_dir)  # written by ``pack``
    discard(docs)
    return out
