"""The corpus queries: thin digests over the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.ann import nearest
from cairn.llm.chat import chat_digest
from cairn.llm.mixing import mixed_documents
from cairn.llm.ngram_join import ngram_jaccard_join
from cairn.llm.oracle import ORACLE_SQL  # noqa: F401
from cairn.llm.packing import pack
from cairn.llm.pii import pii_digest
from cairn.llm.quality_rules import POLICIES, ablation, ledger, quality_verdicts
from cairn.llm.resampling import resample
from cairn.llm.secrets import secret_digest
from cairn.llm.sentence_spans import remove_repeated_spans


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(_table(spark, sf_dir, "documents"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), "id % 50 = 0", k=5)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_documents(_table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_jaccard_join(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(_table(spark, sf_dir, "documents"))


#: Repeated runs of fewer words are stock phrases of a line that clean documents share.
SPAN_WORDS = 16


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_spans(_table(spark, sf_dir, "documents"), words=SPAN_WORDS).drop("text_key")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(_table(spark, sf_dir, "documents"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy rejects alone, from the ledger's bits."""
    return ablation(ledger(_table(spark, sf_dir, "documents")), tuple(POLICIES))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "log_weight", "draw", "kept")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    return chat_digest(_table(spark, sf_dir, "conversations").select(*extra.columns).unionByName(extra))


QUERIES = {
    "op1_secret_scans": op1_secret_scans,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_source_mixing": op3_source_mixing,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_pii": op5_pii,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality_rules": op7_quality_rules,
    "quality_ablations": quality_ablations,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_packing": op9_packing,
    "op10_chat_formatting": op10_chat_formatting,
}
