"""Labels from report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LABELLED = "structural_planes array<struct<label:string>>, objects array<struct<label:string>>"


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(position, label): a report's planes, then its objects, numbered from 0."""
    doc = spark.read.schema(_LABELLED).json(path, multiLine=True)
    none = F.array().cast("array<struct<label:string>>")
    every = F.concat(F.coalesce("structural_planes", none), F.coalesce("objects", none))
    return doc.select(F.posexplode(every).alias("position", "row")).select("position", "row.label")


def evaluate_files(spark: SparkSession, predicted: str, truth: str, labels: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """Scores of one report against another, label by label in order."""
    from cairn.operators.evaluate import SCORED, evaluate, zip_labels

    true = read_labels(spark, truth)
    return evaluate(zip_labels(true, read_labels(spark, predicted)), labels or SCORED, n_true=true)
