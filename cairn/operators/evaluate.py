"""Scores of predicted labels against true ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The labels that are scored by default.
SCORED = ("floor", "ceiling", "wall", "furniture", "tall_furniture", "small_object", "high_fixture", "horizontal_surface", "unknown", "noise")


def zip_labels(true: DataFrame, predicted: DataFrame) -> DataFrame:
    """(position, true_label, pred_label) of the positions that both have."""
    return true.select("position", F.col("label").alias("true_label")).join(predicted.select("position", F.col("label").alias("pred_label")), "position")


def confusion_matrix(pairs: DataFrame, labels: tuple[str, ...] = SCORED) -> DataFrame:
    """(true_label, pred_label, n) for every pair of labels, zeros included; other labels do not count."""
    spark = pairs.sparkSession
    every = spark.createDataFrame([(t, p) for t in labels for p in labels], "true_label string, pred_label string")
    counts = pairs.where(F.col("true_label").isin(*labels) & F.col("pred_label").isin(*labels)).groupBy("true_label", "pred_label").agg(F.count("*").alias("n"))
    return every.join(counts, ["true_label", "pred_label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def per_class(pairs: DataFrame, labels: tuple[str, ...] = SCORED) -> DataFrame:
    """(label, precision, recall, f1, support) to 4 places; 0 where a denominator is."""
    known = pairs.where(F.col("true_label").isin(*labels) & F.col("pred_label").isin(*labels))
    sides = known.select(F.explode(F.array(
        F.struct(F.col("true_label").alias("label"), (F.col("true_label") == F.col("pred_label")).cast("long").alias("tp"), F.lit(1).alias("of_true"), F.lit(0).alias("of_pred")),
        F.struct(F.col("pred_label").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).alias("of_true"), F.lit(1).alias("of_pred")))).alias("s")).select("s.*")
    sums = sides.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("of_true").alias("support"), F.sum("of_pred").alias("predicted"))
    every = pairs.sparkSession.createDataFrame([(x,) for x in labels], "label string").join(sums, "label", "left").na.fill(0)
    ratio = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    out = every.withColumns({"p": p, "r": r})
    f1 = ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))
    return out.select("label", F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round(f1, 4).alias("f1"), F.col("support").cast("long").alias("support"), F.col("predicted").cast("long").alias("predicted"))


def accuracy(pairs: DataFrame, n_true: int | DataFrame | None = None) -> DataFrame:
    """(accuracy): equal pairs over the number of *true* labels, to 4 places; none gives 0.

    ``n_true`` is that number where the pairs were cut short; a frame is counted.
    """
    whole = F.count("*") if n_true is None else F.lit(n_true.count() if isinstance(n_true, DataFrame) else n_true)
    same = F.coalesce(F.sum((F.col("true_label") == F.col("pred_label")).cast("long")), F.lit(0))
    return pairs.agg(F.when(whole > 0, F.round(same / F.when(whole > 0, whole), 4)).otherwise(0.0).alias("accuracy"))


def evaluate(pairs: DataFrame, labels: tuple[str, ...] = SCORED, n_true: int | DataFrame | None = None) -> dict[str, DataFrame]:
    """Accuracy, scores by class and the matrix."""
    return {"accuracy": accuracy(pairs, n_true), "per_class": per_class(pairs, labels), "confusion_matrix": confusion_matrix(pairs, labels)}


def report(pairs: DataFrame, labels: tuple[str, ...] = SCORED) -> DataFrame:
    """Scores of the labels that occur, as true or as predicted."""
    return per_class(pairs, labels).where("support > 0 or predicted > 0").drop("predicted")
