"""Outlier removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.neighbours import POINT_KEY, nearest_neighbours, radius_count


def _parted(marked: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(clean, outliers); a scene that would lose all its points keeps them, and they are its outliers too."""
    lost = marked.groupBy("scene_id").agg(F.bool_and("outlier").alias("all_lost"))
    marked = marked.join(lost, "scene_id")
    return marked.where("not outlier or all_lost").select(columns), marked.where("outlier").select(columns)


def mean_distances(points: DataFrame, k: int) -> DataFrame:
    """(scene_id, point_id, mean_distance): mean distance to the k nearest other points."""
    near = nearest_neighbours(points, k)
    return near.groupBy(*POINT_KEY).agg(F.avg(F.sqrt("d2")).alias("mean_distance"))


def statistical_outliers(points: DataFrame, k: int = 20, ratio: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(clean, outliers): outliers lie further from their k neighbours than mean + ratio * stddev.

    A scene of at most k points is left as it is.
    """
    far = mean_distances(points, k)
    size = points.groupBy("scene_id").agg(F.count("*").alias("n"))
    limit = far.groupBy("scene_id").agg((F.avg("mean_distance") + F.lit(float(ratio)) * F.stddev_samp("mean_distance")).alias("most"))
    marked = points.join(far, list(POINT_KEY), "left").join(size, "scene_id").join(limit, "scene_id", "left")
    marked = marked.withColumn("outlier", F.coalesce((F.col("n") > k) & (F.col("mean_distance") > F.col("most")), F.lit(False)))
    return _parted(marked, points.columns)


def radius_outliers(points: DataFrame, radius: float = 0.1, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """(clean, outliers): outliers have fewer than ``least`` other points within ``radius``.

    A scene of one point is left as it is.
    """
    near = radius_count(points, radius)
    size = points.groupBy("scene_id").agg(F.count("*").alias("n"))
    marked = points.join(near, list(POINT_KEY)).join(size, "scene_id")
    return _parted(marked.withColumn("outlier", (F.col("n") >= 2) & (F.col("n_neighbours") < least)), points.columns)
