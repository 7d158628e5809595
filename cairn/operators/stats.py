"""Scene statistics and floor normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.bounded import small_table
from cairn.functions.geometry import vector
from cairn.functions.ranks import grouped_percentile


def _stats() -> list[Column]:
    low, high, mid = ([F.coalesce(f(c), F.lit(0.0)) for c in "xyz"] for f in (F.min, F.max, F.avg))
    return [
        F.count("x").alias("n_points"), (F.count("r") > 0).alias("has_colors"), (F.count("nx") > 0).alias("has_normals"),
        vector(*low).alias("bbox_min"), vector(*high).alias("bbox_max"),
        vector(*[b - a for a, b in zip(low, high)]).alias("scene_dims"), vector(*mid).alias("centroid"),
    ]


def scene_stats(points: DataFrame) -> DataFrame:
    """One row for each scene: count, what attributes there are, box, dimensions, mean."""
    return points.groupBy("scene_id").agg(*_stats())


def total_stats(points: DataFrame) -> DataFrame:
    """One row over all points; an empty table gives zeros and False, not an error."""
    return points.agg(*_stats())


def scene_height(points: DataFrame) -> DataFrame:
    """(scene_id, scene_height): extent along z."""
    return points.groupBy("scene_id").agg((F.max("z") - F.min("z")).alias("scene_height"))


def floor_height(points: DataFrame, share: float = 0.05) -> DataFrame:
    """(scene_id, z_floor): exact percentile of z with linear interpolation."""
    return grouped_percentile(points, ["scene_id"], "z", share, "z_floor")


def normalize_floor(points: DataFrame, share: float = 0.05) -> DataFrame:
    """Points moved along z so that the 5th percentile of z is at 0.  No rotation."""
    floor = small_table(floor_height(points, share))
    return points.join(floor, "scene_id").withColumn("z", F.col("z") - F.col("z_floor")).drop("z_floor").select(*points.columns)
