"""Voxel downsampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.bounded import small_table
from cairn.schemas import COLOURS, COORDINATES, NORMALS


def voxel_downsample(points: DataFrame, size: float) -> DataFrame:
    """One point for each occupied cube: means of its members, least id, member count.

    Cubes start at the scene's least coordinates.  The second aggregation combines on
    the map side; only the corner of each scene is joined in.  A mean is kept within its
    members' least and greatest value, so that members which are equal have just that
    value as their mean, whatever the rounding of their sum in whatever order.
    """
    if not size > 0:
        raise ValueError("the voxel size must be positive")
    corner = small_table(points.groupBy("scene_id").agg(*[F.min(c).alias(f"{c}0") for c in COORDINATES]))
    cell = [F.floor((F.col(c) - F.col(f"{c}0")) / F.lit(float(size))).cast("bigint").alias(f"v{c}") for c in COORDINATES]
    values = [c for c in (*COORDINATES, *COLOURS, *NORMALS) if c in points.columns]
    keyed = points.join(corner, "scene_id").select("scene_id", "point_id", *values, *cell)
    return keyed.groupBy("scene_id", "vx", "vy", "vz").agg(
        F.min("point_id").alias("point_id"), *[F.least(F.greatest(F.avg(c), F.min(c)), F.max(c)).alias(c) for c in values], F.count("*").alias("n_members"))
