"""Schemas of the engine's tables, and the checks on their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT = ("scene_id string, point_id bigint, x double, y double, z double, r double, g double, b double, "
         "nx double, ny double, nz double")
PLANE = ("scene_id string, plane_id int, label string, inlier_count bigint, centroid_z double, "
         "normal array<double>, plane_model array<double>")
CLUSTER = ("scene_id string, cluster_id int, label string, confidence double, n_points bigint, point_density double, "
           "centroid array<double>, dims array<double>, z_min double, z_max double, footprint_m2 double, "
           "obb_extent array<double>, obb_rotation_deg double, aabb_min array<double>, aabb_max array<double>")
REGION = ("scene_id string, region_id int, n_points bigint, centroid array<double>, centroid_z double, dims array<double>, "
          "normal array<double>, z_min double, z_max double, footprint_m2 double")

# The label vocabularies.
PLANE_LABELS = ("floor", "ceiling", "wall", "horizontal_surface", "unknown", "noise")
CLUSTER_LABELS = ("furniture", "chair", "table", "shelf", "tall_furniture", "small_object", "high_fixture", "unknown", "noise", "horizontal_surface")

COORDINATES, COLOURS, NORMALS = ("x", "y", "z"), ("r", "g", "b"), ("nx", "ny", "nz")


def points(df: DataFrame, scene: str | Column | None = None) -> DataFrame:
    """``df`` as POINT: missing columns are null, scenes default to ``"0"``, and rows with
    a null or NaN coordinate are dropped (comparisons with NaN differ between engines)."""
    if scene is not None:
        df = df.withColumn("scene_id", scene if isinstance(scene, Column) else F.lit(scene))
    elif "scene_id" not in df.columns:
        df = df.withColumn("scene_id", F.lit("0"))
    kinds = dict(part.strip().split(" ") for part in POINT.split(","))
    out = df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
    for c in COORDINATES:
        out = out.where(F.col(c).isNotNull() & ~F.isnan(c))
    return out


def _plane_faults() -> dict[str, Column]:
    n = F.col("normal")
    return {
        "inlier_count is negative": F.col("inlier_count") < 0,
        "normal has not 3 components": F.size(n) != 3,
        "normal is zero": ~F.exists(n, lambda v: F.abs(v) >= 1e-9),
        "plane_model has not 4 components": F.size("plane_model") != 4,
        "label is not known": ~F.col("label").isin(*PLANE_LABELS),
    }


def _cluster_faults() -> dict[str, Column]:
    return {
        "n_points is not positive": F.col("n_points") <= 0,
        "confidence is out of [0, 1]": ~F.col("confidence").between(0, 1),
        "z_min is over z_max": F.col("z_min") > F.col("z_max") + 1e-6,
        "a dimension is negative": F.exists("dims", lambda v: v < -1e-6),
        "dims or centroid have not 3 components": (F.size("dims") != 3) | (F.size("centroid") != 3),
        "label is not known": ~F.col("label").isin(*CLUSTER_LABELS),
    }


def violations(df: DataFrame, kind: str) -> DataFrame:
    """``df`` with ``faults``, the checks a row fails; only rows that fail one."""
    faults = {"plane": _plane_faults, "cluster": _cluster_faults}[kind]()
    told = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in faults.items()]), lambda x: x.isNotNull())
    return df.withColumn("faults", told).where(F.size("faults") > 0)


def require_valid(df: DataFrame, kind: str) -> DataFrame:
    """``df``, or ValueError naming the first faults."""
    bad = violations(df, kind).select("faults").head(3)
    if bad:
        raise ValueError(f"invalid {kind} rows: {'; '.join(', '.join(r['faults']) for r in bad)}")
    return df
