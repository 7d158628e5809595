"""Semantic labels by geometric rules, as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.config import Labeling
from cairn.functions.geometry import norm

# Fixed values of the cluster rules.
ON_FLOOR, SEAT_LOW, SEAT_HIGH = 0.2, 0.4, 1.1
CHAIR_FOOTPRINT, CHAIR_ASPECT = (0.3, 0.8), 1.5
SHELF_ASPECT, SHELF_WIDTH, DENSE, BONUS = 3.0, 1.0, 50000, 0.1


def plane_label(normal: Column, centroid_z: Column, height: Column, rules: Labeling) -> Column:
    """floor, ceiling, horizontal_surface, wall or unknown."""
    n = [normal[k] for k in range(3)]
    size = norm(n)
    tilt = F.degrees(F.acos(F.least(F.abs(n[2]) / size, F.lit(1.0))))
    high = F.greatest(height, F.lit(0.1)) * F.lit(rules.ceiling_z_fraction)
    return (
        F.when(size < 1e-9, "unknown")
        .when(tilt < rules.horizontal_angle_deg, F.when(centroid_z < rules.floor_z_threshold, "floor").when(centroid_z > high, "ceiling").otherwise("horizontal_surface"))
        .when(tilt > rules.vertical_angle_deg, "wall").otherwise("unknown"))


def label_planes(planes: DataFrame, heights: DataFrame | float, rules: Labeling | None = None) -> DataFrame:
    """``planes`` with ``label``; ``heights`` is one height or (scene_id, scene_height)."""
    rules = rules or Labeling()
    if isinstance(heights, DataFrame):
        df = planes.join(heights, "scene_id", "left")
        height = F.coalesce("scene_height", F.lit(0.0))
    else:
        df, height = planes, F.lit(float(heights))
    return df.withColumn("label", plane_label(F.col("normal"), F.col("centroid_z"), height, rules)).drop("scene_height")


def _cases(rules: Labeling) -> tuple[Column, Column]:
    """(label, confidence before the density bonus)"""
    w, d, h = (F.col("dims")[k] for k in range(3))
    low, fp = F.col("z_min"), F.col("footprint_m2")
    narrow = F.least(w, d)
    aspect = F.when(narrow > 1e-3, F.greatest(w, d) / F.when(narrow > 1e-3, narrow)).otherwise(1.0)
    tall, high, small = (F.lit(v) for v in (rules.tall_furniture_min_h, rules.high_fixture_min_z, rules.small_object_max_footprint))
    seat = h.between(SEAT_LOW, SEAT_HIGH)
    table = [
        (low < ON_FLOOR, [
            (h > tall, "tall_furniture", F.least(h / tall, F.lit(1.0))),
            (seat & fp.between(*CHAIR_FOOTPRINT) & (aspect < CHAIR_ASPECT), "chair", F.lit(0.7)),
            (seat & (fp > CHAIR_FOOTPRINT[1]), "table", F.lit(0.8)),
            (seat, "furniture", F.lit(0.4)),
            (h < SEAT_LOW, "small_object", F.lit(0.6)),
            (None, "furniture", F.lit(0.3))]),
        (low < high, [
            ((aspect > SHELF_ASPECT) & (w > SHELF_WIDTH), "shelf", F.lit(0.7)),
            (fp < small, "small_object", F.lit(1.0) - fp / small),
            (None, "furniture", F.lit(0.5))]),
        (low >= high, [(None, "high_fixture", F.least(low / high, F.lit(1.0)))]),
    ]

    def pick(item: int, default: Column) -> Column:
        out = None
        for where, rows in table:
            inner = None
            for test, *values in rows:
                value = F.lit(values[item]) if isinstance(values[item], str) else values[item]
                if test is None:
                    inner = value if inner is None else inner.otherwise(value)
                else:
                    inner = F.when(test, value) if inner is None else inner.when(test, value)
            out = F.when(where, inner) if out is None else out.when(where, inner)
        return out.otherwise(default)

    return pick(0, F.lit("furniture")), pick(1, F.lit(0.5))


def label_clusters(clusters: DataFrame, rules: Labeling | None = None) -> DataFrame:
    """``clusters`` with ``label``, ``confidence`` and ``point_density``.

    Reads dims, z_min, footprint_m2 and n_points.  Rounding is half up.
    """
    rules = rules or Labeling()
    label, confidence = _cases(rules)
    volume = F.greatest(F.col("dims")[0] * F.col("dims")[1] * F.col("dims")[2], F.lit(1e-6))
    df = clusters.withColumn("point_density", F.round(F.col("n_points") / volume, 1)).withColumn("label", label)
    sure = F.when(F.col("point_density") > DENSE, F.least(confidence + BONUS, F.lit(1.0))).otherwise(confidence)
    return df.withColumn("confidence", F.round(sure, 2))


def label_counts(labelled: DataFrame) -> DataFrame:
    """(label, n)"""
    return labelled.groupBy("label").agg(F.count("*").alias("n"))


def override_labels(clusters: DataFrame, overrides: DataFrame, key: str = "cluster_id") -> DataFrame:
    """``clusters`` with the labels that (key, new_label) gives; others keep theirs."""
    return clusters.join(overrides.select(key, "new_label"), key, "left").withColumn("label", F.coalesce("new_label", "label")).drop("new_label")
