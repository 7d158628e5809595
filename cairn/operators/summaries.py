"""Summaries of labelled points: clusters, planes, regions, and their boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.geometry import vector, yaw
from cairn.functions.ranks import grouped_percentile
from cairn.operators.normals import AXES, covariances, eigen


def box() -> list[Column]:
    """Axis-aligned box of a group: corners, dimensions, z range, footprint, centroid."""
    low, high = [F.min(c) for c in "xyz"], [F.max(c) for c in "xyz"]
    dims = [b - a for a, b in zip(low, high)]
    return [
        vector(*low).alias("aabb_min"), vector(*high).alias("aabb_max"), vector(*dims).alias("dims"),
        vector(*[F.avg(c) for c in "xyz"]).alias("centroid"), low[2].alias("z_min"), high[2].alias("z_max"), (dims[0] * dims[1]).alias("footprint_m2")]


def cluster_summary(members: DataFrame, key: str = "cluster_id") -> DataFrame:
    """One row for each cluster of (scene_id, key, x, y, z)."""
    return members.groupBy("scene_id", key).agg(F.count("*").alias("n_points"), *box())


def large_enough(clusters: DataFrame, least: int) -> DataFrame:
    return clusters.where(F.col("n_points") >= least)


def small_enough(clusters: DataFrame, most: float) -> DataFrame:
    """Clusters none of whose dimensions is over ``most``."""
    return clusters.where(~F.exists("dims", lambda d: d > most))


def by_size(clusters: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Most points first; equals in order of their id."""
    return clusters.orderBy("scene_id", F.desc("n_points"), key)


def ranked_by_size(clusters: DataFrame, key: str = "cluster_id") -> DataFrame:
    """All clusters with their ``rank`` (from 1) in the scene: most points first, equals in order of their id.

    A scene's clusters are ranked in one task.
    """
    order = W.partitionBy("scene_id").orderBy(F.desc("n_points"), key)
    return clusters.withColumn("rank", F.row_number().over(order).cast("long"))


def plane_summary(members: DataFrame, key: str = "plane_id") -> DataFrame:
    """(scene_id, key, inlier_count, centroid_z): count and exact median height of the members."""
    middle = grouped_percentile(members, ["scene_id", key], "z", 0.5, "centroid_z")
    return members.groupBy("scene_id", key).agg(F.count("*").alias("inlier_count")).join(middle, ["scene_id", key])


def region_summary(members: DataFrame) -> DataFrame:
    """One row for each region; ``normal`` is the mean normal, to unit length if it is not zero."""
    middle = grouped_percentile(members, ["scene_id", "region_id"], "z", 0.5, "centroid_z")
    found = members.groupBy("scene_id", "region_id").agg(
        F.count("*").alias("n_points"), *[F.avg(f"n{c}").alias(f"n{c}") for c in "xyz"], *box()).join(middle, ["scene_id", "region_id"])
    size = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    unit = [F.when(size > 1e-9, F.col(f"n{c}") / size).otherwise(F.col(f"n{c}")) for c in "xyz"]
    return found.select("scene_id", "region_id", "n_points", "centroid", "centroid_z", "dims", vector(*unit).alias("normal"), "z_min", "z_max", "footprint_m2")


def oriented_boxes(members: DataFrame, key: str = "cluster_id") -> DataFrame:
    """(scene_id, key, obb_extent, obb_rotation_deg, obb_axes): box along the principal axes.

    Axes are eigenvectors of the covariance, largest variance first, turned so that their
    largest component is positive, the last one so that the frame is right-handed.  A
    group of fewer than 4 points gets its axis-aligned dimensions, rotation 0, no axes.
    Two aggregations over the members; only the small matrices leave the JVM.
    """
    frame = members.groupBy("scene_id", key).agg(F.count("*").alias("n"), vector(*[F.max(c) - F.min(c) for c in "xyz"]).alias("plain"), *covariances())
    frame = frame.withColumn("e", eigen(*AXES)).withColumn("v", F.col("e.vectors"))

    def turned(k: int) -> list[Column]:
        part = [F.col("v")[3 * k + i] for i in range(3)]
        size = [F.abs(p) for p in part]
        lead = F.when((size[0] >= size[1]) & (size[0] >= size[2]), part[0]).when(size[1] >= size[2], part[1]).otherwise(part[2])
        return [F.when(lead < 0, -p).otherwise(p) for p in part]

    frame = frame.withColumns({f"a{i}": c for i, c in enumerate(turned(2))} | {f"b{i}": c for i, c in enumerate(turned(1))})
    a, b = ([F.col(f"{n}{i}") for i in range(3)] for n in "ab")
    third = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    frame = frame.withColumns({f"c{i}": c for i, c in enumerate(third)})
    frame = frame.select("scene_id", key, "n", "plain", *[f"{n}{i}" for n in "abc" for i in range(3)])
    along = members.join(frame, ["scene_id", key]).select("scene_id", key, *[
        (F.col("x") * F.col(f"{n}0") + F.col("y") * F.col(f"{n}1") + F.col("z") * F.col(f"{n}2")).alias(f"p{n}") for n in "abc"])
    extent = along.groupBy("scene_id", key).agg(vector(*[F.max(f"p{n}") - F.min(f"p{n}") for n in "abc"]).alias("extent"))
    whole = F.col("n") >= 4
    return frame.join(extent, ["scene_id", key]).select(
        "scene_id", key, F.when(whole, F.col("extent")).otherwise(F.col("plain")).alias("obb_extent"),
        F.when(whole, yaw(F.col("a1"), F.col("a0"))).otherwise(0.0).alias("obb_rotation_deg"),
        F.when(whole, vector(*[f"{n}{i}" for n in "abc" for i in range(3)])).alias("obb_axes"))


def with_boxes(clusters: DataFrame, members: DataFrame, key: str = "cluster_id") -> DataFrame:
    """``clusters`` with their oriented boxes."""
    return clusters.join(oriented_boxes(members, key), ["scene_id", key], "left")
