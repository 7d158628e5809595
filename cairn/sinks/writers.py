"""Results as files: clouds, reports, map layers, labels."""

from __future__ import annotations

import json
import os
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.colours import MAP_COLOURS, colorize, colour

PART = ("scene_id", "point_id", "x", "y", "z", "r", "g", "b", "kind", "owner_id", "label")
#: A single file is written by the driver up to so many points.
MOST_IN_ONE_FILE = 20_000_000


def merge_clouds(plane_members: DataFrame, planes: DataFrame, cluster_members: DataFrame, clusters: DataFrame) -> DataFrame:
    """All points of planes, then of clusters, coloured by label; duplicates stay."""

    def side(members: DataFrame, owners: DataFrame, key: str, kind: str) -> DataFrame:
        named = members.drop("r", "g", "b", "label").join(owners.select("scene_id", key, "label"), ["scene_id", key])
        return colorize(named.withColumn("kind", F.lit(kind)).withColumn("owner_id", F.col(key))).select(*PART)

    return side(plane_members, planes, "plane_id", "plane").unionByName(side(cluster_members, clusters, "cluster_id", "cluster"))


def write_ply(points: DataFrame, path: str) -> str:
    """One binary .ply of x, y, z and 8-bit colours, in order of (scene_id, point_id).

    Rows stream through the driver.  ValueError for no points, and beyond
    ``MOST_IN_ONE_FILE`` (write Parquet then).
    """
    n = points.count()
    if not n:
        raise ValueError("nothing to export")
    if n > MOST_IN_ONE_FILE:
        raise ValueError(f"{n} points are too many for one file; write them as Parquet")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    colours = [F.coalesce(F.round(F.col(c) * 255), F.lit(128)).cast("int").alias(c) for c in "rgb"]
    with open(path, "wb") as f:
        head = ["ply", "format binary_little_endian 1.0", f"element vertex {n}", *[f"property double {c}" for c in "xyz"],
                *[f"property uchar {c}" for c in ("red", "green", "blue")], "end_header"]
        f.write(("\n".join(head) + "\n").encode())
        row = struct.Struct("<dddBBB")
        for r in points.orderBy("scene_id", "point_id").select("x", "y", "z", *colours).toLocalIterator(prefetchPartitions=True):
            f.write(row.pack(*r))
    return path


# The fields of a report.
PLANE_FIELDS = ("plane_id", "label", "inlier_count", "centroid_z", "normal", "plane_model")
OBJECT_FIELDS = ("cluster_id", "label", "confidence", "n_points", "point_density", "centroid", "dims", "z_min", "z_max", "footprint_m2",
                 "obb_extent", "obb_rotation_deg")


def segmentation_report(planes: DataFrame, clusters: DataFrame) -> DataFrame:
    """(scene_id, report): a JSON document for each scene, geometry left out."""
    part = lambda df, names, key: df.groupBy("scene_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col(key).alias("_order"), F.struct(*names).alias("row")))).alias("rows"))
    both = (
        part(planes, PLANE_FIELDS, "plane_id").withColumnRenamed("rows", "p")
        .join(part(clusters.withColumn("_size", F.struct(-F.col("n_points"), F.col("cluster_id"))), OBJECT_FIELDS, "_size").withColumnRenamed("rows", "c"), "scene_id", "full"))
    rows = lambda c: F.coalesce(F.transform(c, lambda x: x["row"]), F.array())
    document = F.struct(rows("p").alias("structural_planes"), rows("c").alias("objects"))
    return both.select("scene_id", F.to_json(document, {"ignoreNullFields": "false"}).alias("report"))


def write_report(planes: DataFrame, clusters: DataFrame, path: str) -> str:
    """The report as a file, indented: one scene's document, or a list of them by scene; empty lists if there is nothing."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    found = [json.loads(r["report"]) for r in segmentation_report(planes, clusters).orderBy("scene_id").toLocalIterator()]
    told = found[0] if len(found) == 1 else found or {"structural_planes": [], "objects": []}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(told, f, indent=4)
    return path


def map_extent(points: DataFrame, margin: float = 0.5) -> DataFrame:
    """(scene_id, x_min, y_min, x_max, y_max) of a map with its margin."""
    return points.groupBy("scene_id").agg(
        *[(F.min(c) - margin).alias(f"{c}_min") for c in "xy"], *[(F.max(c) + margin).alias(f"{c}_max") for c in "xy"])


def map_rectangles(clusters: DataFrame) -> DataFrame:
    """Footprints with their text and colour."""
    low, high = F.col("aabb_min"), F.col("aabb_max")
    return clusters.select(
        "scene_id", "cluster_id", "label", low[0].alias("x"), low[1].alias("y"), (high[0] - low[0]).alias("width"), (high[1] - low[1]).alias("depth"),
        F.col("centroid")[0].alias("text_x"), F.col("centroid")[1].alias("text_y"), *[colour(F.col("label"), k, MAP_COLOURS).alias(c) for k, c in enumerate("rgb")])


def topdown_layers(plane_members: DataFrame, planes: DataFrame, cluster_members: DataFrame, clusters: DataFrame) -> dict[str, DataFrame] | None:
    """Layers of the map from above: extent, wall points, rectangles; None if there is nothing to draw."""
    at = lambda df: df.select("scene_id", "x", "y")
    every = at(plane_members).unionByName(at(cluster_members))
    if every.isEmpty():
        return None
    walls = plane_members.drop("label").join(planes.where("label = 'wall'").select("scene_id", "plane_id"), ["scene_id", "plane_id"], "left_semi")
    return {"extent": map_extent(every), "walls": at(walls), "rectangles": map_rectangles(clusters)}


def write_topdown(layers: dict[str, DataFrame] | None, path: str) -> str | None:
    """Each layer as Parquet in a folder; None if there is nothing to draw."""
    if layers is None:
        return None
    for name, df in layers.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    return path


def write_labels(clusters: DataFrame, path: str) -> str:
    """Corrected labels: [{id: position by size, label}]."""
    rows = clusters.orderBy("scene_id", F.desc("n_points"), "cluster_id").select("label").toLocalIterator()
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump([{"id": k, "label": r["label"]} for k, r in enumerate(rows)], f, indent=2)
    return path
