"""Density clustering: neighbourhood join, core points, components, border points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.components import connected_components
from cairn.functions.lineage import stash
from cairn.operators.neighbours import POINT_KEY, radius_pairs

#: Edges between core points up to which components are found on the driver.
SMALL_GRAPH = 100_000


def dbscan(points: DataFrame, eps: float, min_points: int) -> DataFrame:
    """(scene_id, point_id, cluster_id): -1 is noise.

    A core point has ``min_points`` points within ``eps``, itself included.  Clusters are
    components of core points, numbered from 0 in order of their least core point; a
    border point joins the least numbered cluster that reaches it.
    """
    pairs = stash(radius_pairs(points, eps).select(*POINT_KEY, "nbr_id"))
    core = stash(pairs.groupBy(*POINT_KEY).agg(F.count("*").alias("n")).where(F.col("n") >= min_points).select(*POINT_KEY))
    reached = pairs.join(core.withColumnRenamed("point_id", "nbr_id"), ["scene_id", "nbr_id"])  # neighbour is core
    node = lambda c: F.struct("scene_id", F.col(c).alias("point_id"))
    edges = reached.join(core, list(POINT_KEY)).where("point_id > nbr_id").select(node("point_id").alias("a"), node("nbr_id").alias("b"))
    parts = connected_components(edges, gather=SMALL_GRAPH).select("node.*", F.col("component.point_id").alias("root"))
    cores = core.join(parts, list(POINT_KEY), "left").withColumn("root", F.coalesce("root", "point_id"))
    ids = cores.select("scene_id", "root").distinct().withColumn(
        "cluster_id", (F.row_number().over(W.partitionBy("scene_id").orderBy("root")) - 1).cast("int"))
    cores = stash(cores.join(ids, ["scene_id", "root"]).select(*POINT_KEY, "cluster_id"))
    border = (
        reached.join(core, list(POINT_KEY), "left_anti")
        .join(cores.withColumnRenamed("point_id", "nbr_id"), ["scene_id", "nbr_id"])
        .groupBy(*POINT_KEY).agg(F.min("cluster_id").alias("cluster_id"))
    )
    known = cores.unionByName(border)
    return points.select(*POINT_KEY).join(known, list(POINT_KEY), "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))


def largest_component(points: DataFrame, eps: float, min_points: int = 10) -> DataFrame:
    """The points of the most frequent cluster, the least numbered of equals.

    Scenes of fewer than ``min_points`` points, and those that are all noise, stay whole.
    """
    labels = dbscan(points, eps, min_points)
    sizes = labels.where("cluster_id >= 0").groupBy("scene_id", "cluster_id").agg(F.count("*").alias("n"))
    best = sizes.groupBy("scene_id").agg(F.min_by("cluster_id", F.struct(-F.col("n"), F.col("cluster_id"))).alias("best"))
    few = points.groupBy("scene_id").agg((F.count("*") < min_points).alias("few"))
    kept = labels.join(few, "scene_id").join(best, "scene_id", "left").where("few or best is null or cluster_id = best")
    return points.join(kept.select(*POINT_KEY), list(POINT_KEY), "left_semi")
