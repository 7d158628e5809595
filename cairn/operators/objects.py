"""Objects: density clusters that pass the size filters, summarised and ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.config import Dbscan
from cairn.operators.dbscan import dbscan
from cairn.operators.neighbours import POINT_KEY
from cairn.operators.summaries import cluster_summary, large_enough, small_enough


def object_clusters(points: DataFrame, config: Dbscan | None = None) -> tuple[DataFrame, DataFrame]:
    """(clusters, members): ids are those of the clustering, so filtered ones leave gaps.

    Scenes of fewer than 2 points have none.
    """
    config = config or Dbscan()
    many = points.groupBy("scene_id").agg(F.count("*").alias("n")).where("n >= 2").select("scene_id")
    points = points.join(many, "scene_id", "left_semi")
    members = points.join(dbscan(points, config.eps, config.min_points).where("cluster_id >= 0"), list(POINT_KEY))
    clusters = small_enough(large_enough(cluster_summary(members), config.min_cluster_points), config.max_object_size)
    return clusters, members.join(clusters.select("scene_id", "cluster_id"), ["scene_id", "cluster_id"], "left_semi")
