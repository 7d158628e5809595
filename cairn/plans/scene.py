"""The scene pipeline: many scenes in one run, stage after stage."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from cairn.config import PipelineConfig
from cairn.functions.lineage import stash
from cairn.operators.labels import label_clusters, label_planes
from cairn.operators.normals import estimate_normals
from cairn.operators.objects import object_clusters
from cairn.operators.outliers import statistical_outliers
from cairn.operators.ransac import extract_planes
from cairn.operators.stats import normalize_floor, scene_height, scene_stats
from cairn.operators.summaries import with_boxes
from cairn.operators.voxel import voxel_downsample
from cairn.schemas import points as as_points
from cairn.schemas import require_valid
from cairn.sinks import writers
from cairn.sources.load import load_cloud

log = logging.getLogger(__name__)


@dataclass
class Segmentation:
    """Tables of a run; ``seconds`` by stage, each of which is forced when it is timed."""

    stats: DataFrame
    clean: DataFrame
    outliers: DataFrame
    planes: DataFrame
    plane_members: DataFrame
    residual: DataFrame
    clusters: DataFrame
    cluster_members: DataFrame
    seconds: dict[str, float] = field(default_factory=dict)

    def merged(self) -> DataFrame:
        """All labelled points, coloured."""
        return writers.merge_clouds(self.plane_members, self.planes, self.cluster_members, self.clusters)


def segment(points: DataFrame, config: PipelineConfig | None = None, normals: bool = True) -> Segmentation:
    """Statistics, floor to 0, voxels, outliers, normals, planes, objects, labels, boxes.

    The statistics are those of the points as they come; a scene's height is that of its
    cleaned points.
    """
    config, points = config or PipelineConfig(), as_points(points)
    seconds, began = {}, time.monotonic()

    def done(stage: str) -> None:
        nonlocal began
        seconds[stage] = time.monotonic() - began
        began = time.monotonic()
        log.info("%s: %.1f s", stage, seconds[stage])

    stats = stash(scene_stats(points))
    done("statistics")
    pre = config.preprocessing
    small = stash(voxel_downsample(normalize_floor(points), pre.voxel_size))
    done("voxels")
    clean, outliers = statistical_outliers(small, pre.sor.nb_neighbors, pre.sor.std_ratio)
    clean, outliers = stash(clean), stash(outliers)
    done("outliers")
    if normals:
        clean = stash(estimate_normals(clean, pre.normal_estimation.radius, pre.normal_estimation.max_nn))
        done("normals")
    planes, plane_members, residual = extract_planes(clean, config.ransac)
    done("planes")
    clusters, cluster_members = object_clusters(residual, config.dbscan)
    cluster_members = stash(cluster_members)
    clusters = stash(clusters)
    done("objects")
    planes = require_valid(stash(label_planes(planes, scene_height(clean), config.labeling)), "plane")
    clusters = require_valid(stash(with_boxes(label_clusters(clusters, config.labeling), cluster_members)), "cluster")
    done("labels")
    return Segmentation(stats, clean, outliers, planes, plane_members, residual, clusters, cluster_members, seconds)


def run(spark: SparkSession, path: str, config: PipelineConfig | None = None, topdown: bool = True) -> Segmentation:
    """From a file to files: cloud, report, and the map's layers."""
    config = config or PipelineConfig()
    found = segment(load_cloud(spark, path), config)
    if not (found.planes.isEmpty() and found.clusters.isEmpty()):
        writers.write_ply(found.merged(), config.output.ply)
    writers.write_report(found.planes, found.clusters, config.output.report)
    if topdown:
        layers = writers.topdown_layers(found.plane_members, found.planes, found.cluster_members, found.clusters)
        writers.write_topdown(layers, config.output.topdown)
    return found
