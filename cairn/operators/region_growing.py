"""Region growing: a greedy flood fill by normals, flattest seed first.

The order of the fill is part of its meaning, so a scene is filled by one task; what
it needs of each point (neighbours, normal, curvature) is computed by joins over all
tasks first.  ``smooth_regions`` is another operator with another meaning: components
of the similarity graph, which need no order and scale with the points of a scene.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.config import RegionGrowing
from cairn.functions.components import connected_components
from cairn.functions.geometry import dot
from cairn.functions.lineage import stash
from cairn.operators.neighbours import POINT_KEY, nearest_neighbours
from cairn.operators.normals import curvature

#: Scenes of fewer points are left whole.
LEAST_POINTS = 10


def _grow(config: RegionGrowing):
    limit = float(np.cos(np.radians(config.angle_threshold_deg)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["curvature", "point_id"], kind="stable").reset_index(drop=True)
        ids, bent = pdf.point_id.to_numpy(), pdf.curvature.to_numpy()
        normal = pdf[["nx", "ny", "nz"]].to_numpy(float)
        place = {p: k for k, p in enumerate(ids)}
        near = [[place[q] for q in row] if row is not None else [] for row in pdf.near]
        region = np.full(len(ids), -1)
        taken = np.zeros(len(ids), bool)
        found = 0
        for start in range(len(ids) if len(ids) >= LEAST_POINTS else 0):
            if taken[start]:
                continue
            if found >= config.max_regions:
                break
            taken[start] = True
            members, queue = [start], deque([start])
            while queue:
                seed = queue.popleft()
                for q in near[seed]:
                    if not taken[q] and abs(float(normal[seed] @ normal[q])) >= limit:
                        taken[q] = True
                        members.append(q)
                        if bent[q] < config.curvature_threshold:
                            queue.append(q)
            if len(members) >= config.min_region_size:
                region[members] = found
                found += 1
        return pd.DataFrame({"scene_id": pdf.scene_id, "point_id": ids, "region_id": region.astype("int32")})

    return run


def grow_regions(points: DataFrame, config: RegionGrowing | None = None) -> DataFrame:
    """(scene_id, point_id, region_id) from points with normals; -1 is the residual.

    Points of a region that stays too small are taken and go to the residual.
    """
    config, points = config or RegionGrowing(), stash(points)
    found = stash(nearest_neighbours(points, config.k_neighbours - 1))
    near = found.groupBy(*POINT_KEY).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "nbr_id"))), lambda x: x["nbr_id"]).alias("near"))
    bent = curvature(points, config.k_neighbours, found)
    rows = points.select(*POINT_KEY, "nx", "ny", "nz").join(bent, list(POINT_KEY)).join(near, list(POINT_KEY), "left")
    return rows.groupBy("scene_id").applyInPandas(_grow(config), "scene_id string, point_id long, region_id int")


def smooth_regions(points: DataFrame, config: RegionGrowing | None = None) -> DataFrame:
    """(scene_id, point_id, root): components over neighbours whose normals agree.  Not the greedy fill."""
    config, points = config or RegionGrowing(), stash(points)
    near = nearest_neighbours(points, config.k_neighbours - 1)
    mine = points.select(*POINT_KEY, "nx", "ny", "nz")
    other = points.select("scene_id", F.col("point_id").alias("nbr_id"), *[F.col(f"n{c}").alias(f"m{c}") for c in "xyz"])
    alike = near.join(mine, list(POINT_KEY)).join(other, ["scene_id", "nbr_id"]).where(
        F.abs(dot(["nx", "ny", "nz"], ["mx", "my", "mz"])) >= F.cos(F.radians(F.lit(config.angle_threshold_deg))))
    node = lambda c: F.struct("scene_id", F.col(c).alias("point_id"))
    parts = connected_components(alike.select(node("point_id").alias("a"), node("nbr_id").alias("b"))).select("node.*", F.col("component.point_id").alias("root"))
    return points.select(*POINT_KEY).join(parts, list(POINT_KEY), "left").withColumn("root", F.coalesce("root", "point_id"))
