"""Surface normals and curvature from local neighbourhoods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.geometry import canonical_sign, dot
from cairn.operators.neighbours import POINT_KEY, hybrid_neighbours, nearest_neighbours

AXES = ("xx", "xy", "xz", "yy", "yz", "zz")


def covariances(x: str = "x", y: str = "y", z: str = "z") -> list[Column]:
    """The six population covariances of a group; they combine on the map side."""
    by = {"x": x, "y": y, "z": z}
    return [F.covar_pop(by[a[0]], by[a[1]]).alias(a) for a in AXES]


_EIGEN = T.StructType([T.StructField("values", T.ArrayType(T.DoubleType())), T.StructField("vectors", T.ArrayType(T.DoubleType()))])


@F.pandas_udf(_EIGEN)
def eigen(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    """Eigenvalues, ascending, and unit eigenvectors, one after the other, of symmetric matrices."""
    for xx, xy, xz, yy, yz, zz in parts:
        m = np.stack([np.stack([xx, xy, xz], -1), np.stack([xy, yy, yz], -1), np.stack([xz, yz, zz], -1)], -2).astype(float)
        values, vectors = np.linalg.eigh(np.nan_to_num(m))
        yield pd.DataFrame({"values": list(values), "vectors": list(np.swapaxes(vectors, 1, 2).reshape(-1, 9))})


def estimate_normals(points: DataFrame, radius: float = 0.1, most: int = 30) -> DataFrame:
    """``points`` with nx, ny, nz: the direction of least variance among the neighbours.

    Neighbours are the ``most`` nearest within ``radius``, itself included; fewer than 3
    give (0, 0, 1).  Directions are turned so that nz >= 0, then ny, then nx.
    """
    near = hybrid_neighbours(points, radius, most)
    at = points.select("scene_id", F.col("point_id").alias("nbr_id"), *[F.col(c).alias(f"p{c}") for c in "xyz"])
    local = near.join(at, ["scene_id", "nbr_id"]).groupBy(*POINT_KEY).agg(F.count("*").alias("n"), *covariances("px", "py", "pz"))
    found = local.withColumn("e", eigen(*AXES)).select(*POINT_KEY, "n", *[F.col("e.vectors")[k].alias(c) for k, c in enumerate("uvw")])
    sign = canonical_sign([F.col("u"), F.col("v"), F.col("w")])
    flat = F.col("n") < 3
    normal = found.select(*POINT_KEY, F.when(flat, 0.0).otherwise(sign * F.col("u")).alias("nx"),
                          F.when(flat, 0.0).otherwise(sign * F.col("v")).alias("ny"), F.when(flat, 1.0).otherwise(sign * F.col("w")).alias("nz"))
    return points.drop("nx", "ny", "nz").join(normal, list(POINT_KEY))


def curvature(points: DataFrame, k: int = 30, near: DataFrame | None = None) -> DataFrame:
    """(scene_id, point_id, curvature): 1 - mean |n . m| over the k - 1 nearest other points.

    A point without neighbours has curvature 1.  ``near`` spares the search if it is known.
    """
    near = nearest_neighbours(points, k - 1) if near is None else near
    mine = points.select(*POINT_KEY, "nx", "ny", "nz")
    other = points.select("scene_id", F.col("point_id").alias("nbr_id"), *[F.col(f"n{c}").alias(f"m{c}") for c in "xyz"])
    bent = near.join(other, ["scene_id", "nbr_id"]).join(mine, list(POINT_KEY))
    bent = bent.groupBy(*POINT_KEY).agg((1 - F.avg(F.abs(dot(["nx", "ny", "nz"], ["mx", "my", "mz"])))).alias("curvature"))
    return points.select(*POINT_KEY).join(bent, list(POINT_KEY), "left").withColumn("curvature", F.coalesce("curvature", F.lit(1.0)))
