"""Neighbourhoods: a distance predicate rewritten as an equi-join on grid cells.

Points fall into cells as wide as the radius, so a neighbour lies in one of 27 cells.
One side is exploded to those cells and the join is a hash or merge join on integer
keys, which AQE can split where cells are dense; Catalyst has no such rewrite and
would plan the bare predicate as a nested loop over all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.bounded import broadcast_if_small, small_table
from cairn.functions.geometry import squared_distance
from cairn.functions.lineage import settle, stash

OFFSETS = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
POINT_KEY = ("scene_id", "point_id")


def _cell(c: str, width: Column) -> Column:
    return F.floor(F.col(c) / width).cast("bigint")


def _near(left: DataFrame, right: DataFrame, radius: Column) -> DataFrame:
    """(scene_id, point_id, nbr_id, d2, ...left's other columns) with d2 <= radius squared, self included.

    ``radius`` is an expression that both sides can evaluate, constant in a scene.
    """
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i, j, k in OFFSETS]))
    wide = left.withColumn("o", steps).withColumns({
        f"c{c}": _cell(c, radius) + F.col(f"o.{s}") for c, s in zip("xyz", "ijk")}).drop("o")
    other = right.select("scene_id", F.col("point_id").alias("nbr_id"), *[F.col(c).alias(f"n{c}") for c in "xyz"],
                         *[_cell(c, radius).alias(f"c{c}") for c in "xyz"])
    met = wide.join(other, ["scene_id", "cx", "cy", "cz"]).withColumn("d2", squared_distance())
    return met.where(F.col("d2") <= radius * radius).drop("cx", "cy", "cz", "nx", "ny", "nz")


def radius_pairs(points: DataFrame, radius: float) -> DataFrame:
    """All ordered pairs within ``radius``, each point with itself included."""
    at = points.select(*POINT_KEY, "x", "y", "z")
    return _near(at, at, F.lit(float(radius))).select(*POINT_KEY, "nbr_id", "d2")


def radius_count(points: DataFrame, radius: float) -> DataFrame:
    """(scene_id, point_id, n_neighbours): other points within ``radius``."""
    return radius_pairs(points, radius).groupBy(*POINT_KEY).agg((F.count("*") - 1).alias("n_neighbours"))


def hybrid_neighbours(points: DataFrame, radius: float, most: int) -> DataFrame:
    """The ``most`` nearest within ``radius``, the point itself included (rank from 1).

    Where points lie dense, the search starts from a smaller radius and grows up to
    ``radius`` for the points that have not found ``most`` within it, so that its work is
    by the neighbours asked for and not by all that lie within ``radius``.
    """
    return settle(points.sparkSession, lambda: _hybrid(points, radius, most))


def _hybrid(points: DataFrame, radius: float, most: int) -> DataFrame:
    at = stash(points.select(*POINT_KEY, "x", "y", "z"))
    limit = F.lit(float(radius))
    scenes = stash(_first_radius(at, most).select("scene_id", F.least("radius", limit).alias("radius")))
    at = stash(at.join(broadcast_if_small(scenes), "scene_id"))
    left, done, factor = at, [], 1.0
    by_distance = W.partitionBy(*POINT_KEY).orderBy("d2", F.col("nbr_id") != F.col("point_id"), "nbr_id")
    while True:
        within = F.least(F.col("radius") * F.lit(factor), limit)
        met = _near(left, at, within).withColumn("last", within >= limit).select(*POINT_KEY, "nbr_id", "d2", "last")
        met = stash(met.withColumn("rank", F.row_number().over(by_distance)).where(F.col("rank") <= most))
        full = met.where(F.col("rank") == most).select(*POINT_KEY)
        done.append(met.where("last").unionByName(met.where("not last").join(full, list(POINT_KEY), "left_semi")).drop("last"))
        left = stash(left.where(within < limit).join(full, list(POINT_KEY), "left_anti"))
        if left.isEmpty():
            break
        factor = 2 if factor == 1 else factor**2  # few are left now; any limit is reached in a few rounds
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


#: Halvings of a scene's extent among which its first radius is found.
HALVINGS = 20


def _first_radius(at: DataFrame, k: int) -> DataFrame:
    """(scene_id, n, radius): the least width, by halving the extent, at which occupied cells hold (k + 1) / 4 points on average.

    Counting occupied cells tells how dense points lie where there are any, so stray
    points, which stretch the extent, do not widen the radius.
    """
    span = F.greatest(*[F.max(c) - F.min(c) for c in "xyz"], F.lit(1e-9))
    scenes = at.groupBy("scene_id").agg(F.count("*").alias("n"), span.alias("extent"), *[F.min(c).alias(f"{c}0") for c in "xyz"])
    scenes = small_table(scenes)
    width = lambda h: F.col("extent") / F.lit(float(1 << h))
    cell = lambda h: F.xxhash64(*[F.floor((F.col(c) - F.col(f"{c}0")) / width(h)) for c in "xyz"])
    used = at.join(scenes, "scene_id").groupBy("scene_id", "n", "extent").agg(*[F.approx_count_distinct(cell(h)).alias(f"u{h}") for h in range(1, HALVINGS + 1)])
    radius = F.col("extent")
    for h in range(1, HALVINGS + 1):
        radius = F.when(F.col("n") >= F.lit((k + 1) / 4) * F.col(f"u{h}"), width(h)).otherwise(radius)
    return used.select("scene_id", "n", radius.alias("radius"))


def nearest_neighbours(points: DataFrame, k: int) -> DataFrame:
    """Exact k nearest other points: (scene_id, point_id, nbr_id, d2, rank from 1), ties to the smaller id.

    The radius starts from how dense the scene's points lie, and grows for the points that
    have not found k neighbours within it; a point whose scene has fewer gets all there
    are.  Rows that share an id are one point at several places: none is a neighbour of
    the others, and the distance between two points is the least between their places.
    """
    return settle(points.sparkSession, lambda: _nearest(points, k))


def _nearest(points: DataFrame, k: int) -> DataFrame:
    at = stash(points.select(*POINT_KEY, "x", "y", "z"))
    ids = at.groupBy(*POINT_KEY).agg(F.count("*").alias("rows")).groupBy("scene_id").agg((F.count("*") - 1).alias("others"), F.max("rows").alias("rows"))
    scenes = stash(_first_radius(at, k).join(ids, "scene_id"))
    repeated = not scenes.where("rows > 1").isEmpty()
    scenes = scenes.select("scene_id", "radius", F.least("others", F.lit(k)).alias("want"))
    at = stash(at.join(broadcast_if_small(scenes), "scene_id"))
    left, done, factor = at.where("want > 0"), [], 1.0
    by_distance = W.partitionBy(*POINT_KEY).orderBy("d2", "nbr_id")
    while True:
        met = _near(left, at, F.col("radius") * F.lit(factor)).where("nbr_id != point_id").select(*POINT_KEY, "nbr_id", "d2", "want")
        if repeated:
            met = met.groupBy(*POINT_KEY, "nbr_id", "want").agg(F.min("d2").alias("d2"))
        met = stash(met.withColumn("rank", F.row_number().over(by_distance)).where(F.col("rank") <= k).select(*POINT_KEY, "nbr_id", "d2", "rank", "want"))
        full = met.where("rank = want").select(*POINT_KEY)
        done.append(met.join(full, list(POINT_KEY), "left_semi").drop("want"))
        left = stash(left.join(full, list(POINT_KEY), "left_anti"))
        if left.isEmpty():
            break
        factor *= 2 if factor == 1 else 4  # few are left now, mostly far from all others
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
