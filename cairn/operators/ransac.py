"""Planes by consensus of deterministic samples, in all scenes at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.config import Ransac
from cairn.functions.bounded import broadcast_if_small, small_table
from cairn.functions.geometry import canonical_sign, cross, plane_distance, vector
from cairn.functions.lineage import stash
from cairn.operators.dbscan import largest_component
from cairn.operators.neighbours import POINT_KEY
from cairn.operators.normals import AXES, covariances, eigen
from cairn.operators.summaries import plane_summary

#: Modulus and multiplier of the sampling order (whole numbers, portable to any SQL engine);
#: what the seed moves by when a scene's points are ordered again.
MODULUS, MULTIPLIER, AGAIN = 2147483647, 48271, 7919


def sample_order(seed: int | Column) -> Column:
    """Rank key of a point: the square keeps seeds from being rotations of one another."""
    point = F.pmod(F.col("point_id").cast("long"), F.lit(MODULUS).cast("long"))  # small enough to multiply
    h = (point * MULTIPLIER + seed) % MODULUS
    return (h * h + point) % MODULUS


def hypotheses(points: DataFrame, iterations: int, seed: int = 0, samples: int = 3) -> DataFrame:
    """(scene_id, hypothesis, model): planes through consecutive groups of ``samples`` points of the sampling order.

    Only the first samples * iterations points of each scene are ranked (a group limit
    before the shuffle).  A scene of fewer points is ordered again, each time with another
    seed, until it has as many groups.  Collinear groups are left out.  More than three
    points have the plane of least squares.
    """
    sizes = small_table(points.groupBy("scene_id").agg(F.floor(F.count("*") / samples).cast("int").alias("groups")).where("groups > 0"))
    turns = F.least(F.ceil(F.lit(iterations) / F.col("groups")).cast("int"), F.lit(iterations))
    dealt = points.select(*POINT_KEY, "x", "y", "z").join(sizes, "scene_id").withColumn("turn", F.explode(F.sequence(F.lit(0), turns - 1)))
    order = W.partitionBy("scene_id", "turn").orderBy(sample_order(F.lit(seed) + F.col("turn") * AGAIN), "point_id")
    drawn = dealt.withColumn("rn", F.row_number().over(order) - 1).where(F.col("rn") < samples * iterations).where(F.col("rn") < samples * F.col("groups"))
    drawn = drawn.withColumn("hypothesis", F.col("turn") * F.col("groups") + F.floor(F.col("rn") / samples).cast("int")).where(F.col("hypothesis") < iterations)
    group = drawn.groupBy("scene_id", "hypothesis")
    if samples == 3:
        corners = group.agg(*[F.max(F.when(F.col("rn") % 3 == k, F.col(c))).alias(f"{c}{k}") for k in range(3) for c in "xyz"])
        p, q, r = ([F.col(f"{c}{k}") for c in "xyz"] for k in range(3))
        named = corners.withColumns({f"n{k}": c for k, c in enumerate(cross([b - a for a, b in zip(p, q)], [b - a for a, b in zip(p, r)]))})
        raw = [F.col("n0"), F.col("n1"), F.col("n2")]
        named = named.withColumn("size", F.sqrt(raw[0] * raw[0] + raw[1] * raw[1] + raw[2] * raw[2])).where("size >= 1e-9")
        named = named.withColumns({f"u{k}": c / F.col("size") for k, c in enumerate(raw)})
    else:
        fitted = group.agg(*[F.avg(c).alias(f"{c}0") for c in "xyz"], *covariances()).withColumn("e", eigen(*AXES))
        p = [F.col(f"{c}0") for c in "xyz"]
        named = fitted.where(F.col("e.values")[1] > 1e-12 * F.col("e.values")[2]).withColumns({f"u{k}": F.col("e.vectors")[k] for k in range(3)})
    sign = canonical_sign([F.col("u0"), F.col("u1"), F.col("u2")])
    named = named.withColumns({f"w{k}": sign * F.col(f"u{k}") for k in range(3)})
    d = -(F.col("w0") * p[0] + F.col("w1") * p[1] + F.col("w2") * p[2])
    return named.select("scene_id", "hypothesis", vector("w0", "w1", "w2", d).alias("model"))


def best_planes(points: DataFrame, distance: float, iterations: int, seed: int = 0, samples: int = 3) -> DataFrame:
    """(scene_id, hypothesis, model, n_inliers): the plane with most points within ``distance``.

    Equal counts go to the smaller hypothesis.  Scoring joins points with their scene's
    planes, at most ``iterations`` of them, and counts on the map side.
    """
    planes = small_table(hypotheses(points, iterations, seed, samples))
    hit = points.select("scene_id", "x", "y", "z").join(planes, "scene_id").where(plane_distance(F.col("model")) <= F.lit(float(distance)))
    score = hit.groupBy("scene_id", "hypothesis").agg(F.count("*").alias("n_inliers"))  # a hash aggregate: models are joined after
    best = score.groupBy("scene_id").agg(F.min(F.struct((-F.col("n_inliers")).alias("less"), "hypothesis")).alias("best"))
    best = best.select("scene_id", "best.hypothesis", (-F.col("best.less")).alias("n_inliers"))
    return best.join(planes, ["scene_id", "hypothesis"]).select("scene_id", "hypothesis", "model", "n_inliers")


def inliers(points: DataFrame, planes: DataFrame, distance: float) -> DataFrame:
    """Points of each scene within ``distance`` of its plane, their columns unchanged."""
    one = broadcast_if_small(planes.select("scene_id", "model"))
    return points.join(one, "scene_id").where(plane_distance(F.col("model")) <= F.lit(float(distance))).select(*points.columns)


def take(points: DataFrame, index: DataFrame) -> DataFrame:
    """The points that an index of (scene_id, point_id) lists."""
    return points.join(index.select(*POINT_KEY), list(POINT_KEY), "left_semi")


def take_rest(points: DataFrame, index: DataFrame) -> DataFrame:
    """The points that an index does not list."""
    return points.join(index.select(*POINT_KEY), list(POINT_KEY), "left_anti")


def extract_planes(points: DataFrame, config: Ransac | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Plane after plane from each scene: (planes, members, residual).

    A round in every scene that is still going: stop at fewer than max(remaining,
    ransac_n) points; fit; stop if the plane has fewer than ``min_plane_size`` inliers; take *all*
    inliers off the residual.  After the rounds, the largest component of each plane's
    inliers is kept, of all planes in one clustering; ``planes`` also counts what that
    drops (``n_dropped``).  The driver learns one number a round: whether any scene goes on.
    """
    config = config or Ransac()
    residual = stash(points)
    going = residual.select("scene_id").distinct()
    least = max(config.remaining_points_min, config.ransac_n)
    planes, inlying = [], []
    for k in range(config.max_planes):
        sizes = residual.join(going, "scene_id", "left_semi").groupBy("scene_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
        active = residual.join(small_table(sizes.select("scene_id")), "scene_id", "left_semi")
        best = best_planes(active, config.distance_threshold, config.num_iterations, config.seed + k, config.ransac_n)
        best = stash(best.where(F.col("n_inliers") >= config.min_plane_size))
        if best.isEmpty():
            break
        going = best.select("scene_id")
        hit = stash(inliers(active, best, config.distance_threshold))
        residual = stash(take_rest(residual, hit))
        planes.append(best.withColumn("plane_id", F.lit(k)))
        inlying.append(hit.withColumn("plane_id", F.lit(k)))
    spark = points.sparkSession
    if not planes:
        from cairn.schemas import PLANE

        none = spark.createDataFrame([], PLANE).withColumn("n_dropped", F.lit(0).cast("bigint"))
        return none, points.limit(0).withColumn("plane_id", F.lit(0)), residual
    found, hits = planes[0], inlying[0]
    for p, m in zip(planes[1:], inlying[1:]):
        found, hits = found.unionByName(p), hits.unionByName(m)
    apart = hits.withColumn("home", F.col("scene_id")).withColumn("scene_id", F.concat_ws(":", "plane_id", "scene_id"))
    owned = stash(largest_component(apart, 5 * config.distance_threshold, 10).withColumn("scene_id", F.col("home")).drop("home"))
    told = found.join(plane_summary(owned), ["scene_id", "plane_id"]).select(
        "scene_id", "plane_id", F.lit("unknown").alias("label"), "inlier_count", "centroid_z", F.slice("model", 1, 3).alias("normal"),
        F.col("model").alias("plane_model"), (F.col("n_inliers") - F.col("inlier_count")).alias("n_dropped"))
    return told, owned, residual
