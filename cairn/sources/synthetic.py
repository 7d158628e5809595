"""Synthetic rooms as DataFrames: seeded, generated in parallel, of any density."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Range = tuple[float, float]


def _uniform(span: Range, seed: int) -> Column:
    return F.lit(float(span[0])) + F.rand(seed) * F.lit(float(span[1]) - float(span[0]))


def _normal(size: float, seed: int) -> Column:
    return F.randn(seed) * F.lit(float(size))


def _part(spark: SparkSession, n: int, x: Column, y: Column, z: Column, part: str) -> DataFrame:
    return spark.range(n).select(F.lit(part).alias("part"), F.col("id").alias("n"), x.alias("x"), y.alias("y"), z.alias("z"))


def plane(spark: SparkSession, n: int, x: Range, y: Range, z: float, noise: float = 0.01, seed: int = 0, part: str = "plane") -> DataFrame:
    """Horizontal: uniform in x and y, noise along z."""
    s = 10 * seed
    return _part(spark, n, _uniform(x, s), _uniform(y, s + 1), F.lit(float(z)) + _normal(noise, s + 2), part)


def wall(spark: SparkSession, n: int, x: Range, y: Range, z: Range, noise: float = 0.01, seed: int = 0, part: str = "wall") -> DataFrame:
    """Vertical: at x[0] if the x range is a point, else at y[0]; noise across the wall alone."""
    s = 10 * seed
    if x[0] == x[1]:
        return _part(spark, n, F.lit(float(x[0])) + _normal(noise, s), _uniform(y, s + 1), _uniform(z, s + 2), part)
    return _part(spark, n, _uniform(x, s), F.lit(float(y[0])) + _normal(noise, s + 1), _uniform(z, s + 2), part)


def box(spark: SparkSession, n: int, x: Range, y: Range, z: Range, noise: float = 0.005, seed: int = 0, part: str = "box") -> DataFrame:
    """Uniform in the volume, noise along every axis."""
    s = 10 * seed
    return _part(spark, n, *[_uniform(r, s + k) + _normal(noise, s + 3 + k) for k, r in enumerate((x, y, z))], part)


def cylinder(spark: SparkSession, n: int, centre: tuple[float, float], radius: float, z: Range, noise: float = 0.005, seed: int = 0, part: str = "cylinder") -> DataFrame:
    """On the mantle: uniform in angle and height, noise in x and y."""
    s = 10 * seed
    angle = F.rand(s) * F.lit(2 * 3.141592653589793)
    x = F.lit(float(centre[0])) + F.cos(angle) * F.lit(float(radius)) + _normal(noise, s + 1)
    y = F.lit(float(centre[1])) + F.sin(angle) * F.lit(float(radius)) + _normal(noise, s + 2)
    return _part(spark, n, x, y, _uniform(z, s + 3), part)


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def rectangular_room(spark: SparkSession, width: float, length: float, height: float, density: int, seed: int = 0) -> DataFrame:
    """Floor, ceiling and four walls of ``density`` points each."""
    w, le, h = (0.0, width), (0.0, length), (0.0, height)
    flat = [plane(spark, density, w, le, at, seed=seed + k, part=name) for k, (name, at) in enumerate((("floor", 0.0), ("ceiling", height)))]
    sides = [((0.0, 0.0), le), ((width, width), le), (w, (0.0, 0.0)), (w, (length, length))]
    return _union(flat + [wall(spark, density, x, y, h, seed=seed + 2 + k) for k, (x, y) in enumerate(sides)])


def l_shaped_room(spark: SparkSession, width: float, length: float, height: float, density: int, seed: int = 0) -> DataFrame:
    """A main part of 0.6 length and an extension of half the width: ten surfaces.

    The extension's floor and ceiling and the three short walls have half the density.
    """
    main, half, h, few = 0.6 * length, 0.5 * width, (0.0, height), density // 2
    flats = [(density, (0.0, width), (0.0, main)), (few, (0.0, half), (main, length))]
    parts = []
    for n, x, y in flats:
        for name, at in (("floor", 0.0), ("ceiling", height)):
            parts.append(plane(spark, n, x, y, at, seed=seed + len(parts), part=name))
    walls = [
        (density, (0.0, 0.0), (0.0, length)), (density, (width, width), (0.0, main)), (few, (half, half), (main, length)),
        (density, (0.0, width), (0.0, 0.0)), (few, (0.0, half), (length, length)), (few, (half, width), (main, main))]
    for n, x, y in walls:
        parts.append(wall(spark, n, x, y, h, seed=seed + len(parts)))
    return _union(parts)


# Name, points, and the ranges of x, y and z of each piece.
FURNITURE = (
    ("desk", 5000, (1.0, 2.5), (1.0, 2.0), (0.0, 0.75)),
    ("chair", 2000, (1.0, 1.5), (2.3, 2.7), (0.0, 0.45)),
    ("monitor", 2000, (1.5, 2.0), (1.2, 1.5), (0.75, 1.1)),
    ("wardrobe", 8000, (3.5, 4.5), (4.0, 5.5), (0.0, 2.2)),
    ("bookshelf", 6000, (0.1, 0.4), (2.0, 3.5), (0.0, 1.8)),
    ("side_table", 1500, (3.0, 3.5), (1.0, 1.5), (0.0, 0.5)),
    ("ceiling_light", 1000, (2.2, 2.8), (2.7, 3.3), (2.8, 3.0)),
    ("wall_shelf", 1500, (4.0, 4.8), (0.1, 0.3), (1.2, 1.4)),
)
LAMP = ("floor_lamp", 1500, (4.7, 1.5), 0.1, (0.0, 1.6))


def furniture(spark: SparkSession, seed: int = 0, share: float = 1.0) -> DataFrame:
    """Eight boxes and a cylinder, 28,500 points at share 1."""
    parts = [box(spark, int(n * share), x, y, z, seed=seed + k, part=name) for k, (name, n, x, y, z) in enumerate(FURNITURE)]
    name, n, centre, radius, z = LAMP
    return _union([*parts, cylinder(spark, int(n * share), centre, radius, z, seed=seed + len(parts), part=name)])


def floating_noise(spark: SparkSession, side: float, n: int = 500, seed: int = 0) -> DataFrame:
    """Uniform in a cube."""
    return box(spark, n, (0, side), (0, side), (0, side), noise=0.0, seed=seed, part="noise")


def synthetic_room(spark: SparkSession, width: float = 5.0, length: float = 6.0, height: float = 3.0, density: int = 10_000,
                   layout: str = "rectangular", noise: bool = True, scene: str = "0", seed: int = 0, share: float = 1.0) -> DataFrame:
    """POINT rows of a furnished room, with ``part`` naming the surface or piece; grey, as float32."""
    room = {"rectangular": rectangular_room, "l-shaped": l_shaped_room}[layout](spark, width, length, height, density, seed)
    parts = [room, furniture(spark, seed + 20, share)]
    if noise:
        parts.append(floating_noise(spark, max(width, length, height), seed=seed + 40))
    all_ = _union(parts).withColumn("point_id", F.monotonically_increasing_id())
    grey = {c: F.lit(0.5) for c in "rgb"}
    rounded = {c: F.col(c).cast("float").cast("double") for c in "xyz"}
    named = all_.withColumns(grey | rounded).withColumn("scene_id", F.lit(scene))
    return named.select("scene_id", "point_id", "x", "y", "z", "r", "g", "b", "part")
