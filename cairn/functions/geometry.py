"""Column expressions of plane and vector geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def vector(*parts: str | Column) -> Column:
    return F.array(*[col(p).cast("double") for p in parts])


def dot(a: list[str | Column], b: list[str | Column]) -> Column:
    total = col(a[0]) * col(b[0])
    for p, q in zip(a[1:], b[1:]):
        total = total + col(p) * col(q)
    return total


def norm(parts: list[str | Column]) -> Column:
    return F.sqrt(dot(parts, parts))


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def canonical_sign(n: list[Column]) -> Column:
    """-1.0 where a direction is to be turned round: nz < 0, or nz = 0 and ny < 0, and so on."""
    x, y, z = n
    turned = (z < 0) | ((z == 0) & ((y < 0) | ((y == 0) & (x < 0))))
    return F.when(turned, F.lit(-1.0)).otherwise(F.lit(1.0))


def plane_distance(model: Column, x: str = "x", y: str = "y", z: str = "z") -> Column:
    """Distance of a point to a plane (a, b, c, d) with unit normal."""
    return F.abs(model[0] * F.col(x) + model[1] * F.col(y) + model[2] * F.col(z) + model[3])


def squared_distance(a: str = "", b: str = "n") -> Column:
    d = [F.col(f"{a}{c}") - F.col(f"{b}{c}") for c in ("x", "y", "z")]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def yaw(r10: Column, r00: Column) -> Column:
    """Rotation about z, in degrees, of a frame with that first column."""
    return F.degrees(F.atan2(r10, r00))
