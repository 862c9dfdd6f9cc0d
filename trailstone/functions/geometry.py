"""Rigid-body and plane geometry as Column expressions (y points down in camera space, +z is forward)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def vec(x: str = "x", y: str = "y", z: str = "z") -> Vector:
    return F.col(x), F.col(y), F.col(z)


def const(*v: float) -> Vector:
    return tuple(F.lit(float(x)) for x in v)


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def sub(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def add(a: Vector, b: Vector) -> Vector:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def scale(a: Vector, k: Column) -> Vector:
    return tuple(x * k for x in a)


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def rotation(q: tuple[Column, Column, Column, Column]) -> tuple[Vector, Vector, Vector]:
    """Rows of the rotation matrix of an xyzw quaternion of any positive length; a zero quaternion is the identity."""
    x, y, z, w = q
    n = x * x + y * y + z * z + w * w
    s = F.when(n > 0, F.lit(2.0) / F.when(n > 0, n)).otherwise(F.lit(0.0))
    one = F.lit(1.0)
    return (
        (one - s * (y * y + z * z), s * (x * y - z * w), s * (x * z + y * w)),
        (s * (x * y + z * w), one - s * (x * x + z * z), s * (y * z - x * w)),
        (s * (x * z - y * w), s * (y * z + x * w), one - s * (x * x + y * y)),
    )


def pose_quaternion() -> tuple[Column, Column, Column, Column]:
    return F.col("qx"), F.col("qy"), F.col("qz"), F.col("qw")


def pose_position() -> Vector:
    return vec("tx", "ty", "tz")


def forward(q) -> Vector:
    """Viewing direction: the third column of the rotation."""
    r = rotation(q)
    return r[0][2], r[1][2], r[2][2]


def down(q) -> Vector:
    """Minus the second column of the rotation."""
    r = rotation(q)
    return -r[0][1], -r[1][1], -r[2][1]


def rotate(q, v: Vector) -> Vector:
    r = rotation(q)
    return tuple(dot(row, v) for row in r)


def rotate_back(q, v: Vector) -> Vector:
    r = rotation(q)
    return tuple(r[0][i] * v[0] + r[1][i] * v[1] + r[2][i] * v[2] for i in range(3))


def sim3_apply(q, t: Vector, s: Column, v: Vector) -> Vector:
    """Local point to world: s * R v + t."""
    return add(scale(rotate(q, v), s), t)


def sim3_invert(q, t: Vector, s: Column, v: Vector) -> Vector:
    """World point to local."""
    return scale(rotate_back(q, sub(v, t)), F.lit(1.0) / s)


def plane_distance(p: Vector, n: Vector, d: Column) -> Column:
    """|n.p - d| for a unit normal n."""
    return F.abs(dot(p, n) - d)


def project(p: Vector, n: Vector, d: Column) -> Vector:
    """Foot of p on the plane n.p = d."""
    return sub(p, scale(n, dot(p, n) - d))


def spherical(v: Vector) -> Vector:
    """(radius, azimuth, polar angle); all 0 at the origin."""
    r = norm(v)
    return r, F.atan2(v[1], v[0]), F.when(r > 0, F.acos(v[2] / F.when(r > 0, r))).otherwise(F.lit(0.0))


def cartesian(r: Column, azimuth: Column, polar: Column) -> Vector:
    return r * F.sin(polar) * F.cos(azimuth), r * F.sin(polar) * F.sin(azimuth), r * F.cos(polar)


def matrix_to_quaternion(m: tuple[Vector, Vector, Vector]) -> tuple[Column, Column, Column, Column]:
    """xyzw of a rotation matrix given by rows, by the largest of the four components."""
    (a, b, c), (d, e, f), (g, h, i) = m
    one = F.lit(1.0)
    root = lambda v: F.sqrt(F.greatest(v, F.lit(1e-300))) * 2
    sw, sx, sy, sz = root(one + a + e + i), root(one + a - e - i), root(one + e - a - i), root(one + i - a - e)
    by_w = ((h - f) / sw, (c - g) / sw, (d - b) / sw, sw / 4)
    by_x = (sx / 4, (b + d) / sx, (c + g) / sx, (h - f) / sx)
    by_y = ((b + d) / sy, sy / 4, (f + h) / sy, (c - g) / sy)
    by_z = ((c + g) / sz, (f + h) / sz, sz / 4, (d - b) / sz)
    return tuple(F.when(a + e + i > 0, by_w[k]).when((a > e) & (a > i), by_x[k]).when(e > i, by_y[k]).otherwise(by_z[k]) for k in range(4))
