"""The engine for people who write SQL: views over a run's tables, scalar functions, and table functions for LATERAL joins.

    from trailstone.sql import register
    register(spark, folder)
    spark.sql("SELECT p.step_nr, c.* FROM poses p, LATERAL view_cone(tx, ty, tz, qx, qy, qz, qw, 1.0D) c")

Scalar functions are SQL expressions (temporary functions), so that Catalyst sees through them; table functions are
Python's with Arrow between, a call a row of the outer table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .sources import bindings

#: name -> (parameters, type, expression)
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "plane_distance": ("x DOUBLE, y DOUBLE, z DOUBLE, nx DOUBLE, ny DOUBLE, nz DOUBLE, d DOUBLE", "DOUBLE", "abs(x * nx + y * ny + z * nz - d)"),
    "planar_distance": ("x DOUBLE, z DOUBLE, tx DOUBLE, tz DOUBLE", "DOUBLE", "sqrt((x - tx) * (x - tx) + (z - tz) * (z - tz))"),
    "spatial_distance": ("x DOUBLE, y DOUBLE, z DOUBLE, tx DOUBLE, ty DOUBLE, tz DOUBLE", "DOUBLE", "sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty) + (z - tz) * (z - tz))"),
    "camera_forward": (
        "qx DOUBLE, qy DOUBLE, qz DOUBLE, qw DOUBLE",
        "STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE>",
        """named_struct('x', 2 * (qx * qz + qy * qw) / (qx * qx + qy * qy + qz * qz + qw * qw),
        'y', 2 * (qy * qz - qx * qw) / (qx * qx + qy * qy + qz * qz + qw * qw),
        'z', 1 - 2 * (qx * qx + qy * qy) / (qx * qx + qy * qy + qz * qz + qw * qw))""",
    ),
    "in_view_cone": (
        "x DOUBLE, y DOUBLE, z DOUBLE, tx DOUBLE, ty DOUBLE, tz DOUBLE, f STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE>, half_angle DOUBLE",
        "BOOLEAN",
        """sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty) + (z - tz) * (z - tz)) > 1e-6D
        AND (x - tx) * f.x + (y - ty) * f.y + (z - tz) * f.z
          >= sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty) + (z - tz) * (z - tz)) * cos(radians(half_angle))""",
    ),
    # The distances of the levels.
    "warning_level": ("distance DOUBLE", "STRING", "CASE WHEN distance <= 0.2D THEN 'critical' WHEN distance <= 0.4D THEN 'strong' WHEN distance <= 0.6D THEN 'caution' WHEN distance IS NOT NULL THEN 'normal' END"),
}
LINES = "idx: int, ax: double, ay: double, az: double, bx: double, by: double, bz: double"


@udtf(returnType=f"kind: string, {LINES}", useArrow=True)
class ViewCone:
    """Rays from the apex and the ring at the end of a camera's view cone; a null distance is 1."""

    def eval(self, tx: float, ty: float, tz: float, qx: float, qy: float, qz: float, qw: float, distance: float, half_angle: float = 45.0, factor: float = 1.5, longest: float = 2.0, rays: int = 8, ring: int = 16) -> Iterator[tuple]:
        if any(v is None for v in (tx, ty, tz, qx, qy, qz, qw)):
            return
        n = math.sqrt(qx * qx + qy * qy + qz * qz + qw * qw)
        x, y, z, w = qx / n, qy / n, qz / n, qw / n
        right = (1 - 2 * (y * y + z * z), 2 * (x * y + z * w), 2 * (x * z - y * w))
        below = (2 * (x * y - z * w), 1 - 2 * (x * x + z * z), 2 * (y * z + x * w))
        ahead = (2 * (x * z + y * w), 2 * (y * z - x * w), 1 - 2 * (x * x + y * y))
        length = min((1.0 if distance is None else distance) * factor, longest)
        wide = length * math.tan(math.radians(half_angle))

        def rim(turn: float) -> tuple:
            c, s = wide * math.cos(turn), wide * math.sin(turn)
            return tuple(t + r * c + b * s + a * length for t, r, b, a in zip((tx, ty, tz), right, below, ahead, strict=True))

        for i in range(rays):
            yield ("ray", i, tx, ty, tz, *rim(2 * math.pi * i / rays))
        for i in range(ring):
            yield ("ring", i, *rim(2 * math.pi * i / ring), *rim(2 * math.pi * (i + 1) / ring))


@udtf(returnType=f"axis: string, {LINES}", useArrow=True)
class FloorGrid:
    """Eleven lines each way on a plane n . p = d, around the foot of a point, from -half to half."""

    def eval(self, cx: float, cy: float, cz: float, nx: float, ny: float, nz: float, d: float, half: float = 5.0) -> Iterator[tuple]:
        if any(v is None for v in (cx, cy, cz, nx, ny, nz, d)):
            return
        n, c = (nx, ny, nz), (cx, cy, cz)
        cross = lambda a, b: (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
        u = cross(n, (1.0, 0.0, 0.0) if abs(nx) < 0.9 else (0.0, 1.0, 0.0))
        size = math.sqrt(sum(k * k for k in u))
        u = tuple(k / size for k in u)
        v = cross(n, u)
        off = sum(a * b for a, b in zip(n, c, strict=True)) - d
        foot = tuple(a - off * b for a, b in zip(c, n, strict=True))
        for axis, along, across in (("u", u, v), ("v", v, u)):
            for i in range(-5, 6):
                at = tuple(f + a * i * half / 5 for f, a in zip(foot, across, strict=True))
                yield (axis, i, *(p - a * half for p, a in zip(at, along, strict=True)), *(p + a * half for p, a in zip(at, along, strict=True)))


#: Views over a folder of the driver's tables.
VIEWS = ("points", "poses", "detections", "segment_labels", "descriptors", "floor_observations")


def register(spark: SparkSession, sf_dir: str | None = None) -> None:
    """Functions for a session, and views where a folder of tables is given; what has the same name is replaced."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("view_cone", ViewCone)
    spark.udtf.register("floor_grid", FloorGrid)
    if sf_dir:
        for name in VIEWS:
            getattr(bindings, name)(spark, sf_dir).createOrReplaceTempView(name)
