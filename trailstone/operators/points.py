"""Point predicates and pose-independent point work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g

Plane = tuple[float, float, float, float]


def unit_plane(plane: Plane) -> Plane:
    n = sum(x * x for x in plane[:3]) ** 0.5
    if not n:
        raise ValueError("a plane needs a normal")
    return tuple(x / n for x in plane[:3]) + (plane[3] / n,)


def off_floor(plane: Plane, threshold: float = 0.05) -> Column:
    """Farther from the floor than the threshold (strictly)."""
    return g.plane_distance(g.vec(), g.const(*plane[:3]), F.lit(plane[3])) > threshold


def on_floor(plane: Plane, threshold: float = 0.05) -> Column:
    """Nearer to the floor than the threshold (strictly)."""
    return g.plane_distance(g.vec(), g.const(*plane[:3]), F.lit(plane[3])) < threshold


def segmented() -> Column:
    return F.col("segment_id") > 0


def confident(threshold: float = 1.5) -> Column:
    return F.col("confidence") > threshold


def in_cone(offset: g.Vector, direction: g.Vector, cos_half: float) -> Column:
    """Within the half angle of the direction and not at the apex (cosines compared, as lengths)."""
    n = g.norm(offset)
    return (n > 1e-6) & (g.dot(offset, direction) >= n * cos_half)


def wrapped_segments(points: DataFrame) -> DataFrame:
    """Segment ids as an unsigned byte holds them."""
    return points.withColumn("segment_id", F.pmod(F.col("segment_id"), F.lit(256)))


def world_points(keyframe_points: DataFrame, keyframes: DataFrame) -> DataFrame:
    """Keyframe-local points moved by their keyframe's pose; an equi-join, so re-optimised poses need no rewrite."""
    q, t = g.pose_quaternion(), g.pose_position()
    x, y, z = g.sim3_apply(q, t, F.col("scale"), g.vec("lx", "ly", "lz"))
    return keyframe_points.join(keyframes, "keyframe_id").select("point_id", "keyframe_id", x.alias("x"), y.alias("y"), z.alias("z"), "confidence", "segment_id")


def floor_colours(points: DataFrame, plane: Plane, threshold: float = 0.05) -> DataFrame:
    """Floor points green, others in their own colour or grey."""
    floor = on_floor(plane, threshold)
    own = {c: F.coalesce(F.col(c), F.lit(128)) if c in points.columns else F.lit(128) for c in "rgb"}
    return points.withColumns({c: F.when(floor, F.lit(255 if c == "g" else 0)).otherwise(own[c]).cast("int") for c in "rgb"})


def segment_objects(points: DataFrame) -> DataFrame:
    """Size, centroid and bounding box of each segment."""
    agg = [F.count("*").alias("n_points"), *(F.round(F.avg(c), 6).alias(f"c{c}") for c in "xyz")]
    agg += [f(c).alias(f"{n}_{c}") for c in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))]
    return points.where(segmented()).groupBy("segment_id").agg(*agg)


def byte_colours(points: DataFrame) -> DataFrame:
    """r, g, b as whole numbers from 0 to 255: cut off after scaling where no colour of the table lies above 1."""
    top = points.agg(F.max(F.greatest("r", "g", "b")).alias("_top"))  # one row
    scale = F.when(F.col("_top") <= 1, 255.0).otherwise(1.0)
    return points.join(F.broadcast(top)).withColumns({c: F.floor(F.col(c) * scale).cast("int") for c in "rgb"}).drop("_top")


def concatenated(*clouds: DataFrame) -> DataFrame:
    """The rows of several clouds; columns that one lacks are null there."""
    out = clouds[0]
    for cloud in clouds[1:]:
        out = out.unionByName(cloud, allowMissingColumns=True)
    return out
