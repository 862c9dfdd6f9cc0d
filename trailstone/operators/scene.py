"""Scene tables: boxes, labels, cones, grids and lines."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..functions.proximity import rounded
from ..plans.staging import written
from .ordered import with_ordinal

#: Colours of the named detection classes, and of all others.
CLASS_COLOURS = {"Chair": "255,165,0", "Window": "0,191,255", "Person": "255,20,147", "Car": "255,0,0", "Table": "50,205,50", "Door": "138,43,226"}
OTHER_COLOUR = "128,128,128"
#: The palette of segment classes.
PALETTE = ["255,0,0", "0,255,0", "0,0,255", "255,255,0", "255,0,255", "0,255,255", "255,128,0", "128,0,255", "255,192,203", "128,128,128", "139,69,19", "0,128,0"]


def boxes(detections: DataFrame) -> DataFrame:
    """Corner boxes as corner and size, and as centre and half size."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return detections.select("step_nr", "detection_id", "x1", "y1", w.alias("w"), h.alias("h"), (F.col("x1") + w / 2).alias("cx"), (F.col("y1") + h / 2).alias("cy"), (w / 2).alias("hw"), (h / 2).alias("hh"))


def prompts(detections: DataFrame, width: int, height: int, model_size: int = 1024, also: Sequence[str] = ()) -> DataFrame:
    """Two labelled corner points (2, 3) for each box, scaled to the model's square input; columns in `also` come along."""
    corner = lambda label, x, y: F.struct(F.lit(label).alias("label"), (F.col(x) / width * model_size).alias("px"), (F.col(y) / height * model_size).alias("py"))
    return detections.select("step_nr", "detection_id", *also, F.explode(F.array(corner(2, "x1", "y1"), corner(3, "x2", "y2"))).alias("p")).select("step_nr", "detection_id", *also, "p.*")


def detection_labels(detections: DataFrame, least: float = 0.3) -> DataFrame:
    colours = F.create_map(*(F.lit(x) for kv in CLASS_COLOURS.items() for x in kv))
    shown = F.concat("class_name", F.format_string(" (%.2f)", rounded(F.col("confidence"), 2)))
    return detections.where(F.col("confidence") >= least).select("step_nr", "detection_id", shown.alias("label"), F.coalesce(F.try_element_at(colours, F.col("class_name")), F.lit(OTHER_COLOUR)).alias("colour"))


def segment_palette(points: DataFrame) -> DataFrame:
    """segment_id, colour by position among the sorted distinct ids, background included in the count but not shown."""
    ids = points.select("segment_id").distinct()  # a few classes
    place = F.dense_rank().over(Window.orderBy("segment_id")) - 1
    return ids.withColumn("colour", F.element_at(F.array(*map(F.lit, PALETTE)), (place % len(PALETTE) + 1).cast("int"))).where("segment_id <> 0")


def view_cones(poses: DataFrame, half_angle: float = 45.0, factor: float = 1.5, longest: float = 2.0, rays: int = 8, ring: int = 16) -> DataFrame:
    """step_nr, kind, idx and the ends of the lines of each pose's cone: rays from the apex, and a closed ring.

    `distance` (null: 1) times factor, up to longest, is the cone's length.
    """
    q = g.pose_quaternion()
    r = g.rotation(q)
    length = F.least(F.coalesce("distance", F.lit(1.0)) * factor, F.lit(longest))
    wide = length * math.tan(math.radians(half_angle))

    def rim(angle):
        side = [wide * F.cos(angle), wide * F.sin(angle), length]
        return tuple(g.pose_position()[i] + r[i][0] * side[0] + r[i][1] * side[1] + r[i][2] * side[2] for i in range(3))

    def lines(kind: str, n: int):
        i = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("idx")
        base = poses.select("*", i)
        turn = lambda k: (F.col("idx") + k) * (2 * math.pi / n)
        start = g.pose_position() if kind == "ray" else rim(turn(0))
        end = rim(turn(0)) if kind == "ray" else rim(turn(1))
        names = [f"{s}{c}" for s in ("a", "b") for c in "xyz"]
        return base.select("step_nr", F.lit(kind).alias("kind"), "idx", *(F.round(v, 5).alias(n) for v, n in zip((*start, *end), names, strict=True)))

    return lines("ray", rays).unionByName(lines("ring", ring))


def floor_grid(centre: DataFrame, plane: tuple[float, float, float, float], half: float = 5.0) -> DataFrame:
    """22 lines on the plane around the foot of the centroid (cx, cy, cz)."""
    nx = plane[0]
    n = g.const(*plane[:3])
    helper = (1.0, 0.0, 0.0) if abs(nx) < 0.9 else (0.0, 1.0, 0.0)
    u = g.cross(n, g.const(*helper))
    u = g.scale(u, F.lit(1.0) / g.norm(u))
    v = g.cross(n, u)
    foot = g.project(g.vec("cx", "cy", "cz"), n, F.lit(plane[3]))
    rows = centre.select("*", F.explode(F.array(F.lit("u"), F.lit("v"))).alias("axis")).select("*", F.explode(F.sequence(F.lit(-5), F.lit(5))).alias("idx"))
    along = tuple(F.when(F.col("axis") == "u", a).otherwise(b) for a, b in zip(u, v, strict=True))
    across = tuple(F.when(F.col("axis") == "u", b).otherwise(a) for a, b in zip(u, v, strict=True))
    shift = g.add(foot, g.scale(across, F.col("idx") * F.lit(half / 5)))
    a, b = g.sub(shift, g.scale(along, F.lit(half))), g.add(shift, g.scale(along, F.lit(half)))
    names = [f"{s}{c}" for s in ("a", "b") for c in "xyz"]
    return rows.select("axis", "idx", *(F.round(x, 5).alias(k) for x, k in zip((*a, *b), names, strict=True)))


def trajectory_segments(poses: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each pose's line to the next one of its run, whatever steps are missing between them."""
    placed = written(with_ordinal(poses.select(*by, "step_nr", "tx", "ty", "tz"), "step_nr", by=by), "placed")
    nxt = placed.select(*by, (F.col("i") - 1).alias("i"), F.col("tx").alias("bx"), F.col("ty").alias("by"), F.col("tz").alias("bz"))
    size = F.sqrt((F.col("bx") - F.col("tx")) ** 2 + (F.col("by") - F.col("ty")) ** 2 + (F.col("bz") - F.col("tz")) ** 2)
    return placed.join(nxt, [*by, "i"]).select(*by, "step_nr", "tx", "ty", "tz", "bx", "by", "bz", F.round(size, 6).alias("length"))


def scene_log(entities: Mapping[str, DataFrame]) -> DataFrame:
    """step_nr, kind, payload: entities of all kinds in one table, each row's columns as a variant.

    Kinds needn't share columns, and new ones need no new table; written by step, a viewer reads one step's rows.
    """
    parts = [df.select("step_nr", F.lit(kind).alias("kind"), F.to_variant_object(F.struct(*(F.col(c) for c in df.columns if c != "step_nr"))).alias("payload")) for kind, df in entities.items()]
    return reduce(DataFrame.unionByName, parts)
