"""Nearest obstacles of each pose by descending a tree of cells that is pruned by distance and view cone."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..plans.staging import written
from .points import Plane, in_cone, off_floor, segmented, unit_plane

#: Points that a cell holds on average where it isn't cut further, and how many times that makes a cell dense.
LEAF, DENSE = 32, 16
#: The first level below the root, and the deepest (2 ** 20 cells a dimension).
TOP, DEEPEST = 2, 20
#: Cells along a floor for one reach of a search for all points within it.
FINE = 4
_BOUNDS = [f"{f}{c}" for c in "xyz" for f in ("lo_", "hi_")]


def plane_axes(plane: Plane) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Two unit vectors that span the plane."""
    n = plane[:3]
    a = (1.0, 0.0, 0.0) if abs(n[0]) < 0.9 else (0.0, 1.0, 0.0)
    u = (n[1] * a[2] - n[2] * a[1], n[2] * a[0] - n[0] * a[2], n[0] * a[1] - n[1] * a[0])
    size = math.sqrt(sum(x * x for x in u))
    u = tuple(x / size for x in u)
    return u, (n[1] * u[2] - n[2] * u[1], n[2] * u[0] - n[0] * u[2], n[0] * u[1] - n[1] * u[0])


def _cell(level: int) -> Column:
    """Number of the row's cell at a level: a one and the cell's place in each dimension."""
    out = F.lit(1 << 3 * level).cast("long")
    for i in range(3):
        out = out + F.shiftleft(F.shiftright(f"c{i}", DEEPEST - level), level * (2 - i))
    return out


def _level(points: DataFrame, n: int, above: int, by: Sequence[str]) -> int:
    """The first level below `above` whose cells hold LEAF points on average, read off estimates of how many there are."""
    first = max(above + 1, math.ceil(math.log(max(n / LEAF, 1), 8)))
    for start in range(first, DEEPEST + 1, 4):
        levels = range(start, min(start + 4, DEEPEST + 1))
        found = points.agg(*(F.approx_count_distinct(F.struct(*by, _cell(v))) for v in levels)).first()
        for level, cells in zip(levels, found, strict=True):
            if cells * LEAF >= 0.9 * n:
                return level
    return DEEPEST


def cell_tree(points: DataFrame, by: Sequence[str] = (), k: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(points with the number of their leaf, nodes, deepest level): cubes cut in eight until they hold about LEAF points.

    Of points on one spot that no level parts the k with the smallest ids stay (None: all), as no search for k takes others.

    The depth follows where the points are: cells that are still DENSE go deeper, so that neither an outlier nor a cluster
    puts many points into one leaf. A node has its cell, its parent, its number of points and their bounding box.
    """
    *ends, n = points.agg(*(f(c) for c in "xyz" for f in (F.min, F.max)), F.count("*")).first()
    lows = [v or 0.0 for v in ends[::2]]
    side = max((h or 0.0) - low for h, low in zip(ends[1::2], lows, strict=True)) or 1.0
    most = (1 << DEEPEST) - 1
    unit = {f"c{i}": F.least(F.floor((F.col(c) - F.lit(low)) / F.lit(side) * F.lit(float(1 << DEEPEST))), F.lit(most)).cast("long") for i, (c, low) in enumerate(zip("xyz", lows, strict=True))}
    left, level = points.withColumns(unit), TOP - 1
    placed: list[DataFrame] = []
    nodes: list[DataFrame] = []
    while True:
        level = _level(left, n, level, by)
        if level == DEEPEST and k is not None:
            spot = Window.partitionBy(*by, "x", "y", "z").orderBy("point_id")
            left = written(left.withColumn("_r", F.row_number().over(spot)).where(F.col("_r") <= k).drop("_r"), "spots")
        keyed = left.withColumn("leaf", _cell(level))
        bounds = [f(c).alias(f"{k}{c}") for c in "xyz" for f, k in ((F.min, "lo_"), (F.max, "hi_"))]
        cells = written(keyed.groupBy(*by, "leaf").agg(F.count("*").alias("n"), *bounds, *(F.min(f"c{i}").alias(f"c{i}") for i in range(3))), "cells")
        dense = cells.where(F.col("n") > DENSE * LEAF).select(*by, "leaf")
        done = level == DEEPEST or dense.isEmpty()
        if not done:
            dense = written(dense, "dense")
        leaves = cells if done else cells.join(dense, [*by, "leaf"], "left_anti")
        upward = F.explode(F.array(*(F.struct(_cell(v).alias("node"), _cell(v - 1 if v > TOP else 0).alias("parent"), F.lit(v == level).alias("leaf")) for v in range(TOP, level + 1)))).alias("at")
        nodes.append(leaves.select(*by, upward, "n", *_BOUNDS).select(*by, "at.*", "n", *_BOUNDS))
        if done:
            placed.append(keyed)
            break
        placed.append(keyed.join(dense, [*by, "leaf"], "left_anti"))
        left = written(keyed.join(dense, [*by, "leaf"], "left_semi").drop("leaf"), "dense_points")
        n = left.count()
    every, rows = nodes[0], placed[0]
    for more, part in zip(nodes[1:], placed[1:], strict=True):
        every, rows = every.unionByName(more), rows.unionByName(part)
    merged = every.groupBy(*by, "node", "parent").agg(F.max("leaf").alias("leaf"), F.sum("n").alias("n"), *((F.min if c[0] == "l" else F.max)(c).alias(c) for c in _BOUNDS))
    merged = written(merged, "nodes")
    # a leaf is its own child too, so that going down leaves it as it is
    return rows.drop("c0", "c1", "c2"), merged.unionByName(merged.where("leaf").withColumn("parent", F.col("node"))), level


def _placed() -> Column:
    """Points that have an id and lie somewhere."""
    return F.col("point_id").isNotNull() & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf")) & (F.abs("z") < float("inf"))


def _met(half_angle: float | None, axes: list[tuple[float, ...]]) -> dict[str, Column]:
    """Of a pose and a node's box (middle m, half its width w, ball around it): the least and the greatest distance, and whether all or none of it is in the cone."""
    centre, half = [F.col(f"m{c}") - F.col(f"t{c}") for c in "xyz"], [F.col(f"w{c}") for c in "xyz"]
    near = far = F.lit(0.0)
    for axis in axes:  # the box seen along each axis of the distance
        mid = F.abs(sum(F.lit(a) * c for a, c in zip(axis, centre, strict=True) if a))
        wide = sum(F.lit(abs(a)) * h for a, h in zip(axis, half, strict=True) if a)
        near = near + F.pow(F.greatest(mid - wide, F.lit(0.0)), F.lit(2.0))
        far = far + F.pow(mid + wide, F.lit(2.0))
    out = {"near": F.sqrt(near), "far": F.sqrt(far)}
    if half_angle is None:
        return out | {"inside": F.lit(True), "outside": F.lit(False)}
    # a sphere around the box: its centre's angle to the axis of the cone, and the angle it fills
    size, ball, cone = g.norm(tuple(centre)), F.col("ball"), math.radians(half_angle)
    apart = size > ball + 1e-5
    safe = F.when(apart, size).otherwise(1.0)
    angle = F.acos(F.least(F.greatest(g.dot(tuple(centre), g.vec("f0", "f1", "f2")) / safe, F.lit(-1.0)), F.lit(1.0)))
    fills = F.asin(F.least(ball / safe, F.lit(1.0)))
    return out | {"inside": apart & (angle + fills < cone - 1e-6), "outside": apart & (angle - fills > cone + 1e-6)}


def nearest_points(
    points: DataFrame, poses: DataFrame, k: int = 20, floor: Plane | None = None, half_angle: float | None = 45.0, only_segmented: bool = True, floor_threshold: float = 0.05, by: Sequence[str] = ()
) -> DataFrame:
    """step_nr, point_idx, point_id, x, y, z, distance, segment_id: the k nearest eligible points of each pose.

    With a floor, points near it are left out and distance is measured along it; without one it is plain distance. The
    cone test is in space either way. Ties go to the smaller point_id. Poses meet points of equal `by` (a session) only.
    Points without an id or with a coordinate that is null or not finite are left out.

    Poses go down a tree of cells level by level, each in an equi-join with the children of the cells it is in. A cell is
    left where none of it is in the cone, or where cells nearer than it that are in the cone as a whole hold k points.
    Only points of the leaves that remain are compared with a pose: its neighbours, and what the edge of the cone cuts
    where there are fewer than k. No pose meets all points, however few of them it sees.
    """
    at = g.pose_position()
    eligible = points.select(*by, "point_id", "x", "y", "z", "segment_id").where(_placed())
    if only_segmented:
        eligible = eligible.where(segmented())
    if floor is None:
        axes = [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)]
    else:
        floor = unit_plane(floor)
        eligible = eligible.where(off_floor(floor, floor_threshold))
        axes = list(plane_axes(floor))
    placed, nodes, deepest = cell_tree(written(eligible, "eligible"), by, k)
    # few rows that become many: each goes to the task of its number, which no merging of small partitions undoes
    spark = points.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    deal = F.pmod(F.xxhash64(*by, "step_nr"), F.lit(tasks)).cast("int").alias("_deal")
    seen = poses.select(deal, *by, "step_nr", *at, *(f.alias(f"f{i}") for i, f in enumerate(g.forward(g.pose_quaternion())))).repartitionById(tasks, "_deal")

    pose = ["_deal", *by, "step_nr", "tx", "ty", "tz", "f0", "f1", "f2"]
    own = Window.partitionBy("_deal", *by, "step_nr")
    middle = [((F.col(f"lo_{c}") + F.col(f"hi_{c}")) / 2).alias(f"m{c}") for c in "xyz"]
    half = [((F.col(f"hi_{c}") - F.col(f"lo_{c}")) / 2).alias(f"w{c}") for c in "xyz"]
    ball = (g.norm(tuple(half)) * (1 + 1e-9)).alias("ball")
    children = nodes.select(*by, "node", F.col("parent").alias("_parent"), "n", *middle, *half, ball)
    active = seen.withColumns({"_parent": F.lit(1).cast("long"), "_inside": F.lit(False), "bound": F.lit(float("inf"))})
    for level in range(TOP, deepest + 1):
        met = active.join(children, [*by, "_parent"]).withColumns(_met(half_angle, axes)).withColumn("inside", F.col("inside") | F.col("_inside"))
        cells = met.where("inside OR NOT outside").select(*pose, "node", "n", "near", "far", "inside", "bound")
        # the distance within which there are k points for certain
        held = F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).over(own.orderBy("far", "node").rowsBetween(Window.unboundedPreceding, 0))
        bound = F.least("bound", F.min(F.when(F.col("held") >= k, F.col("far"))).over(own))
        cells = cells.withColumn("held", held).withColumn("bound", bound).where(F.col("near") <= F.col("bound") + 2e-6)
        active = cells.select(*pose, F.col("node").alias("_parent"), F.col("inside").alias("_inside"), "bound")
        if level < deepest and (level - TOP) % 4 == 3:
            active = written(active, "active")
    leaves = written(active.select(*pose, F.col("_parent").alias("leaf"), "bound"), "leaves")
    pairs = leaves.join(placed, [*by, "leaf"])
    offset = g.sub(g.vec(), at)
    squares = F.lit(0.0)
    for axis in axes:
        along = g.dot(g.vec(), g.const(*axis)) - g.dot(at, g.const(*axis))
        squares = squares + along * along
    pairs = pairs.withColumn("distance", F.round(F.sqrt(squares), 6)).where(F.col("distance") <= F.col("bound") + 2e-6)
    if half_angle is not None:
        pairs = pairs.where(in_cone(offset, g.vec("f0", "f1", "f2"), math.cos(math.radians(half_angle))))
    top = pairs.withColumn("point_idx", F.row_number().over(own.orderBy("distance", "point_id")) - 1).where(F.col("point_idx") < k)
    return top.select(*by, "step_nr", "point_idx", "point_id", "x", "y", "z", "distance", "segment_id")


def points_in_cone(points: DataFrame, poses: DataFrame, reach: float, floor: Plane | None = None, half_angle: float = 45.0, by: Sequence[str] = ()) -> DataFrame:
    """step_nr, point_id and distance of all points within `reach` of each pose that are in its view cone.

    Points without an id or with a coordinate that is null or not finite are left out. Space is cut into cells as wide as
    the reach, or a FINE-th of it along a floor; a pose meets the points of the cells around it in an equi-join. Along a
    floor it leaves those beyond the reach, and those where the cone holds no point, however high or low.
    """
    axes = [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)] if floor is None else list(plane_axes(unit_plane(floor)))
    fine, cos = 1 if floor is None else FINE, math.cos(math.radians(half_angle))
    size = reach / fine
    cell = lambda v, axis: F.floor(g.dot(v, g.const(*axis)) / size)
    names = [f"_c{i}" for i in range(len(axes))]
    around = poses.select(*by, "step_nr", *g.pose_position(), *(f.alias(f"f{i}") for i, f in enumerate(g.forward(g.pose_quaternion()))))
    for name, axis in zip(names, axes, strict=True):
        around = around.withColumn(name, F.explode(F.array(*(cell(g.pose_position(), axis) + i for i in range(-fine, fine + 1)))))
    if floor is not None:
        at = [g.dot(g.pose_position(), g.const(*axis)) for axis in axes]
        slack = 1e-6 * size + 1e-9 * F.greatest(*(F.abs(a) for a in at))
        mid = [(F.col(name) + 0.5) * size - a for name, a in zip(names, at, strict=True)]
        beyond = sum(F.pow(F.greatest(F.abs(m) - size / 2 - slack, F.lit(0.0)), F.lit(2.0)) for m in mid) > reach**2
        # a column at u along the floor holds points of the cone if u . f >= |u| sqrt(cos^2 - f_n^2), f_n being f's part upwards
        along = [g.dot(g.vec("f0", "f1", "f2"), g.const(*axis)) for axis in axes]
        upward = g.dot(g.vec("f0", "f1", "f2"), g.const(*unit_plane(floor)[:3]))
        ball, flat = size * math.sqrt(0.5) + 2 * slack, F.sqrt(along[0] * along[0] + along[1] * along[1])
        least = F.sqrt(F.greatest(F.lit(cos * cos) - upward * upward, F.lit(0.0))) if cos > 0 else F.lit(0.0)
        seen = mid[0] * along[0] + mid[1] * along[1] + ball * flat >= least * (F.sqrt(mid[0] * mid[0] + mid[1] * mid[1]) - ball) - slack
        any_height = F.lit(cos <= 0) | (F.abs(upward) >= cos - 1e-9)
        around = around.where(~F.coalesce(beyond, F.lit(False)) & (any_height | F.coalesce(seen, F.lit(True))))
    keyed = points.where(_placed()).select(*by, "point_id", "x", "y", "z", *(cell(g.vec(), axis).alias(name) for name, axis in zip(names, axes, strict=True)))
    squares = F.lit(0.0)
    for axis in axes:
        along = g.dot(g.vec(), g.const(*axis)) - g.dot(g.pose_position(), g.const(*axis))
        squares = squares + along * along
    pairs = keyed.join(around, [*by, *names]).withColumn("distance", F.sqrt(squares))
    inside = in_cone(g.sub(g.vec(), g.pose_position()), g.vec("f0", "f1", "f2"), math.cos(math.radians(half_angle)))
    return pairs.where((F.col("distance") <= reach) & inside).select(*by, "step_nr", "point_id", "distance")
