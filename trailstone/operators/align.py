"""Alignment of trajectories with closest points, snapshots and video frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import written
from .asof import asof_join
from .ordered import with_ordinal


def trajectory_closest(poses: DataFrame, closest: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every pose with its nearest record; where it has none, its own position at distance 0, marked invalid."""
    nearest = closest.where("point_idx = 0").select(*by, "step_nr", "x", "y", "z", "distance", "segment_id", "class_label")
    out = poses.select(*by, "step_nr", "tx", "ty", "tz").join(nearest, [*by, "step_nr"], "left")
    return out.select(
        *by, "step_nr", F.coalesce("x", "tx").alias("x"), F.coalesce("y", "ty").alias("y"), F.coalesce("z", "tz").alias("z"), F.coalesce("distance", F.lit(0.0)).alias("distance"),
        F.coalesce("segment_id", F.lit(-1)).alias("segment_id"), F.coalesce("class_label", F.lit("unknown")).alias("class_label"), F.col("distance").isNotNull().alias("valid"),
    )


def zip_by_position(left: DataFrame, right: DataFrame, left_order: str, right_order: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows of equal ordinal (of equal `by`) side by side; the longer table's rest is dropped, as zip does."""
    return with_ordinal(left, left_order, by=by).join(with_ordinal(right, right_order, by=by), [*by, "i"])


def _shared(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """left with the columns of right, which has a row for each `by` at most (one row in all without `by`)."""
    return left.join(right, list(by), "left") if by else left.join(F.broadcast(right))


def nearest_snapshot(poses: DataFrame, snapshots: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """step_nr, snapshot_step: a run's poses spread evenly over its snapshots' range, each with the nearest one, the smaller on a tie.

    With as many poses as snapshots they are matched one to one. The neighbours below and above a target come from an
    as-of join each. Runs without snapshots have null.
    """
    ends = snapshots.groupBy(*by).agg(F.min("snapshot_step").alias("lo"), F.max("snapshot_step").alias("hi"), F.count("*").alias("m"))
    counts = _shared(poses.groupBy(*by).agg(F.count("*").alias("n")), ends, by)
    numbered = _shared(with_ordinal(poses.select(*by, "step_nr"), "step_nr", by=by), written(counts, "counts"), by)
    share = F.col("i") / F.greatest(F.col("n") - 1, F.lit(1)).cast("double")
    target = F.floor(F.col("lo").cast("double") + share * (F.col("hi") - F.col("lo")).cast("double"))
    same = with_ordinal(snapshots.select(*by, "snapshot_step"), "snapshot_step", by=by).select(*by, "i", F.col("snapshot_step").alias("own"))
    wanted = numbered.join(same, [*by, "i"], "left").select(*by, "step_nr", F.when(F.col("m") == F.col("n"), F.col("own")).alias("own"), target.alias("at"), (-target).alias("back"))
    s = F.col("snapshot_step")
    both = asof_join(wanted, snapshots.select(*by, s.alias("at"), s.alias("b")), "at", by, values=["b"])
    both = asof_join(both, snapshots.select(*by, (-s).alias("back"), s.alias("a")), "back", by, values=["a"])
    near = F.when(F.col("a").isNull() | (F.col("at") - F.col("b") <= F.col("a") - F.col("at")), F.col("b")).otherwise(F.col("a"))
    return both.select(*by, "step_nr", F.coalesce("own", near, "a").alias("snapshot_step"))


def video_frames(poses: DataFrame, n_frames: int, by: Sequence[str] = ()) -> DataFrame:
    """step_nr, frame_idx: the frame at the same share of the video as the pose of the trajectory."""
    counts = written(poses.groupBy(*by).agg(F.count("*").alias("n")), "counts")
    numbered = _shared(with_ordinal(poses.select(*by, "step_nr"), "step_nr", by=by), counts, by)
    frame = F.floor(F.col("i") / F.greatest(F.col("n") - 1, F.lit(1)).cast("double") * F.lit(float(max(n_frames - 1, 0)))).cast("long")
    return numbered.select(*by, "step_nr", frame.alias("frame_idx"))
