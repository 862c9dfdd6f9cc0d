"""Bookkeeping of a mask tracker's memory as tables: banks, clearing, consolidation, versions of poses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bank(frames: DataFrame, size: int = 7, key: str = "object_id") -> DataFrame:
    """The newest `size` frames of each object that are no conditioning frames, newest first (k from 1)."""
    w = Window.partitionBy(key).orderBy(F.desc("frame_idx"))
    return frames.where(~F.col("conditioning")).withColumn("k", F.row_number().over(w)).where(F.col("k") <= size)


def cleared(frames: DataFrame, conditioned: DataFrame, reach: int, key: str = "object_id") -> DataFrame:
    """Frames that are not within `reach` of a conditioning frame of their object.

    Frames lie in slots of reach + 1. A conditioning frame clears its own slot whole; of the slots beside it only the last
    one before and the first one behind matter, so a slot gets one row however many there are, and the join is by slot.
    """
    width = reach + 1
    slot = F.expr(f"(frame_idx - pmod(frame_idx, {width}L)) DIV {width}L").alias("_slot")
    own = conditioned.where("frame_idx IS NOT NULL").select(key, slot, "frame_idx").groupBy(key, "_slot").agg(F.min("frame_idx").alias("lo"), F.max("frame_idx").alias("hi"))
    none = F.lit(None).cast("long")
    lent = F.array(*(F.struct((F.col("_slot") + i).alias("_slot"), last.alias("_last"), first.alias("_first")) for i, last, first in ((0, F.col("hi"), F.col("lo")), (1, F.col("hi"), none), (-1, none, F.col("lo")))))
    ends = own.select(key, F.explode(lent).alias("s")).select(key, "s.*").groupBy(key, "_slot")
    # of a frame's own slot both ends are within reach, so the nearer ones stand for those of the slots beside it
    ends = ends.agg(F.max("_last").alias("_last"), F.min("_first").alias("_first")).hint("merge")
    near = (F.abs(F.col("frame_idx") - F.col("_last")) <= reach) | (F.abs(F.col("_first") - F.col("frame_idx")) <= reach)
    return frames.withColumn("_slot", slot).join(ends, [key, "_slot"], "left").where(~F.coalesce(near, F.lit(False))).select(*(f"`{c}`" for c in frames.columns))


def consolidated(objects: DataFrame, outputs: DataFrame, missing_score: float = -1024.0) -> DataFrame:
    """A row for each object of a frame: its output's score, or the score of an absent object."""
    return objects.join(outputs, ["frame_idx", "object_id"], "left").withColumn("score", F.coalesce("score", F.lit(missing_score)))


def merged(temporary: DataFrame, final: DataFrame) -> DataFrame:
    """Temporary outputs replace final ones of the same object and frame; conditioning beats the rest."""
    both = temporary.withColumn("_rank", F.lit(1)).unionByName(final.withColumn("_rank", F.lit(0)))
    w = Window.partitionBy("object_id", "frame_idx").orderBy(F.desc("conditioning"), F.desc("_rank"))
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_rank", "_k")


def poses_as_of(versions: DataFrame, step: int | None) -> DataFrame:
    """Of each keyframe the pose that held at a step (None: its newest); `versions` has (keyframe_id, valid_from, pose columns)."""
    rest = [c for c in versions.columns if c not in ("keyframe_id", "valid_from")]
    held = versions if step is None else versions.where(F.col("valid_from") <= step)
    newest = held.groupBy("keyframe_id").agg(F.max_by(F.struct(*rest), "valid_from").alias("p"))
    return newest.select("keyframe_id", "p.*")


def per_object(outputs: DataFrame, objects: str = "objects") -> DataFrame:
    """A row for each object of a frame's output, from its list of (object_id, score)."""
    return outputs.select("frame_idx", F.explode(objects).alias("o")).select("frame_idx", "o.*")


def reset(frames: DataFrame, at: DataFrame, key: str = "object_id") -> DataFrame:
    """Frames that come after their object's newest reset; `at` has (object_id, reset_at). Objects without one keep all."""
    newest = at.groupBy(key).agg(F.max("reset_at").alias("_reset"))
    return frames.join(newest, key, "left").where(F.col("_reset").isNull() | (F.col("frame_idx") > F.col("_reset"))).drop("_reset")


def with_class(objects: DataFrame, classes: DataFrame, key: str = "object_id") -> DataFrame:
    """objects with class_label, null where none is known."""
    return objects.join(classes.select(key, "class_label").dropDuplicates([key]), key, "left")
