"""Backward as-of joins as one union, one sort and a running value, and numbers by first appearance: no range join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import last_so_far, with_ordinal


def asof_join(left: DataFrame, right: DataFrame, on: str, by: Sequence[str] = (), values: Sequence[str] = (), tie: str | None = None) -> DataFrame:
    """left with, from right, the values of the newest row at or before left's `on` and of the same `by`; null if none.

    Of right rows equal in `on` the largest `tie` wins. Null keys of left find nothing.
    """
    order = [on, "_side"] + (["_tie"] if tie else [])
    packed = F.struct(*values)
    blank = F.lit(None).cast(right.select(packed.alias("v")).schema["v"].dataType)
    row = F.struct(*(F.col(c) for c in left.columns))
    lefts = left.select(*by, on, F.lit(1).alias("_side"), *([F.lit(None).cast(dict(right.dtypes)[tie]).alias("_tie")] if tie else []), row.alias("_row"), blank.alias("_value"))
    rights = right.where(F.col(on).isNotNull()).select(*by, on, F.lit(0).alias("_side"), *([F.col(tie).alias("_tie")] if tie else []), F.lit(None).cast(lefts.schema["_row"].dataType).alias("_row"), packed.alias("_value"))
    both = last_so_far(lefts.unionByName(rights), by, order, "_value")
    return both.where("_side = 1").select("_row.*", *(F.col(f"_value.{v}").alias(v) for v in values))


def label_points(closest: DataFrame, labels: DataFrame, default: str = "unknown") -> DataFrame:
    """Each record with the newest label its segment had at or before its step; `labels` has ord as its tie-break."""
    out = asof_join(closest, labels, "step_nr", ["segment_id"], ["class_label"], tie="ord")
    return out.withColumn("class_label", F.coalesce("class_label", F.lit(default)))


def object_numbers(detections: DataFrame, key: str, step: str = "step_nr") -> DataFrame:
    """A dense number for each object in order of first appearance (ties by key), never reused.

    The objects are ranked within ranges, so the ranking isn't done by a single task.
    """
    first = detections.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(step).alias("first_step"))
    return with_ordinal(first, "first_step", key, name="_place").select(key, "first_step", (F.col("_place") + 1).cast("long").alias("object_nr"))
