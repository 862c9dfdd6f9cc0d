"""Invariants of tables, checked inside the plan: a row that breaks one stops the job with its content, or goes to a table of rejects."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.staging import written


def broken(rules: Mapping[str, Column]) -> Column:
    """Names of the rules that a row doesn't keep, in the order of `rules`; a condition that is null isn't kept."""
    names = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()))
    return F.filter(names, lambda n: n.isNotNull())


def required(df: DataFrame, rules: Mapping[str, Column], what: str = "row") -> DataFrame:
    """df; reading a row that breaks a rule fails with the rules' names and the row as JSON."""
    row = F.to_json(F.struct(*(F.col(c) for c in df.columns)))
    said = F.concat(F.lit(f"{what} breaks "), F.array_join(broken(rules), ", "), F.lit(": "), row)
    return df.where(F.when(F.size(broken(rules)) > 0, F.raise_error(said).cast("boolean")).otherwise(F.lit(True)))


def split(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(rows that keep all rules, the others with `broken`, how many rows broke each rule and `rows` in all).

    The input is read once: both tables come from one written table, and the numbers are observed while it is written.
    """
    seen = Observation("checks")
    judged = df.withColumn("broken", broken(rules))
    counts = [F.count_if(F.array_contains("broken", name)).alias(name) for name in rules]
    table = written(judged.observe(seen, F.count("*").alias("rows"), *counts), "checked")
    return table.where("size(broken) = 0").drop("broken"), table.where("size(broken) > 0"), dict(seen.get)


def box_rules(box: str = "bbox") -> dict[str, Column]:
    """A detection's box: four finite numbers, the second corner beyond the first."""
    b = F.col(box)
    four = F.size(b) == 4
    finite = F.forall(b, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return {"four_numbers": four, "finite": finite, "positive_area": four & (F.get(b, F.lit(2)) > F.get(b, F.lit(0))) & (F.get(b, F.lit(3)) > F.get(b, F.lit(1)))}


def late_objects(outputs: DataFrame, start: int, key: str = "object_id", frame: str = "frame_idx") -> DataFrame:
    """Outputs of objects that are named for the first time once tracking has begun, at frame `start`."""
    first = outputs.groupBy(key).agg(F.min(frame).alias("first_frame")).where(F.col("first_frame") >= start)
    return outputs.join(first, key)


def output_conflicts(temporary: DataFrame, final: DataFrame, key: str = "object_id", frame: str = "frame_idx") -> DataFrame:
    """(object, frame) with the number of temporary and final outputs, where there isn't exactly one of either kind.

    After outputs have been merged, an object's frame has one final output and no temporary one, or one temporary output.
    """
    both = temporary.select(key, frame, F.lit(1).alias("t"), F.lit(0).alias("f")).unionByName(final.select(key, frame, F.lit(0).alias("t"), F.lit(1).alias("f")))
    return both.groupBy(key, frame).agg(F.sum("t").alias("temporary"), F.sum("f").alias("final")).where("temporary + final <> 1")
