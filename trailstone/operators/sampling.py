"""Deterministic sampling: seeded order in place of a random generator."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import written
from .ordered import with_ordinal


def lcg(key: Column, seed: int = 0) -> Column:
    """A linear congruential value of an id below 2^31; the order of samples."""
    return (key * F.lit(1103515245) + F.lit(12345 + seed)) % F.lit(2147483648)


def exact_sample(points: DataFrame, ratio: float, cap: int = 15_000, key: str = "point_id", seed: int = 0) -> DataFrame:
    """Exactly min(int(n * ratio), cap) rows: a sort with a limit, merged from each task's first rows."""
    n = min(int(points.count() * ratio), cap)
    return points.orderBy(lcg(F.col(key), seed), key).limit(n)


def grid_cells(points: DataFrame) -> DataFrame:
    """points with a cell number: max(2, int((n // 15) ^ (1/3))) cells a dimension over the bounding box."""
    *ends, n = points.agg(*(f(c) for c in "xyz" for f in (F.min, F.max)), F.count("*")).first()
    per = max(2, int((n // 15) ** (1.0 / 3.0)))
    cell = F.lit(0).cast("long")
    for i, c in enumerate("xyz"):
        lo, hi = ends[2 * i] or 0.0, ends[2 * i + 1] or 0.0
        size = (hi - lo) / per
        at = F.floor((F.col(c) - F.lit(lo)) / F.lit(size)) if size > 0 else F.lit(0).cast("long")
        cell = cell * per + F.least(F.greatest(at, F.lit(0)), F.lit(per - 1))
    return points.withColumn("cell", cell.cast("long"))


def stratified_sample(points: DataFrame, ratio: float, key: str = "point_id", seed: int = 0) -> DataFrame:
    """max(1, int(m * ratio)) rows of each cell of m points, trimmed or topped up to exactly int(n * ratio) rows."""
    placed = written(with_ordinal(grid_cells(points).withColumn("_o", lcg(F.col(key), seed)), "_o", key, by=["cell"], name="_k"), "cells")
    target = int(placed.count() * ratio)
    sizes = written(placed.groupBy("cell").agg(F.count("*").alias("_m")), "sizes")
    wanted = F.col("_k") < F.greatest(F.lit(1), F.floor(F.col("_m") * F.lit(ratio)))
    ranked = placed.join(sizes, "cell").withColumn("_rest", (~wanted).cast("int"))
    # positions are counted within ranges, so that no task holds all that is taken
    return with_ordinal(ranked, "_rest", "_o", key, name="_n").where(F.col("_n") < target).drop("_rest", "_o", "_k", "_m", "_n")


def percentage_subsample(points: DataFrame, ratio: float, step: str, key: str = "point_id") -> DataFrame:
    """About `ratio` of each step's rows by seeded order, all rows of the last step; keeps floor(m * ratio), at least 1.

    A step's rows may fill any number of ranges. Rows without a step are a step of their own."""
    last = points.agg(F.max(step)).first()[0]
    placed = with_ordinal(points.withColumn("_o", lcg(F.col(key))), "_o", key, by=[step], name="_k")
    sizes = written(points.groupBy(F.col(step).alias("_step")).agg(F.count("*").alias("_m")), "sizes")
    ranked = placed.join(sizes, F.col(step).eqNullSafe(F.col("_step")))
    whole = F.coalesce(F.col(step) == F.lit(last), F.lit(False))
    return ranked.where(whole | (F.col("_k") < F.greatest(F.lit(1), F.floor(F.col("_m") * F.lit(ratio))))).drop("_o", "_k", "_m", "_step")


def voxels(points: DataFrame, size: float, also: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Mean position and count of each voxel, counted from the least corner of its cloud (of equal `by`); `also` are averaged too."""
    least = points.groupBy(*by).agg(*(F.min(c).alias(f"_lo_{c}") for c in "xyz"))
    if by:
        least = written(least, "corners")
        placed = points.join(least, list(by))
    else:
        placed = points.join(F.broadcast(least))  # one row
    keys = [F.floor((F.col(c) - F.col(f"_lo_{c}")) / F.lit(size)).alias(f"v{c}") for c in "xyz"]
    return placed.groupBy(*by, *keys).agg(*(F.round(F.avg(c), 11).alias(c) for c in "xyz"), F.count("*").alias("n"), *(F.round(F.avg(c), 9).alias(c) for c in also))


def first_voxel_size(points: DataFrame, target: int) -> float:
    """The diagonal of the cloud's box over the cube root of the target (at least 10), between a centimetre and a metre."""
    r = points.agg(*(F.max(c) - F.min(c) for c in "xyz")).first()
    diagonal = math.sqrt(sum((v or 0.0) ** 2 for v in r))
    return max(0.01, min(1.0, diagonal / max(10, int(target ** (1.0 / 3.0)))))


def voxel_size_for(points: DataFrame, target: int, start: float | None = None, rounds: int = 8, tolerance: float = 0.2, least: float = 1e-3, most: float = 10.0) -> float:
    """Voxel size that leaves about `target` points, after at most `rounds` tries.

    A try that leaves more or fewer than the tolerance allows scales the size by the square root of what it left over the
    target, between a half and twice.
    """
    size = first_voxel_size(points, target) if start is None else start
    for _ in range(rounds):
        left = voxels(points, size).count()
        if abs(left - target) <= tolerance * target:
            break
        size = min(max(size * min(2.0, max(0.5, math.sqrt(left / max(target, 1)))), least), most)
    return size


def subsample(points: DataFrame, ratio: float = 0.6, last: bool = False, enabled: bool = True, also: Sequence[str] = ()) -> tuple[DataFrame, str]:
    """(points, how) of a step's cloud that is shown: all of it where it is the last step's or subsampling is off.

    Voxel means are taken where they come within 0.05 of the share that is asked for, else an exact sample over grid cells.
    """
    n = points.count()
    target = int(n * ratio)
    if not enabled or last or target >= n:
        return points, "all"
    means = written(voxels(points, voxel_size_for(points, target), also), "voxels")
    if abs(means.count() / n - ratio) <= 0.05:
        return means, "voxels"
    return stratified_sample(points, ratio), "grid"
