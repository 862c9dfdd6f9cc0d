"""Per-pixel fusion of repeated observations (pixel, frame, x, c)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from .ordered import SCAN, running


def weighted(obs: DataFrame) -> DataFrame:
    """Confidence-weighted mean; the running form of it gives the same, so order doesn't matter."""
    total = F.sum("c")
    return obs.groupBy("pixel").agg(F.round(F.sum(F.col("c") * F.col("x")) / total, 6).alias("x"), F.round(total, 6).alias("c_sum"), F.count("*").alias("n"), F.round(total / F.count("*"), 9).alias("avg_confidence"))


def weighted_spherical(obs: DataFrame) -> DataFrame:
    """Weighted mean of (radius, azimuth, polar) of 3-D observations (px, py, pz), as a point."""
    r, a, p = g.spherical(g.vec("px", "py", "pz"))
    w = obs.select("pixel", "c", r.alias("r"), a.alias("a"), p.alias("p")).groupBy("pixel").agg(*(F.sum(F.col("c") * F.col(k)) / F.sum("c") for k in ("r", "a", "p"))).toDF("pixel", "r", "a", "p")
    x, y, z = g.cartesian(F.col("r"), F.col("a"), F.col("p"))
    return w.select("pixel", F.round(x, 5).alias("x"), F.round(y, 5).alias("y"), F.round(z, 5).alias("z"))


def independent(obs: DataFrame) -> DataFrame:
    """The most confident observation, the earliest of equals."""
    best = F.max_by(F.struct("x", "c", "frame"), F.struct("c", -F.col("frame")))
    return obs.groupBy("pixel").agg(best.alias("b")).select("pixel", "b.x", "b.c", "b.frame")


def recent(obs: DataFrame) -> DataFrame:
    return obs.groupBy("pixel").agg(F.max_by("x", "frame").alias("x"))


def first(obs: DataFrame) -> DataFrame:
    """The second observation where there is one: the first update after the initial one is what stays."""
    w = Window.partitionBy("pixel").orderBy("frame")
    return obs.withColumn("k", F.row_number().over(w)).where("k <= 2").groupBy("pixel").agg(F.max_by("x", "k").alias("x"))


def best_score(obs: DataFrame, group: str = "grp", by_mean: bool = False) -> DataFrame:
    """All pixels of the frame group with the highest lower-median (or mean) confidence, the earliest of equals."""
    score = F.avg("c") if by_mean else F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY c)")
    scores = obs.groupBy(group).agg(F.round(score, 6).alias("score"))
    best = scores.orderBy(F.desc("score"), group).limit(1)
    return obs.join(F.broadcast(best), group).select(group, "pixel", "frame", "x", "c")


def running_fusion(observations: DataFrame, by: Sequence[str], order: Sequence[str], value: str = "value", weight: str = "weight", block: int = SCAN) -> DataFrame:
    """observations with n, weight_so_far, mean_so_far and best_so_far (the weight of the best one) as of each of them.

    The weighted fusion of a pixel, read off after every update; a pixel that is seen without end is folded in blocks.
    """
    state = F.struct(F.lit(1).cast("long").alias("n"), F.col(weight).alias("w"), (F.col(weight) * F.col(value)).alias("wx"), F.col(weight).alias("best"))

    def combine(a: Column, b: Column) -> Column:
        return F.struct((a["n"] + b["n"]).alias("n"), (a["w"] + b["w"]).alias("w"), (a["wx"] + b["wx"]).alias("wx"), F.greatest(a["best"], b["best"]).alias("best"))

    out = running(observations, by, order, state, combine, "_f", block)
    f = F.col("_f")
    return out.withColumns({"n": f["n"], "weight_so_far": f["w"], "mean_so_far": f["wx"] / f["w"], "best_so_far": f["best"]}).drop("_f")
