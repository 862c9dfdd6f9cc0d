"""Floor planes from seeded three-point hypotheses, and the schedule of a detector over frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..plans.staging import written
from .ordered import over_recent
from .sampling import exact_sample, lcg

#: Fixed values of the score: inliers weighted by horizontality, horizontality, camera support.
INLIER_WEIGHT, LEVEL_WEIGHT, SUPPORT_WEIGHT = 10.0, 1000.0, 500.0
#: Least horizontality, and what makes a plane excellent.
LEVEL, EXCELLENT_LEVEL, EXCELLENT_SUPPORT = 0.7, 0.95, 0.8


def gravity(poses: DataFrame, window: int = 30, first: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """step_nr, gx, gy, gz: mean camera-down of the oldest `first` poses of the last `window` of a run; (0,0,-1) if it vanishes."""
    down = g.down(g.pose_quaternion())
    downs = poses.select(*by, "step_nr", F.struct(*(d.alias(k) for d, k in zip(down, "xyz", strict=True))).alias("down"))
    kept = over_recent(downs, "step_nr", window - 1, "d", F.collect_list("down"), by=by).withColumn("d", F.slice("d", 1, first))
    total = [F.aggregate(F.col(f"d.{k}"), F.lit(0.0), lambda s, v: s + v) / F.size("d") for k in "xyz"]
    mean = kept.select(*by, "step_nr", *(t.alias(k) for t, k in zip(total, "xyz", strict=True)))
    size = g.norm(g.vec())
    return mean.select(*by, "step_nr", *(F.round(F.when(size > 1e-6, F.col(k) / size).otherwise(F.lit(d)), 6).alias(f"g{k}") for k, d in zip("xyz", (0.0, 0.0, -1.0), strict=True)))


def hypotheses(points: DataFrame, n_iter: int = 1000, sample: int = 15_000, seed: int = 0, expected: tuple[float, float, float] = (0.0, 1.0, 0.0), ratio: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """(planes, sample): n_iter planes through three sampled points each, oriented along `expected`.

    The sample is the first min(int(n * ratio), sample) points in seeded order, the triples are seeded places in it;
    degenerate triples give no plane.
    """
    spark = points.sparkSession
    picked = exact_sample(points, ratio, sample, seed=seed).select("point_id", "x", "y", "z")
    numbered = written(picked.withColumn("o", F.row_number().over(Window.orderBy(lcg(F.col("point_id"), seed), "point_id")) - 1), "sample")  # `sample` rows
    n = numbered.count()
    if n < 3:
        return spark.createDataFrame([], "iter long, nx double, ny double, nz double, d double"), numbered
    triples = spark.range(n_iter).select(F.col("id").alias("iter"), *(((lcg(F.col("id") * 3 + k, seed)) % n).alias(f"o{k}") for k in range(3)))
    for k in range(3):
        triples = triples.join(F.broadcast(numbered.select(F.col("o").cast("long").alias(f"o{k}"), *(F.col(c).alias(f"{c}{k}") for c in "xyz"))), f"o{k}")
    a, b, c = (g.vec(f"x{k}", f"y{k}", f"z{k}") for k in range(3))
    normal = g.cross(g.sub(b, a), g.sub(c, a))
    raw = triples.select("iter", *(v.alias(k) for v, k in zip(normal, ("mx", "my", "mz"), strict=True)), *(v.alias(k) for v, k in zip(a, ("ax", "ay", "az"), strict=True)))
    m = g.vec("mx", "my", "mz")
    size = g.norm(m)
    sign = F.when(g.dot(m, g.const(*expected)) < 0, -1.0).otherwise(1.0)
    unit = raw.where(size >= 1e-6).select("iter", *((F.col(k) / size * sign).alias(o) for k, o in (("mx", "nx"), ("my", "ny"), ("mz", "nz"))), "ax", "ay", "az")
    return unit.select("iter", "nx", "ny", "nz", g.dot(g.vec("nx", "ny", "nz"), g.vec("ax", "ay", "az")).alias("d")), numbered


def score_planes(planes: DataFrame, sample: DataFrame, cameras: DataFrame, threshold: float = 0.05, expected: tuple[float, float, float] = (0.0, 1.0, 0.0)) -> DataFrame:
    """iter, plane, inliers, horizontality, support and score of each hypothesis.

    Hypotheses are bounded in number (n_iter), so they travel as one array to the sample's and the cameras' rows, whose
    counts are combined in the tasks.
    """
    packed = planes.agg(F.sort_array(F.collect_list(F.struct("iter", "nx", "ny", "nz", "d"))).alias("h"))
    n, d = g.vec("h.nx", "h.ny", "h.nz"), F.col("h.d")

    def spread(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(packed)).select("*", F.explode("h").alias("_h")).drop("h").withColumnRenamed("_h", "h")  # packed is one row

    inliers = spread(sample.select("x", "y", "z")).groupBy("h.iter").agg(F.count_if(g.plane_distance(g.vec(), n, d) < threshold).alias("inliers"))
    support = spread(cameras.select("tx", "ty", "tz")).groupBy("h.iter").agg((F.count_if(g.dot(g.pose_position(), n) - d > 0.1) / F.count("*")).alias("support"))
    level = F.abs(g.dot(g.vec("nx", "ny", "nz"), g.const(*expected)))
    out = planes.withColumn("horizontality", level).join(inliers, "iter").join(support, "iter")
    return out.withColumn("score", F.col("inliers") * F.col("horizontality") * INLIER_WEIGHT + F.col("horizontality") * LEVEL_WEIGHT + F.col("support") * SUPPORT_WEIGHT)


def best_plane(scored: DataFrame, min_inliers: int = 1000) -> DataFrame:
    """The best valid hypothesis up to the first excellent one; the earlier of equal scores. No row if none is valid."""
    valid = scored.where((F.col("horizontality") > LEVEL) & (F.col("inliers") >= min_inliers // 4))
    excellent = (F.col("horizontality") > EXCELLENT_LEVEL) & (F.col("support") > EXCELLENT_SUPPORT) & (F.col("inliers") > min_inliers)
    stop = valid.agg(F.min(F.when(excellent, F.col("iter"))).alias("stop"))
    return valid.join(F.broadcast(stop)).where(F.col("stop").isNull() | (F.col("iter") <= F.col("stop"))).orderBy(F.round("score", 6).desc(), "iter").limit(1).drop("stop")


def schedule(frames: int, min_frames: int, interval: int) -> list[tuple[int, str]]:
    """(frame count, action) where every attempt succeeds: detect at min_frames, refine each `interval` counted from 0."""
    out, last = [(min_frames, "detect")] if frames >= min_frames else [], 0
    for f in range(min_frames + 1, frames + 1):
        if f - last >= interval:
            out.append((f, "refine"))
            last = f
    return out
