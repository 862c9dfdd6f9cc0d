"""Run, distance, detection and segmentation statistics (population deviations)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distance_stats(closest: DataFrame) -> DataFrame:
    d = "distance"
    return closest.agg(F.count(d).alias("n"), F.round(F.avg(d), 6).alias("mean"), F.min(d).alias("min"), F.max(d).alias("max"), F.round(F.stddev_pop(d), 5).alias("std"))


def detection_stats(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """One row over all frames, those without detections included in the averages."""
    per_frame = detections.groupBy("step_nr").agg(F.count("*").alias("n"))
    framed = frames.select("step_nr").distinct().join(per_frame, "step_nr", "left").agg(
        F.count("*").alias("frames"), F.count("n").alias("frames_with"), F.round(F.count("n") / F.greatest(F.count("*"), F.lit(1)), 6).alias("rate"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.round(F.coalesce(F.sum("n"), F.lit(0)) / F.greatest(F.count("*"), F.lit(1)), 6).alias("avg_per_frame"), F.coalesce(F.max("n"), F.lit(0)).alias("max_per_frame"),
    )
    c = "confidence"
    conf = detections.agg(F.countDistinct("class_name").alias("classes"), F.round(F.avg(c), 6).alias("conf_mean"), F.min(c).alias("conf_min"), F.max(c).alias("conf_max"), F.round(F.stddev_pop(c), 6).alias("conf_std"))
    return framed.join(conf)  # one row each


def class_counts(table: DataFrame, column: str) -> DataFrame:
    return table.groupBy(column).agg(F.count("*").alias("n"))


def detections_by_frame(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """A row a detection and a row of nulls for each frame without any."""
    return frames.select("step_nr").join(detections.select("step_nr", "class_name", F.round("confidence", 6).alias("confidence"), "detection_id"), "step_nr", "left")


def detections_nested(detections: DataFrame) -> DataFrame:
    """step_nr with class name -> list of detections; a frame's detections are few."""
    one = F.struct("confidence", "x1", "y1", "x2", "y2", "detection_id")
    by_class = detections.groupBy("step_nr", "class_name").agg(F.sort_array(F.collect_list(one)).alias("found"))
    return by_class.groupBy("step_nr").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("class_name", "found")))).alias("detections"))


def segmentation_stats(labels: DataFrame) -> DataFrame:
    """Over labelled frames only."""
    per = labels.groupBy("step_nr").agg(F.countDistinct("segment_id").alias("n"))
    return per.agg(F.count("*").alias("frames"), F.round(F.avg("n"), 6).alias("avg_segments"), F.max("n").alias("max_segments"), F.min("n").alias("min_segments"), F.sum("n").alias("total_segments"))


def run_summary(poses: DataFrame) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return poses.agg(F.count("*").alias("poses"), F.round(F.coalesce(F.max(seconds) - F.min(seconds), F.lit(0.0)), 3).alias("duration"))


def objects_summary(closest: DataFrame) -> DataFrame:
    return closest.groupBy("step_nr").agg(F.count("*").alias("records"), F.countDistinct("segment_id").alias("segments"))


def bounds(points: DataFrame) -> DataFrame:
    """Bounding box, diagonal and centroid."""
    span = lambda c: F.max(c) - F.min(c)
    return points.agg(
        *(f(c).alias(f"{n}_{c}") for c in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))), F.round(F.sqrt(span("x") * span("x") + span("y") * span("y") + span("z") * span("z")), 6).alias("diagonal"),
        *(F.round(F.avg(c), 6).alias(f"c{c}") for c in "xyz"),
    )


def _one_row_map(counts: DataFrame, key: str, name: str) -> DataFrame:
    """One row: value -> count, sorted by value; the classes of a detector are few."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(key).alias("key"), F.col("n").alias("value"))))
    return counts.where(F.col(key).isNotNull()).agg(F.map_from_entries(pairs).alias(name))


def detection_report(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """detection_stats with class_counts, a map from class to number of detections."""
    return detection_stats(frames, detections).join(_one_row_map(class_counts(detections, "class_name"), "class_name", "class_counts"))  # one row each


def segmentation_report(labels: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """segmentation_stats with the share of labelled frames, the sorted classes and how many segments each has.

    Without `frames` only labelled frames count, and the share is 1 (0 if there are none).
    """
    total = frames.select("step_nr").distinct().agg(F.count("*").alias("total_frames")) if frames is not None else labels.agg(F.countDistinct("step_nr").alias("total_frames"))
    counted = _one_row_map(class_counts(labels, "class_label"), "class_label", "class_distribution")
    out = segmentation_stats(labels).join(total).join(counted)  # one row each
    rate = F.round(F.when(F.col("total_frames") > 0, F.col("frames") / F.col("total_frames")).otherwise(0.0), 6)
    return out.withColumns({"rate": rate, "classes": F.map_keys("class_distribution")})


def run_report(poses: DataFrame, floors: DataFrame, closest: DataFrame, detection_frames: DataFrame, labels: DataFrame) -> DataFrame:
    """One row about a run: poses, duration, whether there is a floor, and the steps that have records of each kind."""
    steps = lambda c, name: F.countDistinct(F.when(F.col(c).isNotNull(), F.col("step_nr"))).alias(name)
    return (
        run_summary(poses)
        .join(floors.agg((F.count("*") > 0).alias("has_floor")))
        .join(closest.agg(steps("distance", "closest_steps"), steps("segment_id", "segment_steps"), steps("class_label", "label_steps")))
        .join(detection_frames.agg(F.countDistinct("step_nr").alias("detection_frames")))
        .join(labels.agg(F.countDistinct("step_nr").alias("label_frames")))
    )  # one row each


def class_debug_counts(detections: DataFrame) -> DataFrame:
    """class_name, detections, frames of each class, and a row of totals under the name `total`."""
    per = detections.groupBy("class_name").agg(F.count("*").alias("detections"), F.countDistinct("step_nr").alias("frames"))
    return per.unionByName(detections.agg(F.lit("total").alias("class_name"), F.count("*").alias("detections"), F.countDistinct("step_nr").alias("frames")))


def lists_by_step(table: DataFrame, *columns: str) -> DataFrame:
    """step_nr with the sorted list of its rows; a step's rows are few."""
    return table.groupBy("step_nr").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("rows"))


def stage_timing(seconds: float, frames: int) -> dict[str, float]:
    """Whole time, time a frame and frames a second of a run; zeros where nothing ran."""
    return {"total_s": seconds, "s_per_frame": seconds / frames if frames else 0.0, "frames_per_s": frames / seconds if seconds else 0.0}


def numbered_in_step(detections: DataFrame, *order: Column, name: str = "detection_id", step: str = "step_nr") -> DataFrame:
    """detections with their place, from 0, among those of their step in `order`; a step's detections are few (the model's limit)."""
    rest = [c for c in detections.columns if c not in (step, name)]
    row = F.struct(*(o.alias(f"_o{i}") for i, o in enumerate(order)), F.struct(*rest).alias("_row"))
    placed = detections.groupBy(step).agg(F.sort_array(F.collect_list(row)).alias("_rows")).select(step, F.posexplode("_rows").alias(name, "_one"))
    return placed.select(step, name, "_one._row.*")


def reporting_counts(rows: DataFrame, shown: Column, by: Sequence[str] = ("step_nr",)) -> DataFrame:
    """seen and shown rows of each of `by`."""
    return rows.groupBy(*by).agg(F.count("*").alias("seen"), F.count_if(shown).alias("shown"))


def class_union(*tables: tuple[DataFrame, str]) -> DataFrame:
    """class_name of every class that any of the (table, column) pairs names, once, and in how many of the tables it is."""
    parts = [t.where(F.col(c).isNotNull()).select(F.col(c).alias("class_name"), F.lit(i).alias("_t")).distinct() for i, (t, c) in enumerate(tables)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("class_name").agg(F.count("*").alias("tables"))


def users_of_classes(detections: DataFrame, error: float = 0.01) -> DataFrame:
    """class_name, users (distinct user_id) and about (their number as estimated).

    The estimate is taken over the distinct users, which gives the same: together with a distinct count over all rows each
    pair of class and user would hold a sketch of its own.
    """
    pairs = detections.select("class_name", "user_id").distinct()
    return pairs.groupBy("class_name").agg(F.count("user_id").alias("users"), F.approx_count_distinct("user_id", error).alias("about"))
