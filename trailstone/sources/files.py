"""Readers and writers of the run's text formats, all by Spark's own readers and writers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRAJECTORY = "ts_sec double, tx double, ty double, tz double, qx double, qy double, qz double, qw double"
FLOOR = "normal_x double, normal_y double, normal_z double, offset double, detection_step long, timestamp string"
CLOSEST_POINTS = "step long, point_idx int, closest_3d_x double, closest_3d_y double, closest_3d_z double, closest_point_index long, n_closest_points_distance_2d double"
CLOSEST_OBJECTS = "step long, closest_3d_x double, closest_3d_y double, closest_3d_z double, closest_2d_distance double, segment_id int, class_label string"
DETECTIONS = "step_nr long, timestamp double, class_name string, bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double, confidence double, class_id int, detection_id int"
LABELS = "step_nr long, timestamp double, segment_id int, class_label string"


def _required(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV by its header's names: columns it lacks are left out, further ones are dropped."""
    kinds = dict(x.strip().split(" ") for x in schema.split(","))
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*(F.expr(f"try_cast(`{c}` AS {k})").alias(c) for c, k in kinds.items() if c in raw.columns))


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema=TRAJECTORY)


def trajectory_lines(poses: DataFrame, ts: str = "ts_sec") -> DataFrame:
    return poses.select(F.format_string(" ".join(["%.6f"] * 8), F.col(ts).cast("double"), "tx", "ty", "tz", "qx", "qy", "qz", "qw").alias("value"))


def write_trajectory(poses: DataFrame, path: str, ts: str = "ts_sec") -> None:
    trajectory_lines(poses.orderBy(ts), ts).write.mode("overwrite").text(path)


def read_floor(spark: SparkSession, path: str) -> DataFrame:
    """nx, ny, nz, offset, step_nr and timestamp (null where empty) of a .json or .csv file."""
    if path.endswith(".json"):
        f = spark.read.json(path, schema="floor_normal array<double>, floor_offset double, detection_step long, timestamp string", multiLine=True)
        return f.select(*(F.col("floor_normal")[i].alias(n) for i, n in enumerate(("nx", "ny", "nz"))), F.col("floor_offset").alias("offset"), F.col("detection_step").alias("step_nr"), F.expr("try_cast(timestamp AS DOUBLE)").alias("timestamp"))
    f = _csv(spark, path, FLOOR)
    return f.select(F.col("normal_x").alias("nx"), F.col("normal_y").alias("ny"), F.col("normal_z").alias("nz"), "offset", F.col("detection_step").alias("step_nr"), F.expr("try_cast(timestamp AS DOUBLE)").alias("timestamp"))


def write_floor(floors: DataFrame, path: str) -> None:
    """The latest plane only."""
    last = floors.agg(F.max_by(F.struct("nx", "ny", "nz", "offset", "step_nr"), "step_nr").alias("f"))
    last.selectExpr("f.nx AS normal_x", "f.ny AS normal_y", "f.nz AS normal_z", "f.offset", "f.step_nr AS detection_step", "CAST(NULL AS STRING) AS timestamp").write.mode("overwrite").option("header", True).csv(path)


def read_closest_points(spark: SparkSession, path: str) -> DataFrame:
    """step_nr, point_idx, x, y, z, point_id, distance; of a CSV the nearest only, of a JSON all, ragged lists too."""
    if path.endswith(".json"):
        schema = "n_closest_points_3d array<array<array<double>>>, n_closest_points_indices array<array<long>>, n_closest_points_distances array<array<double>>"
        raw = spark.read.json(path, schema=schema, multiLine=True)
        steps = raw.select(F.posexplode(F.arrays_zip("n_closest_points_3d", "n_closest_points_indices", "n_closest_points_distances")).alias("step_nr", "s"))
        ranks = steps.select("step_nr", F.posexplode(F.arrays_zip("s.n_closest_points_3d", "s.n_closest_points_indices", "s.n_closest_points_distances")).alias("point_idx", "p"))
        at = F.col("p.n_closest_points_3d")
        return ranks.select(F.col("step_nr").cast("long").alias("step_nr"), "point_idx", *(at[i].alias(c) for i, c in enumerate("xyz")), F.col("p.n_closest_points_indices").alias("point_id"), F.col("p.n_closest_points_distances").alias("distance"))
    raw = _required(_csv(spark, path, CLOSEST_POINTS), "step", "point_idx", "n_closest_points_distance_2d").where("point_idx = 0")
    return raw.selectExpr("step AS step_nr", "point_idx", "closest_3d_x AS x", "closest_3d_y AS y", "closest_3d_z AS z", "closest_point_index AS point_id", "n_closest_points_distance_2d AS distance")


def write_closest_points(closest: DataFrame, path: str) -> None:
    closest.selectExpr("step_nr AS step", "point_idx", "x AS closest_3d_x", "y AS closest_3d_y", "z AS closest_3d_z", "point_id AS closest_point_index", "distance AS n_closest_points_distance_2d").write.mode("overwrite").option("header", True).csv(path)


def read_closest_objects(spark: SparkSession, path: str) -> DataFrame:
    raw = _required(_csv(spark, path, CLOSEST_OBJECTS), "step", "closest_3d_x", "closest_3d_y", "closest_3d_z", "closest_2d_distance", "segment_id")
    label = F.coalesce("class_label", F.lit("unknown")) if "class_label" in raw.columns else F.lit("unknown")
    return raw.select(F.col("step").alias("step_nr"), *(F.col(f"closest_3d_{c}").alias(c) for c in "xyz"), F.col("closest_2d_distance").alias("distance"), "segment_id", label.alias("class_label"))


def write_closest_objects(closest: DataFrame, path: str) -> None:
    closest.select(F.col("step_nr").alias("step"), *(F.col(c).alias(f"closest_3d_{c}") for c in "xyz"), F.col("distance").alias("closest_2d_distance"), F.coalesce("segment_id", F.lit(-1)).alias("segment_id"), F.coalesce("class_label", F.lit("unknown")).alias("class_label")).write.mode("overwrite").option("header", True).csv(path)


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """Rows with a class and a whole box, as corner and size."""
    raw = _required(_csv(spark, path, DETECTIONS), "step_nr", "class_name", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2")
    whole = raw.na.drop(subset=["class_name", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2"])
    return whole.withColumns({"x": F.col("bbox_x1"), "y": F.col("bbox_y1"), "w": F.col("bbox_x2") - F.col("bbox_x1"), "h": F.col("bbox_y2") - F.col("bbox_y1")})


def write_detections(frames: DataFrame, detections: DataFrame, path: str) -> None:
    """One row a detection, a blank one for a frame without any."""
    kinds = dict(x.strip().split(" ") for x in DETECTIONS.split(","))
    rows = frames.select("step_nr", F.col("ts_sec").alias("timestamp")).join(detections.selectExpr("step_nr", "class_name", "x1 AS bbox_x1", "y1 AS bbox_y1", "x2 AS bbox_x2", "y2 AS bbox_y2", "confidence", "class_id", "detection_id"), "step_nr", "left")
    rows.select(*(F.col(c).cast(k) for c, k in kinds.items())).write.mode("overwrite").option("header", True).csv(path)


def write_labels(labels: DataFrame, path: str) -> None:
    labels.select("step_nr", F.col("ts_sec").alias("timestamp"), "segment_id", "class_label").write.mode("overwrite").option("header", True).csv(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return _required(_csv(spark, path, LABELS), "step_nr", "segment_id", "class_label")


def write_json(steps: DataFrame, summary: DataFrame, path: str) -> None:
    """A record a step under `path`/steps and the one of the run under `path`/summary: a run's records are never one value."""
    steps.write.mode("overwrite").json(f"{path}/steps")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def write_closest_points_json(closest: DataFrame, poses: DataFrame, path: str) -> None:
    """Each step's nearest points, indices and distances in their order; the run's mean, least and greatest distance."""
    ranked = F.sort_array(F.collect_list(F.struct("point_idx", F.array("x", "y", "z").alias("p"), "point_id", "distance")))  # k a step at most
    steps = closest.groupBy("step_nr").agg(ranked.alias("r")).select("step_nr", F.col("r.p").alias("n_closest_points_3d"), F.col("r.point_id").alias("n_closest_points_indices"), F.col("r.distance").alias("n_closest_points_distances"))
    stats = closest.agg(*(f("distance").alias(f"{n}_n_closest_points_distance_2d") for f, n in ((F.avg, "avg"), (F.min, "min"), (F.max, "max"))))
    write_json(steps, poses.agg(F.count("*").alias("num_poses")).join(stats.select(F.struct("*").alias("analysis_summary"))), path)


def read_closest_points_json(spark: SparkSession, path: str) -> DataFrame:
    """What write_closest_points_json wrote, a row a point."""
    schema = "step_nr long, n_closest_points_3d array<array<double>>, n_closest_points_indices array<long>, n_closest_points_distances array<double>"
    zipped = F.arrays_zip(F.col("n_closest_points_3d").alias("p"), F.col("n_closest_points_indices").alias("i"), F.col("n_closest_points_distances").alias("d"))
    rows = spark.read.schema(schema).json(f"{path}/steps").select("step_nr", F.posexplode(zipped).alias("point_idx", "r"))
    return rows.select("step_nr", "point_idx", *(F.col("r.p")[i].alias(c) for i, c in enumerate("xyz")), F.col("r.i").alias("point_id"), F.col("r.d").alias("distance"))


def write_detections_json(frames: DataFrame, detections: DataFrame, report: DataFrame, path: str) -> None:
    """Each frame with its detections by class, frames without any too; the run's counts."""
    one = F.struct(F.array("x1", "y1", "x2", "y2").alias("bbox"), "confidence", "detection_id")
    by_class = detections.groupBy("step_nr", "class_name").agg(F.sort_array(F.collect_list(F.struct("detection_id", one.alias("d")))).alias("found"))
    nested = by_class.groupBy("step_nr").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("class_name"), F.col("found.d"))))).alias("detections"))
    write_json(frames.select("step_nr").distinct().join(nested, "step_nr", "left"), report, path)


def read_detections_json(spark: SparkSession, path: str) -> DataFrame:
    """What write_detections_json wrote, a row a detection."""
    schema = "step_nr long, detections map<string, array<struct<bbox: array<double>, confidence: double, detection_id: int>>>"
    rows = spark.read.schema(schema).json(f"{path}/steps").select("step_nr", F.explode("detections").alias("class_name", "found")).select("step_nr", "class_name", F.explode("found").alias("d"))
    return rows.select("step_nr", "class_name", *(F.col("d.bbox")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))), "d.confidence", "d.detection_id")


def write_labels_json(labels: DataFrame, report: DataFrame, path: str) -> None:
    """Each labelled frame's map from segment to label; the run's counts."""
    pairs = labels.groupBy("step_nr", "segment_id").agg(F.max_by("class_label", "ord").alias("class_label"))
    nested = pairs.groupBy("step_nr").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("segment_id").cast("string"), "class_label")))).alias("segmentation_labels"))
    write_json(nested, report, path)


def read_labels_json(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("step_nr long, segmentation_labels map<string, string>").json(f"{path}/steps")
    return rows.select("step_nr", F.explode("segmentation_labels").alias("segment_id", "class_label")).withColumn("segment_id", F.col("segment_id").cast("int"))


def write_floor_json(floors: DataFrame, path: str) -> None:
    """The latest plane only."""
    last = floors.agg(F.max_by(F.struct("nx", "ny", "nz", "offset", "step_nr"), "step_nr").alias("f")).where("f IS NOT NULL")
    last.selectExpr("array(f.nx, f.ny, f.nz) AS floor_normal", "f.offset AS floor_offset", "f.step_nr AS detection_step").coalesce(1).write.mode("overwrite").json(path)


def metadata_document(data_summary: DataFrame, parts: dict[str, DataFrame], configuration: dict[str, str], components: list[dict], file_paths: dict[str, str]) -> DataFrame:
    """One JSON document of a run: its summary, configuration, components and files, and each part's only row (none: left out)."""
    as_map = lambda m: F.create_map(*(F.lit(x) for kv in m.items() for x in kv)) if m else F.create_map().cast("map<string,string>")
    out = data_summary.select(F.struct("*").alias("data_summary"))
    for name, part in parts.items():
        out = out.join(part.limit(1).select(F.struct("*").alias(name)), how="left", on=F.lit(True))  # one row each
    listed = F.array(*(F.struct(F.lit(c["type"]).alias("type"), as_map({k: str(v) for k, v in c.get("config", {}).items()}).alias("config")) for c in components)) if components else F.array()
    told = [as_map(configuration).alias("configuration"), F.struct(listed.alias("components")).alias("pipeline_configuration"), as_map(file_paths).alias("file_paths")]
    return out.select(F.to_json(F.struct("data_summary", *told, *parts)).alias("value"))


def metadata_row(summary: DataFrame, configuration: dict[str, str], file_paths: dict[str, str]) -> DataFrame:
    """One JSON document a row of summary."""
    as_map = lambda m: F.create_map(*(F.lit(x) for kv in m.items() for x in kv)) if m else F.create_map().cast("map<string,string>")
    return summary.select(F.to_json(F.struct(F.struct(*summary.columns).alias("data_summary"), as_map(configuration).alias("configuration"), as_map(file_paths).alias("file_paths"))).alias("value"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def snapshot_rows(rows: DataFrame, interval: int = 10) -> DataFrame:
    """Rows of every interval-th step: interval-1, 2*interval-1, ..."""
    return rows.where((F.col("step_nr") + 1) % interval == 0)


def write_snapshots(points: DataFrame, path: str, interval: int = 10) -> None:
    """Points of the steps that `snapshot_rows` names, one folder a step."""
    snapshot_rows(points, interval).write.mode("overwrite").partitionBy("step_nr").parquet(path)


def sampled_frames(frames: DataFrame, every: int) -> DataFrame:
    """Each `every`-th frame, renumbered."""
    return frames.where(F.pmod("frame_idx", F.lit(every)) == 0).withColumn("frame_idx", F.expr(f"frame_idx DIV {every}"))


def component_config(metadata: DataFrame, kind: str) -> dict[str, str]:
    """Configuration of the first component of a type in a run's metadata; empty if there is none."""
    parts = metadata.select(F.posexplode("pipeline_configuration.components").alias("i", "c")).where(F.col("c.type") == kind)
    row = parts.orderBy("i").select(F.to_json("c.config").alias("config")).first()
    return json.loads(row.config) if row and row.config else {}


def first_existing(spark: SparkSession, *paths: str | None) -> str | None:
    """The first of several candidate paths that exists in its file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        if p:
            path = jvm.org.apache.hadoop.fs.Path(p)
            if path.getFileSystem(conf).exists(path):
                return p
    return None


def calibration(spark: SparkSession, path: str | None, required: bool) -> dict[str, float | list[float]] | None:
    """width, height, fx, fy, cx, cy and distortion of a camera from a file of `name: value` lines; numbers after a `#` are comments.

    None where there is no file and none is required; a missing or incomplete file that is required is an error.
    """
    if not path or first_existing(spark, path) is None:
        if required:
            raise ValueError("a calibration is required, but there is none")
        return None
    lines = spark.read.text(path, wholetext=True).first()["value"].splitlines()  # a few lines
    found = {k.strip(): [float(x) for x in v.strip().strip("[]").split(",") if x.strip()] for k, _, v in (line.split("#")[0].partition(":") for line in lines) if v.strip()}
    numbers = found.get("calibration", [])
    out = {k: found[k][0] for k in ("width", "height") if k in found} | dict(zip(("fx", "fy", "cx", "cy"), numbers, strict=False))
    if len(out) < 6:
        raise ValueError(f"{path}: width, height and calibration: [fx, fy, cx, cy, ...] are needed")
    return out | {"distortion": numbers[4:]}


#: Extensions of video files.
VIDEO_EXTENSIONS = ["mp4", "avi", "mov", "mkv", "m4v", "wmv", "flv"]


def video_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and size of the videos of a folder, extensions in lower or upper case, sorted by path; contents aren't read."""
    listed = spark.read.format("binaryFile").load(folder).select("path", F.col("length").alias("size"))
    ext = F.regexp_extract("path", r"\.([^./]+)$", 1)
    return listed.where(ext.isin(VIDEO_EXTENSIONS) | ext.isin([e.upper() for e in VIDEO_EXTENSIONS])).orderBy("path")


def overridden(config: dict[str, str], metadata: DataFrame, kind: str) -> dict[str, str]:
    """config with what a component of a run's metadata says put over it."""
    return config | {k: v for k, v in component_config(metadata, kind).items() if v is not None}
