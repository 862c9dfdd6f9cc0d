"""Queries of the catalog about files, reports, sessions and the smaller operators, with their DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import proximity
from ..operators import align, floor, graph, knn, masks, memory, sampling, scene, stats, video
from ..operators import points as pt
from ..sources import bindings as b
from ..sources import files, ply
from .catalog import _CONE, _MASKS, _OBJECTS, _PLANAR, FLOOR, _masks, _objects, closest_points_cone, query
from .staging import shared_folder


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/files/{name}-{uuid.uuid4().hex}"


def _counted(name: str):
    """A map from value to count as text: value:count,..., sorted."""
    return F.array_join(F.transform(F.map_entries(name), lambda e: F.concat(e.key, F.lit(":"), e.value.cast("string"))), ",")


def _frames(spark, d) -> DataFrame:
    return b.table(spark, d, "events").selectExpr("event_id DIV 5 AS step_nr").distinct()


# ---- files: what a query reads back is what it wrote


@query('SELECT point_id, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x, CAST(CAST(y AS FLOAT) AS DOUBLE) AS y, CAST(CAST(z AS FLOAT) AS DOUBLE) AS z, CAST(CAST(confidence AS FLOAT) AS DOUBLE) AS confidence, segment_id FROM points', "points")
def ply_round_trip(spark, d):
    """Clouds of points with confidence and segment; the id travels as three colour bytes."""
    path, cloud = _folder(spark, "ply"), b.points(spark, d)
    byte = lambda k: F.pmod(F.shiftright("point_id", k), F.lit(256)).cast("int")
    ply.write_ply(cloud.withColumns({"r": byte(16), "g": byte(8), "b": byte(0)}), path)
    back = ply.read_ply(spark, f"{path}/*.ply")
    return back.select((F.col("r").cast("long") * 65536 + F.col("g") * 256 + F.col("b")).alias("point_id"), "x", "y", "z", "confidence", "segment_id")


@query("SELECT round(epoch(ts), 3) AS ts_sec, round(tx, 6) AS tx, round(ty, 6) AS ty, round(tz, 6) AS tz, qx, qy, qz, qw FROM poses", "poses")
def trajectory_round_trip(spark, d):
    path = _folder(spark, "trajectory")
    files.write_trajectory(b.poses(spark, d).withColumn("ts_sec", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6), path)
    return files.read_trajectory(spark, path).withColumns({"ts_sec": F.round("ts_sec", 3), "tx": F.round("tx", 6), "ty": F.round("ty", 6), "tz": F.round("tz", 6)})


@query("SELECT 'csv' AS kind, nx, ny, nz, \"offset\", step_nr FROM floors WHERE step_nr = (SELECT max(step_nr) FROM floors) UNION ALL SELECT 'json', nx, ny, nz, \"offset\", step_nr FROM floors WHERE step_nr = (SELECT max(step_nr) FROM floors)", "poses floors")
def floor_files(spark, d):
    planes, kinds = b.floor_observations(spark, d), []
    for kind, write in (("csv", files.write_floor), ("json", files.write_floor_json)):
        path = f"{_folder(spark, 'floor')}.{kind}"
        write(planes, path)
        kinds.append(files.read_floor(spark, path).select(F.lit(kind).alias("kind"), "nx", "ny", "nz", "offset", "step_nr"))
    return kinds[0].unionByName(kinds[1])


@query(f"WITH {_OBJECTS} SELECT step_nr, CAST(point_idx AS INT) AS point_idx, x, y, z, point_id, distance FROM named WHERE point_idx = 0", "points poses segment_labels")
def closest_points_csv(spark, d):
    path = _folder(spark, "closest")
    files.write_closest_points(closest_points_cone(spark, d), path)
    return files.read_closest_points(spark, path)


@query(f"WITH {_OBJECTS} SELECT step_nr, CAST(point_idx AS INT) AS point_idx, x, y, z, point_id, distance FROM named", "points poses segment_labels")
def closest_points_json(spark, d):
    path = _folder(spark, "closest")
    files.write_closest_points_json(closest_points_cone(spark, d), b.poses(spark, d), path)
    return files.read_closest_points_json(spark, path)


@query(f"WITH {_OBJECTS} SELECT (SELECT count(*) FROM poses) AS num_poses, round(avg(distance), 6) AS mean, min(distance) AS min, max(distance) AS max FROM named", "points poses segment_labels")
def closest_points_summary(spark, d):
    path = _folder(spark, "closest")
    files.write_closest_points_json(closest_points_cone(spark, d), b.poses(spark, d), path)
    r = "analysis_summary.{}_n_closest_points_distance_2d"
    return spark.read.json(f"{path}/summary").select("num_poses", F.round(r.format("avg"), 6).alias("mean"), F.col(r.format("min")).alias("min"), F.col(r.format("max")).alias("max"))


@query(f"WITH {_OBJECTS} SELECT step_nr, x, y, z, distance, segment_id, class_label FROM named", "points poses segment_labels")
def closest_objects_csv(spark, d):
    path = _folder(spark, "objects")
    files.write_closest_objects(_objects(spark, d), path)
    return files.read_closest_objects(spark, path)


@query("SELECT step_nr, class_name, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h, confidence, detection_id FROM detections", "detections")
def detections_csv(spark, d):
    path, found = _folder(spark, "detections"), b.detections(spark, d).withColumn("class_id", F.lit(None).cast("int"))
    files.write_detections(_frames(spark, d).withColumn("ts_sec", F.lit(0.0)), found, path)
    return files.read_detections(spark, path).select("step_nr", "class_name", "x", "y", "w", "h", "confidence", "detection_id")


@query("SELECT step_nr, class_name, x1, y1, x2, y2, confidence, detection_id FROM detections", "detections")
def detections_json(spark, d):
    path, found, frames = _folder(spark, "detections"), b.detections(spark, d), _frames(spark, d)
    files.write_detections_json(frames, found, stats.detection_report(frames, found), path)
    return files.read_detections_json(spark, path)


@query("SELECT step_nr, segment_id, class_label FROM segment_labels", "segment_labels")
def labels_csv(spark, d):
    path = _folder(spark, "labels")
    files.write_labels(b.segment_labels(spark, d).withColumn("ts_sec", F.lit(0.0)), path)
    return files.read_labels(spark, path).select("step_nr", "segment_id", "class_label")


@query("SELECT step_nr, segment_id, arg_max(class_label, ord) AS class_label FROM segment_labels GROUP BY ALL", "segment_labels")
def labels_json(spark, d):
    path, labels = _folder(spark, "labels"), b.segment_labels(spark, d)
    files.write_labels_json(labels, stats.segmentation_report(labels), path)
    return files.read_labels_json(spark, path)


@query("SELECT step_nr, tx, ty, tz FROM poses WHERE (step_nr + 1) % 10 = 0", "poses")
def snapshots_round_trip(spark, d):
    path = _folder(spark, "snapshots")
    files.write_snapshots(b.poses(spark, d).select("step_nr", "tx", "ty", "tz"), path)
    return spark.read.schema("tx double, ty double, tz double, step_nr long").parquet(path).select("step_nr", "tx", "ty", "tz")


@query("SELECT event_id // 3 AS frame_idx, value FROM events WHERE event_id % 3 = 0")
def frames_subsampled(spark, d):
    return files.sampled_frames(b.table(spark, d, "events").selectExpr("event_id AS frame_idx", "value"), 3)


# ---- reports


_COUNTED = "coalesce((SELECT string_agg(k || ':' || n, ',' ORDER BY k) FROM (SELECT {c} AS k, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1)), '')"


@query(
    f"""WITH fr AS (SELECT DISTINCT event_id // 5 AS step_nr FROM events), per AS (SELECT step_nr, count(*) AS n FROM detections GROUP BY 1)
 SELECT count(*) AS total_frames, count(n) AS frames_with, CAST(sum(n) AS BIGINT) AS total, (SELECT count(DISTINCT class_name) FROM detections) AS classes, {_COUNTED.format(c='class_name', t='detections')} AS class_counts FROM fr LEFT JOIN per USING (step_nr)""",
    "detections",
)
def detection_summary(spark, d):
    """The counts of the detections file's summary, read back from it."""
    path, found, frames = _folder(spark, "detections"), b.detections(spark, d), _frames(spark, d)
    files.write_detections_json(frames, found, stats.detection_report(frames, found), path)
    read = spark.read.schema("frames long, frames_with long, total long, classes long, class_counts map<string, long>").json(f"{path}/summary")
    return read.select(F.col("frames").alias("total_frames"), "frames_with", "total", "classes", _counted("class_counts").alias("class_counts"))


@query(
    f"""WITH fr AS (SELECT DISTINCT step_nr FROM poses), per AS (SELECT step_nr, count(DISTINCT segment_id) AS n FROM segment_labels GROUP BY 1)
 SELECT count(*) AS frames, (SELECT count(*) FROM fr) AS total_frames, CAST(sum(n) AS BIGINT) AS total_segments, round(count(*) / (SELECT count(*) FROM fr), 6) AS rate, max(n) AS max_segments, min(n) AS min_segments,
 (SELECT string_agg(DISTINCT class_label, ',' ORDER BY class_label) FROM segment_labels) AS classes, {_COUNTED.format(c='class_label', t='segment_labels')} AS class_distribution FROM per""",
    "poses segment_labels",
)
def segmentation_summary(spark, d):
    report = stats.segmentation_report(b.segment_labels(spark, d), b.poses(spark, d))
    return report.select("frames", "total_frames", "total_segments", "rate", "max_segments", "min_segments", F.array_join("classes", ",").alias("classes"), _counted("class_distribution").alias("class_distribution"))


_RUN = f"""WITH {_OBJECTS} SELECT (SELECT count(*) FROM poses) AS poses, (SELECT round(coalesce(epoch(max(ts)) - epoch(min(ts)), 0), 3) FROM poses) AS duration, (SELECT count(*) > 0 FROM floors) AS has_floor,
 count(DISTINCT step_nr) AS closest_steps, count(DISTINCT CASE WHEN segment_id IS NOT NULL THEN step_nr END) AS segment_steps, count(DISTINCT CASE WHEN class_label IS NOT NULL THEN step_nr END) AS label_steps,
 (SELECT count(DISTINCT event_id // 5) FROM events) AS detection_frames, (SELECT count(DISTINCT step_nr) FROM segment_labels) AS label_frames FROM named"""


def _report(spark, d):
    return stats.run_report(b.poses(spark, d), b.floor_observations(spark, d), _objects(spark, d), _frames(spark, d), b.segment_labels(spark, d))


@query(_RUN, "points poses floors segment_labels")
def run_report(spark, d):
    return _report(spark, d)


@query(
    """WITH s AS (SELECT (SELECT count(*) FROM poses) AS poses, (SELECT count(*) > 0 FROM floors) AS has_floor, (SELECT count(DISTINCT step_nr) FROM segment_labels) AS label_frames),
 f AS (SELECT step_nr, "offset" FROM floors ORDER BY step_nr DESC LIMIT 1), dd AS (SELECT count(*) AS total FROM detections)
 SELECT '{"data_summary":{"poses":' || poses || ',"has_floor":' || has_floor || ',"label_frames":' || label_frames || '},"configuration":{"analysis_format":"csv"},"pipeline_configuration":{"components":[{"type":"closest_points","config":{"k":"20"}}]},"file_paths":{"trajectory":"t.txt"},"floor_detection":{"step_nr":' || step_nr || '},"yolo_analysis":{"total":' || total || '}}' AS metadata FROM s, f, dd""",
    "poses floors detections segment_labels",
)
def metadata_json(spark, d):
    poses, planes, labels = b.poses(spark, d), b.floor_observations(spark, d), b.segment_labels(spark, d)
    report = stats.run_report(poses, planes, spark.createDataFrame([], "step_nr long, distance double, segment_id int, class_label string"), _frames(spark, d), labels).select("poses", "has_floor", "label_frames")
    parts = {"floor_detection": planes.agg(F.max("step_nr").alias("step_nr")), "yolo_analysis": stats.detection_report(_frames(spark, d), b.detections(spark, d)).select("total")}
    text = files.metadata_document(report, parts, {"analysis_format": "csv"}, [{"type": "closest_points", "config": {"k": 20}}], {"trajectory": "t.txt"})
    return text.select(F.col("value").alias("metadata"))


@query("SELECT class_name, count(*) AS detections, count(DISTINCT step_nr) AS frames FROM detections GROUP BY 1 UNION ALL SELECT 'total', count(*), count(DISTINCT step_nr) FROM detections", "detections")
def class_debug_counts(spark, d):
    return stats.class_debug_counts(b.detections(spark, d))


@query("SELECT step_nr, string_agg(c, ';' ORDER BY class_name) AS detections FROM (SELECT step_nr, class_name, class_name || '=' || string_agg(CAST(detection_id AS VARCHAR), ',' ORDER BY detection_id) AS c FROM detections GROUP BY 1, 2) GROUP BY 1", "detections")
def detections_nested(spark, d):
    ids = lambda v: F.array_join(F.array_sort(F.transform(v, lambda x: x.detection_id)), ",")
    one = F.transform(F.map_entries("detections"), lambda e: F.concat(e.key, F.lit("="), ids(e.value)))
    return stats.detections_nested(b.detections(spark, d)).select("step_nr", F.array_join(F.array_sort(one), ";").alias("detections"))


@query("SELECT step_nr, string_agg(segment_id || ':' || class_label, ',' ORDER BY segment_id, class_label) AS labels FROM segment_labels GROUP BY 1", "segment_labels")
def labels_by_step(spark, d):
    rows = stats.lists_by_step(b.segment_labels(spark, d), "segment_id", "class_label")
    return rows.select("step_nr", F.array_join(F.transform("rows", lambda r: F.concat(r.segment_id.cast("string"), F.lit(":"), r.class_label)), ",").alias("labels"))


@query("SELECT DISTINCT class_label FROM segment_labels ORDER BY 1", "segment_labels")
def distinct_labels(spark, d):
    return stats.segmentation_report(b.segment_labels(spark, d)).select(F.explode("classes").alias("class_label"))


@query("SELECT step_nr, count(*) AS seen, sum(CASE WHEN value > 100 THEN 1 ELSE 0 END) AS shown FROM (SELECT event_id // 10 AS step_nr, value FROM events) GROUP BY 1")
def frame_tally(spark, d):
    return stats.reporting_counts(b.table(spark, d, "events").selectExpr("event_id DIV 10 AS step_nr", "value"), F.col("value") > 100)


@query()
def approx_classes(spark, d):
    """Users of each class, counted and as estimated with a standard error of a hundredth (no twin: the estimate is Spark's own)."""
    return stats.users_of_classes(b.detections(spark, d))


# ---- poses, styles, words


_SIGN = "CASE WHEN {w} <> 0 THEN sign({w}) WHEN {x} <> 0 THEN sign({x}) WHEN {y} <> 0 THEN sign({y}) ELSE sign({z}) END"


@query(
    f"""WITH signed AS (SELECT *, {_SIGN.format(w="qw", x="qx", y="qy", z="qz")} AS s FROM poses)
SELECT step_nr, round(qx * s, 6) + 0.0 AS qx, round(qy * s, 6) + 0.0 AS qy, round(qz * s, 6) + 0.0 AS qz, round(qw * s, 6) + 0.0 AS qw FROM signed""",
    "poses",
)
def pose_quaternions(spark, d):
    """From a rotation matrix back to its quaternion; of the two signs the one whose first component, from w, is positive."""
    names = ("qx", "qy", "qz", "qw")
    out = b.poses(spark, d).select("step_nr", *(F.round(c, 6).alias(n) for c, n in zip(g.matrix_to_quaternion(g.rotation(g.pose_quaternion())), names, strict=True)))
    sign = F.expr(_SIGN.format(w="qw", x="qx", y="qy", z="qz"))
    return out.select("step_nr", *((F.col(c) * sign + 0.0).alias(c) for c in names))


@query(
    f"""WITH {_OBJECTS}, l AS (SELECT step_nr, CASE WHEN distance <= 0.2E0 THEN 3 WHEN distance <= 0.4E0 THEN 2 WHEN distance <= 0.6E0 THEN 1 ELSE 0 END AS level_num FROM named WHERE point_idx = 0 AND distance > 0)
 SELECT step_nr, level_num, [0, 255, 255, 255][level_num + 1] AS r, [255, 255, 165, 0][level_num + 1] AS g, 0 AS b, [0.025E0, 0.035E0, 0.045E0, 0.055E0][level_num + 1] AS radius, [0.0E0, 0.0E0, 0.008E0, 0.008E0][level_num + 1] AS line_width FROM l""",
    "points poses segment_labels",
)
def warning_styles(spark, d):
    c = _objects(spark, d).where("point_idx = 0 AND distance > 0")
    return c.select("step_nr", proximity.level_style(proximity.warning_level(F.col("distance"))).alias("s")).select("step_nr", "s.*")


@query("SELECT event_id, CASE WHEN s >= 3600 THEN printf('%dh %dm %.2fs', s // 3600, (s % 3600) // 60, CAST(s % 60 AS DOUBLE)) WHEN s >= 60 THEN printf('%dm %.2fs', s // 60, CAST(s % 60 AS DOUBLE)) ELSE printf('%.2fs', CAST(s AS DOUBLE)) END AS text FROM (SELECT event_id, event_id % 7200 AS s FROM events)")
def duration_texts(spark, d):
    return b.table(spark, d, "events").select("event_id", proximity.duration_text((F.col("event_id") % 7200).cast("double")).alias("text"))


@query("SELECT point_id, CAST(floor(c * 255) AS INT) AS r, CAST(floor(c * 255 * 0.5E0) AS INT) AS g, 0 AS b FROM (SELECT point_id, (point_id % 101) / 100.0E0 AS c FROM points)", "points")
def byte_colours(spark, d):
    c = "(point_id % 101) / 100.0D"
    return pt.byte_colours(b.points(spark, d).selectExpr("point_id", f"{c} AS r", f"{c} * 0.5D AS g", "0.0D AS b")).select("point_id", "r", "g", "b")


@query("SELECT point_id, segment_id % 256 AS segment_id FROM (SELECT point_id, segment_id * 100 AS segment_id FROM points)", "points")
def wrapped_segments(spark, d):
    return pt.wrapped_segments(b.points(spark, d).selectExpr("point_id", "segment_id * 100 AS segment_id"))


@query("SELECT point_id, x, NULL AS confidence FROM points WHERE point_id % 2 = 0 UNION ALL SELECT point_id, NULL, confidence FROM points WHERE point_id % 2 = 1", "points")
def clouds_concatenated(spark, d):
    p = b.points(spark, d)
    return pt.concatenated(p.where("point_id % 2 = 0").select("point_id", "x"), p.where("point_id % 2 = 1").select("point_id", "confidence"))


# ---- video


_PROBES = "pr AS (SELECT p_partkey AS video_id, p_size % 3 = 0 AS mkv, p_size % 5 = 0 AS ten, p_size % 11 = 0 AS wide, p_size % 13 = 0 AS av1, p_size % 17 = 0 AS dv, p_size % 7 = 0 AS silent FROM part)"


@query(
    f"""WITH {_PROBES}, r AS (SELECT video_id, silent, list_filter([CASE WHEN mkv THEN 'container' END, CASE WHEN ten THEN '10-bit' END, CASE WHEN ten THEN 'profile' END, CASE WHEN wide THEN 'colour space' END, CASE WHEN dv THEN 'dolby vision' END, CASE WHEN av1 THEN 'av1' END], lambda x: x IS NOT NULL) AS l FROM pr)
 SELECT video_id, CASE WHEN silent THEN '' ELSE coalesce(array_to_string(l, ','), '') END AS reasons, NOT silent AND len(l) > 0 AS convert, CASE WHEN silent THEN 'No video stream found' END AS error FROM r"""
)
def video_probes(spark, d):
    """Probe output as JSON text, read and judged."""
    pick = lambda when, yes, no: f"CASE WHEN {when} THEN '{yes}' ELSE '{no}' END"
    stream = f"""concat('{{"codec_type":"', {pick("p_size % 7 = 0", "audio", "video")}, '","codec_name":"', {pick("p_size % 13 = 0", "av1", "h264")}, '","pix_fmt":"', {pick("p_size % 5 = 0", "yuv420p10le", "yuv420p")},
      '","profile":"', {pick("p_size % 5 = 0", "High 10", "High")}, '","color_space":"', {pick("p_size % 11 = 0", "bt2020nc", "bt709")}, '","side_data_list":[{{"side_data_type":"', {pick("p_size % 17 = 0", "DOVI configuration record", "x")}, '"}}]}}')"""
    probe = f"""concat('{{"streams":[{{"codec_type":"data"}},', {stream}, '],"format":{{"format_name":"', {pick("p_size % 3 = 0", "matroska,webm", "mov,mp4")}, '"}}}}') AS probe"""
    return video.probe_compatibility(b.table(spark, d, "part").selectExpr("p_partkey AS video_id", probe))


@query(f"WITH {_PROBES} SELECT CASE WHEN silent THEN 'error' WHEN mkv OR ten OR wide OR dv OR av1 THEN 'converted' ELSE 'skipped' END AS status, count(*) AS n FROM pr GROUP BY 1")
def conversion_tally(spark, d):
    judged = video_probes(spark, d)
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("convert"), "converted").otherwise("skipped")
    return video.tally(judged.select(status.alias("status")))


# ---- masks and memory


@query(
    """SELECT l_partkey % 40 AS mask_id, l_orderkey % 60 AS "row", l_suppkey % 50 AS col
FROM lineitem GROUP BY ALL HAVING sum(CAST(round(l_discount * 100) AS BIGINT) - 5) > 0"""
)
def mask_from_logits(spark, d):
    """Logits are whole cents of discount above five, so that no rounding decides a pixel."""
    cells = b.table(spark, d, "lineitem").selectExpr("l_partkey % 40 AS mask_id", "l_orderkey % 60 AS row", "l_suppkey % 50 AS col", "CAST(round(l_discount * 100) AS BIGINT) - 5 AS cents")
    return masks.from_logits(cells.groupBy("mask_id", "row", "col").agg(F.sum("cents").alias("logit")))


@query(f'WITH {_MASKS}, s AS (SELECT *, (mask_id * 7 + "row" * 3 + col) % 11 AS logit FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY "row", col ORDER BY logit DESC, mask_id) AS k FROM s) SELECT "row", col, mask_id, logit FROM r WHERE k = 1')
def mask_without_overlap(spark, d):
    return masks.without_overlap(_masks(spark, d).withColumn("logit", F.expr("(mask_id * 7 + row * 3 + col) % 11")))


@query(f'WITH {_MASKS} SELECT mask_id, "row" * 50 + col AS pixel_id FROM m')
def mask_pixel_ids(spark, d):
    return masks.pixel_ids(_masks(spark, d).withColumnRenamed("mask_id", "segment_id"), 50).select(F.col("segment_id").alias("mask_id"), "pixel_id")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY predicted_iou DESC, mask_id) AS k FROM (SELECT user_id AS object_id, event_id AS mask_id, round(value) / 500 AS predicted_iou FROM events)) SELECT object_id, mask_id, predicted_iou FROM r WHERE k = 1")
def mask_best_predicted(spark, d):
    return masks.best_by_predicted_iou(b.table(spark, d, "events").selectExpr("user_id AS object_id", "event_id AS mask_id", "round(value) / 500 AS predicted_iou"))


@query("SELECT event_id // 10 AS frame_idx, user_id AS object_id, value AS score FROM events")
def outputs_per_object(spark, d):
    out = b.table(spark, d, "events").groupBy(F.expr("event_id DIV 10").alias("frame_idx")).agg(F.collect_list(F.struct(F.col("user_id").alias("object_id"), F.col("value").alias("score"))).alias("objects"))
    return memory.per_object(out)


@query("SELECT user_id AS object_id, event_id AS frame_idx FROM events e WHERE event_id > coalesce((SELECT max(event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase'), -1)")
def memory_reset(spark, d):
    f = b.table(spark, d, "events").selectExpr("user_id AS object_id", "event_id AS frame_idx", "event_type")
    return memory.reset(f, f.where("event_type = 'purchase'").selectExpr("object_id", "frame_idx AS reset_at")).select("object_id", "frame_idx")


@query("SELECT s.segment_id, s.n, l.class_label FROM (SELECT segment_id, count(*) AS n FROM points GROUP BY 1) s LEFT JOIN (SELECT segment_id, arg_max(class_label, ord) AS class_label FROM segment_labels GROUP BY 1) l USING (segment_id)", "points segment_labels")
def object_classes(spark, d):
    """Segments with the class that is known of them, if any."""
    known = b.segment_labels(spark, d).groupBy("segment_id").agg(F.max_by("class_label", "ord").alias("class_label"))
    return memory.with_class(stats.class_counts(b.points(spark, d), "segment_id"), known, "segment_id")


@query(
    """WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY step_nr, class_name ORDER BY confidence DESC, detection_id) AS k, (x2 - x1) * (y2 - y1) AS area FROM detections),
 t AS (SELECT DISTINCT step_nr, class_name, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(id INT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, area DOUBLE)[]) AS kept FROM detections
  UNION ALL SELECT r.step_nr, r.class_name, r.k, CASE WHEN len(list_filter(kept, lambda o: greatest(least(o.x2, r.x2) - greatest(o.x1, r.x1), 0) * greatest(least(o.y2, r.y2) - greatest(o.y1, r.y1), 0) >
   0.5E0 * (o.area + r.area - greatest(least(o.x2, r.x2) - greatest(o.x1, r.x1), 0) * greatest(least(o.y2, r.y2) - greatest(o.y1, r.y1), 0)))) = 0
   THEN list_append(kept, {'id': detection_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'area': r.area}) ELSE kept END FROM t JOIN r ON r.step_nr = t.step_nr AND r.class_name = t.class_name AND r.k = t.k + 1),
 e AS (SELECT step_nr, class_name, arg_max(kept, k) AS kept FROM t GROUP BY 1, 2) SELECT step_nr, class_name, unnest(list_transform(kept, lambda o: o.id)) AS detection_id FROM e""",
    "detections",
)
def nms(spark, d):
    return masks.suppress(b.detections(spark, d)).select("step_nr", "class_name", "detection_id")


# ---- points and view cones


@query(
    f"""WITH m AS (SELECT step_nr, point_id FROM points, seen WHERE {_CONE} AND {_PLANAR} <= 0.5E0) SELECT step_nr, count(*) AS n, min(point_id) AS first_point, max(point_id) AS last_point FROM m GROUP BY 1""",
    "points poses",
)
def view_cone_membership(spark, d):
    """Points within half a metre along the floor and inside the cone of each pose that has any."""
    inside = knn.points_in_cone(b.points(spark, d), b.poses(spark, d), 0.5, floor=FLOOR)
    return inside.groupBy("step_nr").agg(F.count("*").alias("n"), F.min("point_id").alias("first_point"), F.max("point_id").alias("last_point"))


# ---- voxels with classes


@query(
    "WITH lo AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz FROM points) SELECT CAST(floor((x - lx) / 0.5E0) AS BIGINT) AS vx, CAST(floor((y - ly) / 0.5E0) AS BIGINT) AS vy, CAST(floor((z - lz) / 0.5E0) AS BIGINT) AS vz, count(*) AS n, round(avg(segment_id), 6) AS segment_id, round(avg(confidence), 6) AS confidence FROM points, lo GROUP BY 1, 2, 3",
    "points",
)
def voxel_classes(spark, d):
    out = sampling.voxels(b.points(spark, d), 0.5, ["segment_id", "confidence"])
    return out.select("vx", "vy", "vz", "n", F.round("segment_id", 6).alias("segment_id"), F.round("confidence", 6).alias("confidence"))


@query()
def subsample_size(spark, d):
    """A subsampled step's size, what was asked for and which way it was taken (tested against the branches by hand)."""
    p = b.points(spark, d)
    shown, how = sampling.subsample(p, 0.5)
    asked = F.floor(F.col("n") * F.lit(0.5))
    return p.agg(F.count("*").alias("n")).crossJoin(shown.agg(F.count("*").alias("shown"))).select("n", asked.alias("target"), "shown", F.lit(how).alias("how"))


# ---- several runs in one table: a session's results are those it has alone


def _two(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt to two sessions."""
    return df.withColumn("session_id", F.pmod(key, F.lit(2)))


_SEEN2 = "SELECT *, step_nr % 2 AS session_id FROM seen"


@query(
    f"""WITH near AS (SELECT s.session_id, step_nr, point_id, round({_PLANAR}, 6) AS distance, row_number() OVER (PARTITION BY s.session_id, step_nr ORDER BY round({_PLANAR}, 6), point_id) - 1 AS point_idx
 FROM points p JOIN ({_SEEN2}) s ON s.session_id = p.point_id % 2 WHERE abs(y) > 0.05E0 AND segment_id > 0 AND {_CONE}) SELECT session_id, step_nr, CAST(point_idx AS INT) AS point_idx, point_id, distance FROM near WHERE point_idx < 20""",
    "points poses",
)
def sessions_closest_points(spark, d):
    found = knn.nearest_points(_two(b.points(spark, d), "point_id"), _two(b.poses(spark, d), "step_nr"), floor=FLOOR, by=["session_id"])
    return found.select("session_id", "step_nr", "point_idx", "point_id", "distance")


@query(
    """WITH downs AS (SELECT step_nr % 2 AS session_id, row_number() OVER (PARTITION BY step_nr % 2 ORDER BY step_nr) AS i, step_nr, -2 * (qx * qy - qz * qw) AS dx, -(1 - 2 * (qx * qx + qz * qz)) AS dy, -2 * (qy * qz + qx * qw) AS dz FROM poses),
 win AS (SELECT a.session_id, a.step_nr, b.dx, b.dy, b.dz, row_number() OVER (PARTITION BY a.step_nr ORDER BY b.step_nr) AS k FROM downs a JOIN downs b ON a.session_id = b.session_id AND b.i BETWEEN a.i - 29 AND a.i),
 m AS (SELECT session_id, step_nr, avg(dx) AS x, avg(dy) AS y, avg(dz) AS z FROM win WHERE k <= 10 GROUP BY 1, 2)
 SELECT session_id, step_nr, round(x / sqrt(x*x+y*y+z*z), 6) + 0 AS gx, round(y / sqrt(x*x+y*y+z*z), 6) + 0 AS gy, round(z / sqrt(x*x+y*y+z*z), 6) + 0 AS gz FROM m""",
    "poses",
)
def sessions_gravity(spark, d):
    out = floor.gravity(_two(b.poses(spark, d), "step_nr"), by=["session_id"])
    return out.select("session_id", "step_nr", *((F.col(c) + 0.0).alias(c) for c in ("gx", "gy", "gz")))


@query("WITH o AS (SELECT step_nr % 2 AS session_id, step_nr, row_number() OVER (PARTITION BY step_nr % 2 ORDER BY step_nr) - 1 AS i, count(*) OVER (PARTITION BY step_nr % 2) AS n FROM poses) SELECT session_id, step_nr, CAST(floor(i / CAST(greatest(n - 1, 1) AS DOUBLE) * 299.0E0) AS BIGINT) AS frame_idx FROM o", "poses")
def sessions_video_map(spark, d):
    return align.video_frames(_two(b.poses(spark, d), "step_nr"), 300, by=["session_id"])


@query(
    """WITH s AS (SELECT step_nr % 2 AS session_id, step_nr AS snapshot_step FROM poses WHERE step_nr % 10 IN (3, 8)), e AS (SELECT session_id, min(snapshot_step) AS lo, max(snapshot_step) AS hi FROM s GROUP BY 1),
 o AS (SELECT step_nr % 2 AS session_id, step_nr, row_number() OVER (PARTITION BY step_nr % 2 ORDER BY step_nr) - 1 AS i, count(*) OVER (PARTITION BY step_nr % 2) AS n FROM poses),
 t AS (SELECT o.session_id, step_nr, CAST(floor(lo + i / CAST(greatest(n - 1, 1) AS DOUBLE) * (hi - lo)) AS BIGINT) AS tgt FROM o LEFT JOIN e USING (session_id)),
 r AS (SELECT t.session_id, step_nr, snapshot_step, row_number() OVER (PARTITION BY step_nr ORDER BY abs(snapshot_step - tgt), snapshot_step) AS k FROM t LEFT JOIN s USING (session_id)) SELECT session_id, step_nr, snapshot_step FROM r WHERE k = 1""",
    "poses",
)
def sessions_nearest_snapshot(spark, d):
    p = _two(b.poses(spark, d), "step_nr")
    return align.nearest_snapshot(p, p.where("step_nr % 10 IN (3, 8)").select("session_id", F.col("step_nr").alias("snapshot_step")), by=["session_id"])


_DOT2 = "list_sum(list_transform(list_zip(a.embedding, c.embedding), lambda t: CAST(t[1] AS DOUBLE) * CAST(t[2] AS DOUBLE)))"


@query(
    f"""WITH v AS (SELECT keyframe_id * 1000003 AS keyframe_id, keyframe_id % 3 AS session_id, embedding FROM (SELECT CAST(keyframe_id AS BIGINT) AS keyframe_id, embedding FROM descriptors)),
 sim AS (SELECT a.session_id, a.keyframe_id, c.keyframe_id AS match_id, round({_DOT2}, 6) AS similarity FROM v a JOIN v c ON c.session_id = a.session_id AND c.keyframe_id < a.keyframe_id),
 rk AS (SELECT *, row_number() OVER (PARTITION BY session_id, keyframe_id ORDER BY similarity DESC, match_id) AS r FROM sim WHERE similarity > 5e-3),
 before AS (SELECT session_id, keyframe_id, lag(keyframe_id) OVER (PARTITION BY session_id ORDER BY keyframe_id) AS previous FROM v)
 SELECT session_id, keyframe_id AS src, match_id AS dst FROM rk WHERE r <= 3 UNION SELECT session_id, keyframe_id, previous FROM before WHERE previous IS NOT NULL""",
    "descriptors",
)
def sessions_sparse_edges(spark, d):
    """Three runs whose keyframe ids lie far apart."""
    v = b.descriptors(spark, d).selectExpr("CAST(keyframe_id AS BIGINT) * 1000003 AS keyframe_id", "keyframe_id % 3 AS session_id", "embedding")
    return graph.edges(v, by=["session_id"])


@query("WITH p AS (SELECT *, point_id % 2 AS session_id FROM points), lo AS (SELECT session_id, min(x) AS lx, min(y) AS ly, min(z) AS lz FROM p GROUP BY 1) SELECT p.session_id, CAST(floor((x - lx) / 0.5E0) AS BIGINT) AS vx, CAST(floor((y - ly) / 0.5E0) AS BIGINT) AS vy, CAST(floor((z - lz) / 0.5E0) AS BIGINT) AS vz, count(*) AS n FROM p JOIN lo USING (session_id) GROUP BY 1, 2, 3, 4", "points")
def sessions_voxels(spark, d):
    return sampling.voxels(_two(b.points(spark, d), "point_id"), 0.5, by=["session_id"]).select("session_id", "vx", "vy", "vz", "n")


@query("WITH p AS (SELECT *, step_nr % 2 AS session_id, row_number() OVER (PARTITION BY step_nr % 2 ORDER BY step_nr) AS i FROM poses) SELECT a.session_id, a.step_nr, round(sqrt((c.tx-a.tx)**2 + (c.ty-a.ty)**2 + (c.tz-a.tz)**2), 6) AS length FROM p a JOIN p c ON a.session_id = c.session_id AND c.i = a.i + 1", "poses")
def sessions_trajectory(spark, d):
    """Steps of a session are every other one, so each line spans a gap."""
    return scene.trajectory_segments(_two(b.poses(spark, d), "step_nr"), by=["session_id"]).select("session_id", "step_nr", "length")
