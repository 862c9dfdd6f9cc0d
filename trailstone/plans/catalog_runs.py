"""Queries about whole runs: the frame loop, running values, checks, versions, timing, the scene log and SQL users' view."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import proximity
from ..operators import checks, fusion, scene, sketches, stats, versions
from ..operators.ordered import running
from ..sources import bindings as b
from ..sql import register
from ..streaming import frames as frame_loop_
from .catalog import _OBSERVED, ORACLE_SQL, _observed, query
from .staging import shared_folder, written

# ---- the frame loop over a table


@query(
    """WITH RECURSIVE f AS (
  SELECT CAST(p.step_nr % 2 AS VARCHAR) AS session_id, p.step_nr, l.ny, l."offset",
    row_number() OVER (PARTITION BY p.step_nr % 2 ORDER BY p.step_nr) AS i
  FROM poses p LEFT JOIN floors l ON l.step_nr = p.step_nr),
tried AS (
  SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS step_nr, FALSE AS run, 'none' AS action, FALSE AS found,
    CAST(0 AS BIGINT) AS refined, CAST(NULL AS BIGINT) AS last_run, CAST(NULL AS DOUBLE) AS ny, CAST(NULL AS DOUBLE) AS "offset" FROM f
  UNION ALL
  SELECT session_id, i, step_nr, run, action, found OR (action <> 'none' AND new_ny IS NOT NULL),
    CASE WHEN action = 'refine' THEN i ELSE refined END, CASE WHEN run THEN step_nr ELSE last_run END,
    CASE WHEN action <> 'none' AND new_ny IS NOT NULL THEN new_ny ELSE ny END,
    CASE WHEN action <> 'none' AND new_ny IS NOT NULL THEN new_offset ELSE "offset" END
  FROM (SELECT f.session_id, f.i, f.step_nr, f.ny AS new_ny, f."offset" AS new_offset, t.found, t.refined, t.last_run, t.ny, t."offset",
      t.last_run IS NULL OR f.step_nr - t.last_run >= 5 AS run,
      CASE WHEN NOT t.found AND f.i >= 3 THEN 'detect' WHEN t.found AND f.i - t.refined >= 4 THEN 'refine' ELSE 'none' END AS action
    FROM tried t JOIN f ON f.session_id = t.session_id AND f.i = t.i + 1)),
labels AS (SELECT DISTINCT step_nr, CAST(step_nr % 2 AS VARCHAR) AS session_id, segment_id, class_label FROM segment_labels),
known AS (
  SELECT f.session_id, f.step_nr, l.segment_id, arg_max(l.class_label, (l.step_nr, l.class_label)) AS class_label
  FROM f JOIN labels l ON l.session_id = f.session_id AND l.step_nr <= f.step_nr
    AND l.step_nr IN (SELECT step_nr FROM poses) GROUP BY ALL)
SELECT t.session_id, t.step_nr, t.run, t.action, t.ny, t."offset",
  coalesce((SELECT string_agg(k.segment_id || '=' || k.class_label, ',' ORDER BY k.segment_id) FROM known k
    WHERE k.session_id = t.session_id AND k.step_nr = t.step_nr), '') AS labels
FROM tried t WHERE t.i > 0""",
    "poses floors segment_labels",
)
def frame_loop(spark, d):
    """Every pose as a frame of one of two sessions; the batch form of the stream."""
    planes = b.floor_observations(spark, d)
    labels = b.segment_labels(spark, d).groupBy("step_nr").agg(F.collect_set(F.struct("segment_id", "class_label")).alias("labels"))
    poses = b.poses(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).join(planes, "step_nr", "left").join(labels, "step_nr", "left")
    frames = poses.withColumn("session_id", (F.col("step_nr") % 2).cast("string"))
    out = frame_loop_.frame_loop_batch(frames, frame_loop_.Settings(every=5, min_frames=3, interval=4))
    said = F.array_join(F.transform("labels", lambda x: F.concat(x["segment_id"].cast("string"), F.lit("="), x["class_label"])), ",")
    return out.select("session_id", "step_nr", "run", "action", "ny", "offset", said.alias("labels"))


# ---- running values

_HOT_PIXEL = "CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 50 END"


@query(
    f"""WITH o AS (SELECT {_HOT_PIXEL} AS pixel, o_orderkey AS frame, o_custkey % 200 AS value, 1 + o_custkey % 9 AS weight FROM orders)
SELECT pixel, frame, count(*) OVER w AS n, CAST(sum(weight) OVER w AS BIGINT) AS weight_so_far,
  round(CAST(sum(weight * value) OVER w AS DOUBLE) / CAST(sum(weight) OVER w AS DOUBLE), 9) AS mean_so_far, max(weight) OVER w AS best_so_far
FROM o WINDOW w AS (PARTITION BY pixel ORDER BY frame)"""
)
def running_fusion(spark, d):
    """Fusion counters and means after every observation; a third of all observations are of one pixel."""
    seen = b.table(spark, d, "orders").selectExpr(f"{_HOT_PIXEL} AS pixel", "o_orderkey AS frame", "o_custkey % 200 AS value", "1 + o_custkey % 9 AS weight")
    out = fusion.running_fusion(seen, ["pixel"], ["frame"])
    return out.select("pixel", "frame", "n", "weight_so_far", F.round("mean_so_far", 9).alias("mean_so_far"), "best_so_far")


@query(
    """WITH f AS (SELECT event_id // 10 AS step_nr, count(*) FILTER (WHERE value > 100) AS shown FROM events GROUP BY 1)
SELECT step_nr, shown, CAST(sum(CASE WHEN shown > 0 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS frames_shown,
  CAST(sum(shown) OVER w AS BIGINT) AS shown_so_far, max(shown) OVER w AS most_so_far FROM f WINDOW w AS (ORDER BY step_nr)"""
)
def running_shown(spark, d):
    """How many frames, and detections in them, have been shown by each step."""
    frames = b.table(spark, d, "events").groupBy(F.expr("event_id DIV 10").alias("step_nr")).agg(F.count_if(F.col("value") > 100).alias("shown"))
    one = F.struct((F.col("shown") > 0).cast("long").alias("frames"), F.col("shown").alias("all"), F.col("shown").alias("most"))
    both = lambda x, y: F.struct((x["frames"] + y["frames"]).alias("frames"), (x["all"] + y["all"]).alias("all"), F.greatest(x["most"], y["most"]).alias("most"))
    out = running(frames, [], ["step_nr"], one, both, "s")
    return out.select("step_nr", "shown", F.col("s.frames").alias("frames_shown"), F.col("s.all").alias("shown_so_far"), F.col("s.most").alias("most_so_far"))


# ---- checks


@query(
    """WITH boxes AS (SELECT step_nr, detection_id, CASE WHEN detection_id = 7 THEN [x1, y1, x2] WHEN detection_id = 8 THEN [x2, y1, x1, y2]
    WHEN detection_id = 9 THEN [x1, y1, NULL, y2] ELSE [x1, y1, x2, y2] END AS bbox FROM detections)
SELECT step_nr, detection_id, CASE detection_id WHEN 7 THEN 'four_numbers,positive_area' WHEN 8 THEN 'positive_area' ELSE 'finite,positive_area' END AS broken
FROM boxes WHERE detection_id IN (7, 8, 9)""",
    "detections",
)
def bbox_rejects(spark, d):
    """Boxes with a number too few, with corners the wrong way round, or with a number missing."""
    box = "CASE detection_id WHEN 7 THEN array(x1, y1, x2) WHEN 8 THEN array(x2, y1, x1, y2) WHEN 9 THEN array(x1, y1, CAST(NULL AS DOUBLE), y2) ELSE array(x1, y1, x2, y2) END AS bbox"
    _, rejects, _ = checks.split(b.detections(spark, d).selectExpr("step_nr", "detection_id", box), checks.box_rules())
    return rejects.select("step_nr", "detection_id", F.array_join("broken", ",").alias("broken"))


@query(
    """WITH o AS (SELECT user_id AS object_id, event_id // 100 AS frame_idx FROM events)
SELECT object_id, frame_idx, first_frame FROM o JOIN (SELECT object_id, min(frame_idx) AS first_frame FROM o GROUP BY 1) USING (object_id) WHERE first_frame >= 1"""
)
def late_objects(spark, d):
    """Outputs of objects that weren't there when tracking began."""
    return checks.late_objects(b.table(spark, d, "events").selectExpr("user_id AS object_id", "event_id DIV 100 AS frame_idx"), 1)


@query(
    """WITH t AS (SELECT user_id AS object_id, event_id // 100 AS frame_idx FROM events WHERE event_type = 'click'),
f AS (SELECT user_id AS object_id, event_id // 100 AS frame_idx FROM events WHERE event_type = 'purchase'),
x AS (SELECT *, 1 AS t, 0 AS f FROM t UNION ALL SELECT *, 0, 1 FROM f)
SELECT object_id, frame_idx, CAST(sum(t) AS BIGINT) AS temporary, CAST(sum(f) AS BIGINT) AS final FROM x GROUP BY 1, 2 HAVING count(*) <> 1"""
)
def output_conflicts(spark, d):
    rows = b.table(spark, d, "events").selectExpr("user_id AS object_id", "event_id DIV 100 AS frame_idx", "event_type")
    return checks.output_conflicts(rows.where("event_type = 'click'"), rows.where("event_type = 'purchase'"))


# ---- keyframes as a versioned table


@query(
    """WITH v AS (SELECT CAST(event_id % 97 AS BIGINT) AS keyframe_id, event_id // 1000 AS step_nr, max(event_id) AS seen, max(value) AS value FROM events GROUP BY 1, 2),
kept AS (SELECT * FROM v WHERE step_nr % 4 <> 2)
SELECT keyframe_id, step_nr AS valid_from, lead(step_nr) OVER (PARTITION BY keyframe_id ORDER BY step_nr) AS valid_to, seen, value FROM kept"""
)
def keyframe_versions(spark, d):
    """A batch of upserts for each thousand events; every fourth is withdrawn, and the first is applied twice."""
    events = b.table(spark, d, "events").selectExpr("event_id % 97 AS keyframe_id", "event_id DIV 1000 AS step_nr", "event_id", "value")
    rows = events.where("step_nr IS NOT NULL").groupBy("keyframe_id", "step_nr").agg(F.max("event_id").alias("seen"), F.max("value").alias("value"))
    rows = written(rows.withColumn("batch", F.col("step_nr")), "batches")
    table = versions.VersionedTable(spark, f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}", "keyframe_id long, seen long, value double")
    first = rows.agg(F.min("step_nr")).first()[0]
    if first is not None:
        table.apply(first, first, rows.where(F.col("step_nr") == first))
    table.apply_all(rows)
    table.withdraw(10_000_000, rows.where("step_nr % 4 = 2").select(F.col("step_nr").alias("withdrawn_batch")).distinct())
    return table.intervals().select("keyframe_id", "valid_from", "valid_to", "seen", "value")


# ---- the scene log


@query(
    """WITH t AS (SELECT step_nr, 'pose' AS kind, CAST(step_nr AS BIGINT) AS id, round(tx, 6) AS x, CAST(NULL AS VARCHAR) AS said FROM poses
  UNION ALL SELECT step_nr, 'detection', CAST(detection_id AS BIGINT), round(x1, 6), class_name FROM detections
  UNION ALL SELECT step_nr, 'label', CAST(segment_id AS BIGINT), CAST(NULL AS DOUBLE), class_label FROM segment_labels)
SELECT * FROM t""",
    "poses detections segment_labels",
)
def scene_log(spark, d):
    """Poses, detections and labels in one table of payloads by step, and read back from it."""
    log = scene.scene_log(
        {
            "pose": b.poses(spark, d).selectExpr("step_nr", "step_nr AS id", "tx", "ty", "tz"),
            "detection": b.detections(spark, d).selectExpr("step_nr", "CAST(detection_id AS LONG) AS id", "class_name", "x1", "y1", "x2", "y2"),
            "label": b.segment_labels(spark, d).selectExpr("step_nr", "CAST(segment_id AS LONG) AS id", "class_label"),
        }
    )
    x = F.coalesce(F.try_variant_get("payload", "$.tx", "double"), F.try_variant_get("payload", "$.x1", "double"))
    said = F.coalesce(F.try_variant_get("payload", "$.class_name", "string"), F.try_variant_get("payload", "$.class_label", "string"))
    return log.select("step_nr", "kind", F.try_variant_get("payload", "$.id", "long").alias("id"), F.round(x, 6).alias("x"), said.alias("said"))


# ---- sketches


@query()
def merged_sketches(spark, d):
    """Users and the median confidence of each class, from sketches of runs of a thousand steps, and from all rows at once."""
    rows = b.detections(spark, d).withColumn("run", F.expr("step_nr DIV 100"))
    return sketches.merged(sketches.by_run(rows, ["class_name"], "run", "user_id", "confidence"), ["class_name"])


# ---- the engine in SQL text


@query()
def view_cone_lines_sql(spark, d):
    register(spark, d)
    return spark.sql(
        """SELECT p.step_nr, c.kind, c.idx, round(c.ax, 5) + 0.0D AS ax, round(c.ay, 5) + 0.0D AS ay, round(c.az, 5) + 0.0D AS az,
             round(c.bx, 5) + 0.0D AS bx, round(c.by, 5) + 0.0D AS by, round(c.bz, 5) + 0.0D AS bz
           FROM poses p, LATERAL view_cone(p.tx, p.ty, p.tz, p.qx, p.qy, p.qz, p.qw, CAST(NULL AS DOUBLE)) c"""
    )


@query()
def floor_grid_lines_sql(spark, d):
    register(spark, d)
    return spark.sql(
        """SELECT g.axis, g.idx, round(g.ax, 5) + 0.0D AS ax, abs(round(g.ay, 5)) AS ay, round(g.az, 5) + 0.0D AS az,
             round(g.bx, 5) + 0.0D AS bx, abs(round(g.by, 5)) AS by, round(g.bz, 5) + 0.0D AS bz
           FROM (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM points) c, LATERAL floor_grid(c.cx, c.cy, c.cz, 0.0D, 1.0D, 0.0D, 0.0D) g"""
    )


ORACLE_SQL["view_cone_lines_sql"], ORACLE_SQL["floor_grid_lines_sql"] = ORACLE_SQL["view_cone_lines"], ORACLE_SQL["floor_grid_lines"]


@query(
    """SELECT step_nr, count(*) AS seen, round(min(sqrt((x - tx) * (x - tx) + (z - tz) * (z - tz))), 6) AS nearest,
  CASE WHEN min(sqrt((x - tx) * (x - tx) + (z - tz) * (z - tz))) <= 0.2 THEN 'critical' WHEN min(sqrt((x - tx) * (x - tx) + (z - tz) * (z - tz))) <= 0.4 THEN 'strong'
    WHEN min(sqrt((x - tx) * (x - tx) + (z - tz) * (z - tz))) <= 0.6 THEN 'caution' ELSE 'normal' END AS level
FROM points JOIN seen ON points.keyframe_id = seen.step_nr % 16
WHERE abs(y) > 0.05E0 AND sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty) + (z - tz) * (z - tz)) > 1e-6
  AND (x - tx) * fx + (y - ty) * fy + (z - tz) * fz >= sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty) + (z - tz) * (z - tz)) * 0.7071067811865476E0
GROUP BY step_nr""",
    "points poses",
)
def warnings_in_sql(spark, d):
    """Each pose's own keyframe's points in its cone, all of it in SQL text."""
    register(spark, d)
    return spark.sql(
        """SELECT step_nr, count(*) AS seen, round(min(planar_distance(x, z, tx, tz)), 6) AS nearest, warning_level(min(planar_distance(x, z, tx, tz))) AS level
           FROM points JOIN poses ON points.keyframe_id = poses.step_nr % 16
           WHERE plane_distance(x, y, z, 0.0D, 1.0D, 0.0D, 0.0D) > 0.05D
             AND in_view_cone(x, y, z, tx, ty, tz, camera_forward(qx, qy, qz, qw), 45.0D)
           GROUP BY step_nr"""
    )


# ---- a floor that isn't level

SLANTED = (0.6, 0.8, 0.0, 0.3)


@query(
    """SELECT point_id, round(0.6E0 * x + 0.8E0 * y - 0.3E0, 6) + 0.0 AS height, round(x - 0.6E0 * (0.6E0 * x + 0.8E0 * y - 0.3E0), 6) + 0.0 AS fx,
  round(y - 0.8E0 * (0.6E0 * x + 0.8E0 * y - 0.3E0), 6) + 0.0 AS fy, round(z, 6) AS fz FROM points""",
    "points",
)
def slanted_floor_feet(spark, d):
    """Each point's foot on a slanted plane and its height above it."""
    n, p = g.const(*SLANTED[:3]), g.vec("x", "y", "z")
    foot = g.project(p, n, F.lit(SLANTED[3]))
    height = g.dot(p, n) - F.lit(SLANTED[3])
    return b.points(spark, d).select("point_id", (F.round(height, 6) + 0.0).alias("height"), *((F.round(c, 6) + 0.0).alias(k) for c, k in zip(foot, ("fx", "fy", "fz"), strict=True)))


@query(
    """WITH c AS (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM points), f AS (SELECT cx - 0.6E0 * (0.6E0 * cx + 0.8E0 * cy - 0.3E0) AS fx, cy - 0.8E0 * (0.6E0 * cx + 0.8E0 * cy - 0.3E0) AS fy, cz AS fz FROM c),
l AS (SELECT a AS axis, CAST(i AS INT) - 5 AS idx, fx, fy, fz FROM f, (SELECT unnest(['u', 'v']) AS a), range(11) r(i))
SELECT axis, idx, round(CASE axis WHEN 'u' THEN fx - 0.8E0 * idx ELSE fx + 4.0E0 END, 5) + 0.0 AS ax, round(CASE axis WHEN 'u' THEN fy + 0.6E0 * idx ELSE fy - 3.0E0 END, 5) + 0.0 AS ay,
  round(CASE axis WHEN 'u' THEN fz + 5.0E0 ELSE fz - idx END, 5) + 0.0 AS az, round(CASE axis WHEN 'u' THEN fx - 0.8E0 * idx ELSE fx - 4.0E0 END, 5) + 0.0 AS bx,
  round(CASE axis WHEN 'u' THEN fy + 0.6E0 * idx ELSE fy + 3.0E0 END, 5) + 0.0 AS "by", round(CASE axis WHEN 'u' THEN fz - 5.0E0 ELSE fz - idx END, 5) + 0.0 AS bz FROM l""",
    "points",
)
def slanted_floor_grid(spark, d):
    centre = b.points(spark, d).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"))
    out = scene.floor_grid(centre, SLANTED)
    return out.withColumns({c: F.col(c) + 0.0 for c in ("ax", "ay", "az", "bx", "by", "bz")})


# ---- the rest by name


@query(
    f"""WITH {_OBSERVED}, gr AS (SELECT *, frame // 50 AS grp FROM obs), s AS (SELECT grp, round(avg(c), 6) AS score FROM gr GROUP BY grp),
best AS (SELECT grp FROM s ORDER BY score DESC, grp LIMIT 1) SELECT grp, pixel, frame, x, c FROM gr WHERE grp IN (SELECT grp FROM best)"""
)
def fuse_best_mean_score(spark, d):
    return fusion.best_score(_observed(spark, d).withColumn("grp", F.expr("frame DIV 50")), by_mean=True)


@query(
    """SELECT step_nr, CAST(row_number() OVER (PARTITION BY step_nr ORDER BY confidence DESC, class_name, ts, x1, y1, x2, y2, user_id) - 1 AS INTEGER) AS detection_id,
  class_name, round(confidence, 6) AS confidence, x1 FROM detections""",
    "detections",
)
def detection_numbers(spark, d):
    """Detections numbered within their frame, the most confident first."""
    rows = b.detections(spark, d).drop("detection_id")
    order = [-F.col("confidence"), *(F.col(c) for c in ("class_name", "ts", "x1", "y1", "x2", "y2", "user_id"))]
    return stats.numbered_in_step(rows, *order).select("step_nr", "detection_id", "class_name", F.round("confidence", 6).alias("confidence"), "x1")


@query(
    """SELECT step_nr, detection_id, class_name, unnest([2, 3]) AS label, unnest([x1 / 640 * 1024, x2 / 640 * 1024]) AS px,
  unnest([y1 / 480 * 1024, y2 / 480 * 1024]) AS py FROM detections""",
    "detections",
)
def bbox_prompts_labelled(spark, d):
    return scene.prompts(b.detections(spark, d), 640, 480, also=["class_name"])


@query(
    """WITH u AS (SELECT DISTINCT class_name, 0 AS t FROM detections UNION ALL SELECT DISTINCT class_label, 1 FROM segment_labels)
SELECT class_name, count(*) AS tables FROM u GROUP BY 1""",
    "detections segment_labels",
)
def class_union(spark, d):
    return stats.class_union((b.detections(spark, d), "class_name"), (b.segment_labels(spark, d), "class_label"))


@query("SELECT step_nr, class_name FROM detections EXCEPT ALL SELECT step_nr, class_name FROM detections WHERE confidence >= 0.5", "detections")
def detections_except_sure(spark, d):
    """Steps and classes of detections, as often as they are left once the sure ones are taken out."""
    rows = b.detections(spark, d)
    return rows.select("step_nr", "class_name").exceptAll(rows.where("confidence >= 0.5").select("step_nr", "class_name"))


@query("SELECT step_nr, tx, ty, tz FROM poses WHERE step_nr IN (SELECT step_nr FROM segment_labels WHERE segment_id > 0)", "poses segment_labels")
def poses_with_labels(spark, d):
    """Poses of steps in which a segment is named."""
    return b.poses(spark, d).join(b.segment_labels(spark, d).where("segment_id > 0"), "step_nr", "left_semi").select("step_nr", "tx", "ty", "tz")


@query("SELECT segment_id, class_label, step_nr FROM segment_labels WHERE step_nr < (SELECT count(*) FROM poses)", "segment_labels poses")
def labels_within_run(spark, d):
    """Labels of steps that the run has."""
    many = b.poses(spark, d).agg(F.count("*").alias("_many"))  # one row
    return b.segment_labels(spark, d).join(F.broadcast(many), F.col("step_nr") < F.col("_many")).select("segment_id", "class_label", "step_nr")


@query(
    """SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || strftime(ts, '%f') END AS iso FROM events"""
)
def run_stamps(spark, d):
    return b.table(spark, d, "events").select("event_id", proximity.run_stamp(F.col("ts")).alias("stamp"), proximity.iso_format(F.col("ts")).alias("iso"))
