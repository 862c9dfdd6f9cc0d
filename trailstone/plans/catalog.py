"""Registry of the engine's queries over the driver's tables, with DuckDB twins written independently in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import proximity
from ..operators import align, asof, floor, fusion, graph, knn, masks, memory, sampling, scene, stats, video
from ..operators import points as pt
from ..operators.ordered import over_recent
from ..sources import bindings as b
from ..sources import files
from ..streaming import stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

FLOOR = (0.0, 1.0, 0.0, 0.0)
COS45 = "0.7071067811865476E0"


def query(sql: str | None = None, views: str = ""):
    """Registers a query and its twin; `views` names the bindings that the SQL reads."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            parts = [b.SQL[v] for v in views.split()]
            body = sql.strip()
            if parts and body.upper().startswith("WITH RECURSIVE "):
                body = "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[15:]
            elif parts and body.upper().startswith("WITH "):
                body = "WITH " + ",\n".join(parts) + ",\n" + body[5:]
            elif parts:
                body = "WITH " + ",\n".join(parts) + "\n" + body
            ORACLE_SQL[f.__name__] = body
        return f

    return add


# ---- nearest points


def _knn_sql(where: str, distance: str) -> str:
    return f"""
WITH near AS (SELECT step_nr, point_id, x, y, z, segment_id, round({distance}, 6) AS distance,
  row_number() OVER (PARTITION BY step_nr ORDER BY round({distance}, 6), point_id) - 1 AS point_idx
  FROM points, seen WHERE {where})
SELECT step_nr, CAST(point_idx AS INT) AS point_idx, point_id, x, y, z, distance, segment_id FROM near WHERE point_idx < 20"""


_PLANAR = "sqrt((x - tx) * (x - tx) + (z - tz) * (z - tz))"
_SPACE = "sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty) + (z - tz) * (z - tz))"
_CONE = f"{_SPACE} > 1e-6 AND (x - tx) * fx + (y - ty) * fy + (z - tz) * fz >= {_SPACE} * {COS45}"


@query(_knn_sql(f"abs(y) > 0.05E0 AND segment_id > 0 AND {_CONE}", _PLANAR), "points poses")
def closest_points_cone(spark, d):
    return knn.nearest_points(b.points(spark, d), b.poses(spark, d), floor=FLOOR)


@query(_knn_sql("abs(y) > 0.05E0 AND segment_id > 0", _PLANAR), "points poses")
def closest_points_planar(spark, d):
    return knn.nearest_points(b.points(spark, d), b.poses(spark, d), floor=FLOOR, half_angle=None)


@query(_knn_sql("TRUE", _SPACE), "points poses")
def closest_points_3d(spark, d):
    return knn.nearest_points(b.points(spark, d), b.poses(spark, d), half_angle=None, only_segmented=False)


_OBJECTS = f"""near AS (SELECT step_nr, point_id, x, y, z, segment_id, round({_PLANAR}, 6) AS distance,
  row_number() OVER (PARTITION BY step_nr ORDER BY round({_PLANAR}, 6), point_id) - 1 AS point_idx
  FROM points, seen WHERE abs(y) > 0.05E0 AND segment_id > 0 AND {_CONE}),
closest AS (SELECT * FROM near WHERE point_idx < 20),
named AS (SELECT c.*, coalesce((SELECT arg_max(class_label, l.step_nr * 1000000 + l.ord) FROM segment_labels l
  WHERE l.segment_id = c.segment_id AND l.step_nr <= c.step_nr), 'unknown') AS class_label FROM closest c)"""


def _objects(spark, d):
    return asof.label_points(closest_points_cone(spark, d), b.segment_labels(spark, d))


@query(f"WITH {_OBJECTS} SELECT step_nr, CAST(point_idx AS INT) AS point_idx, point_id, distance, segment_id, class_label FROM named", "points poses segment_labels")
def closest_objects_labeled(spark, d):
    return _objects(spark, d).select("step_nr", "point_idx", "point_id", "distance", "segment_id", "class_label")


@query(f"WITH {_OBJECTS} SELECT count(distance) AS n, round(avg(distance), 6) AS mean, min(distance) AS min, max(distance) AS max, round(stddev_pop(distance), 5) AS std FROM named", "points poses segment_labels")
def distance_stats(spark, d):
    return stats.distance_stats(closest_points_cone(spark, d))


@query(f"WITH {_OBJECTS} SELECT step_nr, count(*) AS records, count(DISTINCT segment_id) AS segments FROM named GROUP BY step_nr", "points poses segment_labels")
def objects_summary(spark, d):
    return stats.objects_summary(closest_points_cone(spark, d))


@query(
    f"""WITH {_OBJECTS} SELECT p.step_nr, coalesce(x, tx) AS x, coalesce(y, ty) AS y, coalesce(z, tz) AS z, coalesce(distance, 0) AS distance,
 coalesce(segment_id, -1) AS segment_id, coalesce(class_label, 'unknown') AS class_label, distance IS NOT NULL AS valid
 FROM poses p LEFT JOIN (SELECT * FROM named WHERE point_idx = 0) n USING (step_nr)""",
    "points poses segment_labels",
)
def trajectory_closest_left(spark, d):
    return align.trajectory_closest(b.poses(spark, d), _objects(spark, d))


_LEVEL = "CASE WHEN distance <= 0.2E0 THEN 'critical' WHEN distance <= 0.4E0 THEN 'strong' WHEN distance <= 0.6E0 THEN 'caution' ELSE 'normal' END"
_NUMBER = "CASE WHEN distance <= 0.2E0 THEN 3 WHEN distance <= 0.4E0 THEN 2 WHEN distance <= 0.6E0 THEN 1 ELSE 0 END"


def _warned(spark, d):
    c = _objects(spark, d).where("point_idx = 0 AND distance > 0")
    return c.withColumn("level", proximity.warning_level(F.col("distance")))


@query(f"WITH {_OBJECTS} SELECT step_nr, distance, {_LEVEL} AS level, {_NUMBER} AS level_num FROM named WHERE point_idx = 0 AND distance > 0", "points poses segment_labels")
def warning_levels(spark, d):
    return _warned(spark, d).select("step_nr", "distance", "level", proximity.level_number(F.col("level")).alias("level_num"))


_LOCAL = """local AS (SELECT n.*, (1 - 2 * (qy * qy + qz * qz)) * (x - tx) + 2 * (qx * qy + qz * qw) * (y - ty) + 2 * (qx * qz - qy * qw) * (z - tz) AS cx,
 2 * (qx * qy - qz * qw) * (x - tx) + (1 - 2 * (qx * qx + qz * qz)) * (y - ty) + 2 * (qy * qz + qx * qw) * (z - tz) AS cy,
 2 * (qx * qz + qy * qw) * (x - tx) + 2 * (qy * qz - qx * qw) * (y - ty) + (1 - 2 * (qx * qx + qy * qy)) * (z - tz) AS cz
 FROM named n JOIN poses USING (step_nr)),
 worded AS (SELECT *, list_filter([CASE WHEN cz > 0.1 THEN 'ahead' WHEN cz < -0.1 THEN 'behind' END, CASE WHEN cx > 0.1 THEN 'right' WHEN cx < -0.1 THEN 'left' END,
 CASE WHEN cy > 0.1 THEN 'below' WHEN cy < -0.1 THEN 'above' END], lambda w: w IS NOT NULL) AS parts FROM local),
 phrased AS (SELECT *, CASE len(parts) WHEN 0 THEN 'directly in front' WHEN 1 THEN 'to your ' || parts[1] ELSE array_to_string(parts, '-') END AS direction FROM worded)"""


def _phrased(spark, d, closest):
    posed = closest.join(b.poses(spark, d).drop("ts"), "step_nr")
    local = g.rotate_back(g.pose_quaternion(), g.sub(g.vec(), g.pose_position()))
    return posed.withColumn("direction", proximity.direction_phrase(local))


@query(f"WITH {_OBJECTS}, {_LOCAL} SELECT step_nr, point_id, direction FROM phrased", "points poses segment_labels")
def direction_phrases(spark, d):
    return _phrased(spark, d, closest_points_cone(spark, d)).select("step_nr", "point_id", "direction")


@query(
    f"""WITH {_OBJECTS}, {_LOCAL}, shown AS (SELECT *, (CASE WHEN class_label = 'unknown' THEN 'Object' ELSE class_label END) || ' #' || segment_id AS name FROM phrased WHERE point_idx = 0 AND distance > 0)
 SELECT step_nr, CASE WHEN distance > 0.6E0 THEN 'Distance: ' || printf('%.2f', round(distance, 2)) || 'm (' || direction || ') - ' || name
 ELSE (CASE WHEN distance <= 0.2E0 THEN '🚨 CRITICAL: ' WHEN distance <= 0.4E0 THEN '⚠️ WARNING: ' ELSE '⚠️ CAUTION: ' END) || name || ' ' || printf('%.2f', round(distance, 2)) || 'm ' || direction || CASE WHEN distance <= 0.2E0 THEN '!' ELSE '' END END AS message FROM shown""",
    "points poses segment_labels",
)
def warning_messages(spark, d):
    m = proximity.warning_message(F.col("distance"), F.col("level"), F.col("class_label"), F.col("segment_id"), F.col("direction"))
    return _phrased(spark, d, _warned(spark, d)).select("step_nr", m.alias("message"))


@query(
    f"""WITH {_OBJECTS}, w AS (SELECT step_nr, {_LEVEL} AS level FROM named WHERE point_idx = 0 AND distance > 0), s AS (SELECT *, lag(level) OVER (ORDER BY step_nr) AS previous FROM w)
 SELECT * FROM s WHERE previous IS NULL OR previous <> level""",
    "points poses segment_labels",
)
def warning_transitions(spark, d):
    last_two = over_recent(_warned(spark, d).select("step_nr", "level"), "step_nr", 1, "levels", F.collect_list("level"))
    s = last_two.select("step_nr", "level", F.when(F.size("levels") > 1, F.col("levels")[0]).alias("previous"))
    return s.where("previous IS NULL OR previous <> level")


# ---- points


@query("SELECT point_id FROM points WHERE abs(y) < 0.05E0", "points")
def floor_points(spark, d):
    return b.points(spark, d).where(pt.on_floor(FLOOR)).select("point_id")


@query("SELECT keyframe_id, count(*) FILTER (WHERE abs(y) > 0.05E0) AS above, count(*) FILTER (WHERE abs(y) < 0.05E0) AS floor, count(*) AS n FROM points GROUP BY keyframe_id", "points")
def floor_excluded_counts(spark, d):
    return b.points(spark, d).groupBy("keyframe_id").agg(F.count_if(pt.off_floor(FLOOR)).alias("above"), F.count_if(pt.on_floor(FLOOR)).alias("floor"), F.count("*").alias("n"))


@query("SELECT segment_id, count(*) AS n, min(point_id) AS first_point FROM points WHERE segment_id > 0 GROUP BY segment_id", "points")
def segmented_points(spark, d):
    return b.points(spark, d).where(pt.segmented()).groupBy("segment_id").agg(F.count("*").alias("n"), F.min("point_id").alias("first_point"))


@query("SELECT point_id, x, y, z, confidence FROM points WHERE confidence > 1.5E0", "points")
def confidence_filtered_cloud(spark, d):
    return b.points(spark, d).where(pt.confident()).select("point_id", "x", "y", "z", "confidence")


_KEYFRAMES = "keyframes AS (SELECT CAST(step_nr % 16 AS INT) AS keyframe_id, tx, ty, tz, qx, qy, qz, qw, 1.5E0 AS scale FROM poses QUALIFY row_number() OVER (PARTITION BY step_nr % 16 ORDER BY step_nr DESC) = 1)"


def _keyframes(spark, d):
    """Each keyframe's newest pose; poses move the sixteen keyframes in turn."""
    versions = b.poses(spark, d).drop("ts").withColumns({"keyframe_id": F.expr("CAST(step_nr % 16 AS INT)"), "scale": F.lit(1.5)}).withColumnRenamed("step_nr", "valid_from")
    return memory.poses_as_of(versions, None)


@query(
    f"""WITH {_KEYFRAMES} SELECT point_id, p.keyframe_id,
 round(1.5 * ((1 - 2 * (qy * qy + qz * qz)) * x + 2 * (qx * qy - qz * qw) * y + 2 * (qx * qz + qy * qw) * z) + tx, 9) AS x,
 round(1.5 * (2 * (qx * qy + qz * qw) * x + (1 - 2 * (qx * qx + qz * qz)) * y + 2 * (qy * qz - qx * qw) * z) + ty, 9) AS y,
 round(1.5 * (2 * (qx * qz - qy * qw) * x + 2 * (qy * qz + qx * qw) * y + (1 - 2 * (qx * qx + qy * qy)) * z) + tz, 9) AS z FROM points p JOIN keyframes k ON k.keyframe_id = p.keyframe_id""",
    "points poses",
)
def keyframe_world_cloud(spark, d):
    local = b.points(spark, d).selectExpr("point_id", "keyframe_id", "x AS lx", "y AS ly", "z AS lz", "confidence", "segment_id")
    return pt.world_points(local, _keyframes(spark, d)).select("point_id", "keyframe_id", *(F.round(c, 9).alias(c) for c in "xyz"))


@query(
    "SELECT segment_id, count(*) AS n_points, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM points WHERE segment_id > 0 GROUP BY segment_id",
    "points",
)
def segment_objects(spark, d):
    return pt.segment_objects(b.points(spark, d))


@query(
    "SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z, round(sqrt((max(x)-min(x))**2 + (max(y)-min(y))**2 + (max(z)-min(z))**2), 6) AS diagonal, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz FROM points",
    "points",
)
def cloud_bounds(spark, d):
    return stats.bounds(b.points(spark, d))


@query("SELECT point_id, CASE WHEN abs(y) < 0.05E0 THEN 0 ELSE 128 END AS r, CASE WHEN abs(y) < 0.05E0 THEN 255 ELSE 128 END AS g, CASE WHEN abs(y) < 0.05E0 THEN 0 ELSE 128 END AS b FROM points", "points")
def floor_highlight(spark, d):
    return pt.floor_colours(b.points(spark, d), FLOOR).select("point_id", "r", "g", "b")


# ---- floor


_SAMPLE = """smp AS (SELECT *, row_number() OVER (ORDER BY (point_id * 1103515245 + 12345) % 2147483648, point_id) - 1 AS o FROM points
 ORDER BY (point_id * 1103515245 + 12345) % 2147483648, point_id LIMIT (SELECT least(CAST(floor(count(*) * 0.15E0) AS BIGINT), 15000) FROM points)),
 n AS (SELECT count(*) AS n FROM smp),
 tri AS (SELECT i AS iter, ((i * 3) * 1103515245 + 12345) % 2147483648 % n AS o0, ((i * 3 + 1) * 1103515245 + 12345) % 2147483648 % n AS o1, ((i * 3 + 2) * 1103515245 + 12345) % 2147483648 % n AS o2 FROM range(1000) t(i), n),
 raw AS (SELECT iter, a.x AS ax, a.y AS ay, a.z AS az, (b.y-a.y)*(c.z-a.z)-(b.z-a.z)*(c.y-a.y) AS mx, (b.z-a.z)*(c.x-a.x)-(b.x-a.x)*(c.z-a.z) AS my, (b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x) AS mz
  FROM tri JOIN smp a ON a.o = o0 JOIN smp b ON b.o = o1 JOIN smp c ON c.o = o2),
 unit AS (SELECT iter, ax, ay, az, CASE WHEN my < 0 THEN -mx ELSE mx END / sqrt(mx*mx+my*my+mz*mz) AS nx, abs(my) / sqrt(mx*mx+my*my+mz*mz) AS ny, CASE WHEN my < 0 THEN -mz ELSE mz END / sqrt(mx*mx+my*my+mz*mz) AS nz FROM raw WHERE sqrt(mx*mx+my*my+mz*mz) >= 1e-6),
 planes AS (SELECT *, nx*ax+ny*ay+nz*az AS d FROM unit),
 inl AS (SELECT iter, count(*) FILTER (WHERE abs(nx*x+ny*y+nz*z-d) < 0.05E0) AS inliers FROM planes, smp GROUP BY iter),
 sup AS (SELECT iter, count(*) FILTER (WHERE nx*tx+ny*ty+nz*tz-d > 0.1) / count(*) AS support FROM planes, poses GROUP BY iter),
 scored AS (SELECT iter, nx, ny, nz, d, inliers, abs(ny) AS h, support, inliers * abs(ny) * 10 + abs(ny) * 1000 + support * 500 AS score FROM planes JOIN inl USING (iter) JOIN sup USING (iter))"""


def _scored(spark, d):
    planes, sample = floor.hypotheses(b.points(spark, d))
    return floor.score_planes(planes, sample, b.poses(spark, d))


@query(f"WITH {_SAMPLE} SELECT iter, inliers, round(h, 6) AS horizontality, round(support, 6) AS support, round(score, 4) AS score FROM scored", "points poses")
def ransac_plane_scores(spark, d):
    return _scored(spark, d).select("iter", "inliers", F.round("horizontality", 6).alias("horizontality"), F.round("support", 6).alias("support"), F.round("score", 4).alias("score"))


@query(
    f"""WITH {_SAMPLE}, valid AS (SELECT * FROM scored WHERE h > 0.7 AND inliers >= 250), stop AS (SELECT min(iter) AS stop FROM valid WHERE h > 0.95 AND support > 0.8 AND inliers > 1000)
 SELECT iter, round(nx, 6) AS nx, round(ny, 6) AS ny, round(nz, 6) AS nz, round(d, 6) AS d, inliers FROM valid, stop WHERE stop IS NULL OR iter <= stop ORDER BY round(score, 6) DESC, iter LIMIT 1""",
    "points poses",
)
def ransac_best_plane(spark, d):
    return floor.best_plane(_scored(spark, d)).select("iter", *(F.round(c, 6).alias(c) for c in ("nx", "ny", "nz", "d")), "inliers")


@query(
    """WITH downs AS (SELECT step_nr, -2 * (qx * qy - qz * qw) AS dx, -(1 - 2 * (qx * qx + qz * qz)) AS dy, -2 * (qy * qz + qx * qw) AS dz FROM poses),
 win AS (SELECT a.step_nr, b.dx, b.dy, b.dz, row_number() OVER (PARTITION BY a.step_nr ORDER BY b.step_nr) AS k FROM downs a JOIN downs b ON b.step_nr BETWEEN a.step_nr - 29 AND a.step_nr),
 m AS (SELECT step_nr, avg(dx) AS x, avg(dy) AS y, avg(dz) AS z FROM win WHERE k <= 10 GROUP BY step_nr)
 SELECT step_nr, round(x / sqrt(x*x+y*y+z*z), 6) + 0 AS gx, round(y / sqrt(x*x+y*y+z*z), 6) + 0 AS gy, round(z / sqrt(x*x+y*y+z*z), 6) + 0 AS gz FROM m""",
    "poses",
)
def gravity_estimate(spark, d):
    out = floor.gravity(b.poses(spark, d))
    return out.select("step_nr", *((F.col(c) + 0.0).alias(c) for c in ("gx", "gy", "gz")))


@query('SELECT p.step_nr, f.nx, f.ny, f.nz, f."offset" FROM poses p ASOF LEFT JOIN floors f ON p.step_nr >= f.step_nr', "poses floors")
def floor_asof(spark, d):
    return asof.asof_join(b.poses(spark, d).select("step_nr"), b.floor_observations(spark, d), "step_nr", values=["nx", "ny", "nz", "offset"])


@query(
    """WITH want AS (SELECT event_id, event_id % 60 AS step_nr, CAST(event_id % 12 AS INT) AS segment_id FROM events), newest AS (SELECT step_nr, segment_id, arg_max(class_label, ord) AS class_label FROM segment_labels GROUP BY 1, 2)
 SELECT w.event_id, w.step_nr, w.segment_id, l.class_label FROM want w ASOF LEFT JOIN newest l ON w.segment_id = l.segment_id AND w.step_nr >= l.step_nr""",
    "segment_labels",
)
def label_asof(spark, d):
    want = b.table(spark, d, "events").selectExpr("event_id", "event_id % 60 AS step_nr", "CAST(event_id % 12 AS INT) AS segment_id")
    return asof.asof_join(want, b.segment_labels(spark, d), "step_nr", ["segment_id"], ["class_label"], tie="ord")


# ---- fusion


@query("SELECT pixel, round(sum(c * x) / sum(c), 6) AS x, round(sum(c), 6) AS c_sum, count(*) AS n, round(sum(c) / count(*), 9) AS avg_confidence FROM (SELECT l_partkey AS pixel, 1 + l_tax AS c, l_quantity AS x FROM lineitem) GROUP BY pixel")
def fuse_weighted_pointmap(spark, d):
    return fusion.weighted(b.table(spark, d, "lineitem").selectExpr("l_partkey AS pixel", "1 + l_tax AS c", "l_quantity AS x"))


_SPHERE = "SELECT l_partkey AS pixel, 1 + l_tax AS c, l_quantity AS px, l_discount * 100 + 1 AS py, l_extendedprice / 1000.0E0 AS pz FROM lineitem"


@query(
    f"""WITH o AS ({_SPHERE}), s AS (SELECT pixel, c, sqrt(px*px+py*py+pz*pz) AS r, atan2(py, px) AS a, acos(pz / sqrt(px*px+py*py+pz*pz)) AS p FROM o),
 w AS (SELECT pixel, sum(c*r)/sum(c) AS r, sum(c*a)/sum(c) AS a, sum(c*p)/sum(c) AS p FROM s GROUP BY pixel)
 SELECT pixel, round(r*sin(p)*cos(a), 5) AS x, round(r*sin(p)*sin(a), 5) AS y, round(r*cos(p), 5) AS z FROM w"""
)
def fuse_weighted_spherical(spark, d):
    return fusion.weighted_spherical(b.table(spark, d, "lineitem").selectExpr("l_partkey AS pixel", "1 + l_tax AS c", "l_quantity AS px", "l_discount * 100 + 1 AS py", "l_extendedprice / 1000.0D AS pz"))


def _observed(spark, d):
    return b.table(spark, d, "events").selectExpr("user_id AS pixel", "event_id AS frame", "1.0D + (event_id % 9) * 0.25D AS c", "value AS x")


_OBSERVED = "obs AS (SELECT user_id AS pixel, event_id AS frame, 1.0E0 + (event_id % 9) * 0.25E0 AS c, value AS x FROM events)"


@query(f"WITH {_OBSERVED}, r AS (SELECT *, row_number() OVER (PARTITION BY pixel ORDER BY c DESC, frame) AS k FROM obs) SELECT pixel, x, c, frame FROM r WHERE k = 1")
def fuse_indep_conf(spark, d):
    return fusion.independent(_observed(spark, d))


@query(f"WITH {_OBSERVED} SELECT pixel, arg_max(x, frame) AS x FROM obs GROUP BY pixel")
def fuse_recent(spark, d):
    return fusion.recent(_observed(spark, d))


@query(f"WITH {_OBSERVED}, r AS (SELECT *, row_number() OVER (PARTITION BY pixel ORDER BY frame) AS k FROM obs) SELECT pixel, arg_max(x, k) AS x FROM r WHERE k <= 2 GROUP BY pixel")
def fuse_first(spark, d):
    return fusion.first(_observed(spark, d))


@query(
    f"""WITH {_OBSERVED}, gr AS (SELECT *, frame // 50 AS grp FROM obs), s AS (SELECT grp, round(quantile_disc(c, 0.5), 6) AS score FROM gr GROUP BY grp), best AS (SELECT grp FROM s ORDER BY score DESC, grp LIMIT 1)
 SELECT grp, pixel, frame, x, c FROM gr WHERE grp IN (SELECT grp FROM best)"""
)
def fuse_best_score(spark, d):
    return fusion.best_score(_observed(spark, d).withColumn("grp", F.expr("frame DIV 50")))


# ---- statistics of detections and labels


@query(
    """WITH fr AS (SELECT DISTINCT event_id // 5 AS step_nr FROM events), per AS (SELECT step_nr, count(*) AS n FROM detections GROUP BY 1),
 f AS (SELECT count(*) AS frames, count(n) AS frames_with, round(count(n) / count(*), 6) AS rate, CAST(sum(n) AS BIGINT) AS total, round(sum(n) / count(*), 6) AS avg_per_frame, max(n) AS max_per_frame FROM fr LEFT JOIN per USING (step_nr)),
 c AS (SELECT count(DISTINCT class_name) AS classes, round(avg(confidence), 6) AS conf_mean, min(confidence) AS conf_min, max(confidence) AS conf_max, round(stddev_pop(confidence), 6) AS conf_std FROM detections) SELECT * FROM f, c""",
    "detections",
)
def detection_stats(spark, d):
    frames = b.table(spark, d, "events").selectExpr("event_id DIV 5 AS step_nr").distinct()
    return stats.detection_stats(frames, b.detections(spark, d))


@query("SELECT class_name, count(*) AS n FROM detections GROUP BY 1", "detections")
def detection_class_counts(spark, d):
    return stats.class_counts(b.detections(spark, d), "class_name")


@query("WITH fr AS (SELECT DISTINCT event_id // 5 AS step_nr FROM events) SELECT fr.step_nr, class_name, round(confidence, 6) AS confidence, coalesce(detection_id, -1) AS detection_id FROM fr LEFT JOIN detections USING (step_nr)", "detections")
def detections_by_frame_outer(spark, d):
    out = stats.detections_by_frame(b.table(spark, d, "events").selectExpr("event_id DIV 5 AS step_nr").distinct(), b.detections(spark, d))
    return out.withColumn("detection_id", F.coalesce("detection_id", F.lit(-1)))


@query("WITH per AS (SELECT step_nr, count(DISTINCT segment_id) AS n FROM segment_labels GROUP BY 1) SELECT count(*) AS frames, round(avg(n), 6) AS avg_segments, max(n) AS max_segments, min(n) AS min_segments, CAST(sum(n) AS BIGINT) AS total_segments FROM per", "segment_labels")
def segmentation_stats(spark, d):
    return stats.segmentation_stats(b.segment_labels(spark, d))


@query("SELECT class_label, count(*) AS n FROM segment_labels GROUP BY 1", "segment_labels")
def class_distribution(spark, d):
    return stats.class_counts(b.segment_labels(spark, d), "class_label")


@query("SELECT count(*) AS poses, round(coalesce(epoch(max(ts)) - epoch(min(ts)), 0), 3) AS duration FROM poses", "poses")
def run_summary(spark, d):
    return stats.run_summary(b.poses(spark, d))


@query("SELECT step_nr, detection_id, x1, y1, x2 - x1 AS w, y2 - y1 AS h, x1 + (x2 - x1) / 2 AS cx, y1 + (y2 - y1) / 2 AS cy, (x2 - x1) / 2 AS hw, (y2 - y1) / 2 AS hh FROM detections", "detections")
def bbox_convert(spark, d):
    return scene.boxes(b.detections(spark, d))


@query(
    """SELECT step_nr, detection_id, unnest([2, 3]) AS label, unnest([x1 / 640 * 1024, x2 / 640 * 1024]) AS px, unnest([y1 / 480 * 1024, y2 / 480 * 1024]) AS py FROM detections""",
    "detections",
)
def bbox_prompts(spark, d):
    return scene.prompts(b.detections(spark, d), 640, 480)


@query(
    f"SELECT step_nr, detection_id, class_name || ' (' || printf('%.2f', round(confidence, 2)) || ')' AS label, CASE class_name {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in scene.CLASS_COLOURS.items())} ELSE '{scene.OTHER_COLOUR}' END AS colour FROM detections WHERE confidence >= 0.3",
    "detections",
)
def detection_labels(spark, d):
    return scene.detection_labels(b.detections(spark, d))


@query("WITH r AS (SELECT step_nr, detection_id, row_number() OVER (PARTITION BY step_nr ORDER BY confidence DESC, class_name, detection_id) AS rank FROM detections) SELECT step_nr, detection_id, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3", "detections")
def detection_topk(spark, d):
    return masks.strongest(b.detections(spark, d), 3).select("step_nr", "detection_id", "rank")


@query("WITH f AS (SELECT user_id, min(step_nr) AS first_step FROM detections GROUP BY 1) SELECT user_id, first_step, row_number() OVER (ORDER BY first_step, user_id) AS object_nr FROM f", "detections")
def object_dictionary(spark, d):
    return asof.object_numbers(b.detections(spark, d), "user_id")


# ---- masks: a part's pixels are 20 x 20 blocks placed by its key


_MASKS = "m AS (SELECT l_partkey % 40 AS mask_id, l_orderkey % 60 AS \"row\", l_suppkey % 50 AS col FROM lineitem GROUP BY ALL)"


def _masks(spark, d):
    return b.table(spark, d, "lineitem").selectExpr("l_partkey % 40 AS mask_id", "l_orderkey % 60 AS row", "l_suppkey % 50 AS col").distinct()


@query(f"WITH {_MASKS} SELECT mask_id, count(*) AS area FROM m GROUP BY 1 HAVING count(*) > 200")
def mask_area_filter(spark, d):
    return masks.by_area(_masks(spark, d))


_IOU = f"""WITH {_MASKS}, a AS (SELECT * FROM m WHERE mask_id < 20), o AS (SELECT * FROM m WHERE mask_id >= 20), s AS (SELECT a.mask_id AS new_id, o.mask_id AS old_id, count(*) AS s FROM a JOIN o USING ("row", col) GROUP BY 1, 2),
 n AS (SELECT mask_id, count(*) AS n FROM m GROUP BY 1) SELECT new_id, old_id, round(s / (x.n + y.n - s + 1e-6), 6) AS iou FROM s JOIN n x ON x.mask_id = new_id JOIN n y ON y.mask_id = old_id"""


@query(_IOU)
def mask_iou(spark, d):
    m = _masks(spark, d)
    return masks.iou(m.where("mask_id < 20"), m.where("mask_id >= 20"))


@query()
def mask_match(spark, d):
    return masks.match_masks(mask_iou(spark, d).withColumn("step_nr", F.col("new_id") % 4), accept=0.2)


@query(f'WITH {_MASKS} SELECT "row", col, max(mask_id) AS mask_id FROM m GROUP BY 1, 2')
def label_image_overwrite(spark, d):
    return masks.overwrite(_masks(spark, d))


@query(
    f"""WITH {_MASKS}, f AS (SELECT "row" AS r, col AS c, max(mask_id) AS segment_id FROM m GROUP BY 1, 2), t AS (SELECT i AS nr, j AS nc, CAST(floor((i + 0.5) * 60 / 90) AS BIGINT) AS r, CAST(floor((j + 0.5) * 50 / 100) AS BIGINT) AS c FROM range(90) a(i), range(100) q(j))
 SELECT nr - 5 AS "row", nc - 2 AS col, segment_id FROM t JOIN f USING (r, c) WHERE nr - 5 BETWEEN 0 AND 79 AND nc - 2 BETWEEN 0 AND 95"""
)
def mask_resize_crop(spark, d):
    image = masks.overwrite(_masks(spark, d)).withColumnRenamed("mask_id", "segment_id")
    return masks.resize_and_crop(image, (60, 50), (90, 100), (80, 96))


# ---- keyframe graph


_DOT = "list_sum(list_transform(list_zip(a.embedding, c.embedding), lambda t: CAST(t[1] AS DOUBLE) * CAST(t[2] AS DOUBLE)))"
_RETRIEVED = f"""sim AS (SELECT a.keyframe_id, c.keyframe_id AS match_id, round({_DOT}, 6) AS similarity FROM descriptors a JOIN descriptors c ON c.keyframe_id < a.keyframe_id),
 rk AS (SELECT *, row_number() OVER (PARTITION BY keyframe_id ORDER BY similarity DESC, match_id) AS r FROM sim WHERE similarity > 5e-3), got AS (SELECT * FROM rk WHERE r <= 3), before AS (SELECT keyframe_id, lag(keyframe_id) OVER (ORDER BY keyframe_id) AS previous FROM descriptors)"""


@query(f"WITH {_RETRIEVED} SELECT keyframe_id, match_id, similarity FROM got", "descriptors")
def keyframe_knn(spark, d):
    return graph.retrieve(b.descriptors(spark, d))


@query(f"WITH {_RETRIEVED} SELECT keyframe_id, match_id, similarity FROM got", "descriptors")
def keyframe_knn_tree(spark, d):
    """The same down a tree of balls, whose blocks are small here so that tiles have many of them."""
    return graph.retrieve(b.descriptors(spark, d), block=8, few=0)


@query(f"WITH {_RETRIEVED} SELECT keyframe_id AS src, match_id AS dst FROM got UNION SELECT keyframe_id, previous FROM before WHERE previous IS NOT NULL", "descriptors")
def keyframe_edges(spark, d):
    return graph.edges(b.descriptors(spark, d))


@query(f"WITH {_RETRIEVED} SELECT keyframe_id AS src, match_id AS dst FROM got JOIN before USING (keyframe_id) WHERE match_id <> previous", "descriptors")
def loop_closures(spark, d):
    return graph.loop_closures(b.descriptors(spark, d))


# ---- sampling


@query("WITH lo AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz FROM points) SELECT CAST(floor((x - lx) / 0.5E0) AS BIGINT) AS vx, CAST(floor((y - ly) / 0.5E0) AS BIGINT) AS vy, CAST(floor((z - lz) / 0.5E0) AS BIGINT) AS vz, round(avg(x), 11) AS x, round(avg(y), 11) AS y, round(avg(z), 11) AS z, count(*) AS n FROM points, lo GROUP BY 1, 2, 3", "points")
def voxel_downsample(spark, d):
    return sampling.voxels(b.points(spark, d), 0.5)


_LCG = "(point_id * 1103515245 + 12345) % 2147483648"


@query(
    f"""WITH e AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz, greatest(2, CAST(floor(power(count(*) // 15, 1.0E0 / 3.0E0)) AS BIGINT)) AS per, CAST(floor(count(*) * 0.5E0) AS BIGINT) AS target FROM points),
 c AS (SELECT point_id, (least(greatest(CAST(floor((x-lx)/((hx-lx)/per)) AS BIGINT), 0), per-1) * per + least(greatest(CAST(floor((y-ly)/((hy-ly)/per)) AS BIGINT), 0), per-1)) * per + least(greatest(CAST(floor((z-lz)/((hz-lz)/per)) AS BIGINT), 0), per-1) AS cell FROM points, e),
 k AS (SELECT *, count(*) OVER (PARTITION BY cell) AS m, row_number() OVER (PARTITION BY cell ORDER BY {_LCG}, point_id) AS k FROM c),
 o AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN k <= greatest(1, floor(m * 0.5E0)) THEN 0 ELSE 1 END, {_LCG}, point_id) AS n FROM k) SELECT point_id, cell FROM o, e WHERE n <= target""",
    "points",
)
def stratified_sample(spark, d):
    return sampling.stratified_sample(b.points(spark, d), 0.5).select("point_id", "cell")


@query(f"SELECT point_id FROM points ORDER BY {_LCG}, point_id LIMIT (SELECT least(CAST(floor(count(*) * 0.25E0) AS BIGINT), 15000) FROM points)", "points")
def exact_sample(spark, d):
    return sampling.exact_sample(b.points(spark, d), 0.25).select("point_id")


@query(
    f"""WITH k AS (SELECT point_id, keyframe_id, count(*) OVER (PARTITION BY keyframe_id) AS m, row_number() OVER (PARTITION BY keyframe_id ORDER BY {_LCG}, point_id) AS k FROM points)
 SELECT point_id, keyframe_id FROM k WHERE keyframe_id = (SELECT max(keyframe_id) FROM points) OR k <= greatest(1, floor(m * 0.5E0))""",
    "points",
)
def percentage_subsample(spark, d):
    return sampling.percentage_subsample(b.points(spark, d), 0.5, "keyframe_id").select("point_id", "keyframe_id")


# ---- alignment and gates


_SNAPSHOTS = "snaps AS (SELECT step_nr AS snapshot_step FROM poses WHERE (step_nr + 1) % 10 = 0)"


@query(
    f"""WITH {_SNAPSHOTS}, e AS (SELECT min(snapshot_step) AS lo, max(snapshot_step) AS hi FROM snaps), o AS (SELECT step_nr, row_number() OVER (ORDER BY step_nr) - 1 AS i, count(*) OVER () AS n FROM poses),
 t AS (SELECT step_nr, CAST(floor(lo + i / CAST(greatest(n - 1, 1) AS DOUBLE) * (hi - lo)) AS BIGINT) AS tgt FROM o, e),
 r AS (SELECT step_nr, snapshot_step, row_number() OVER (PARTITION BY step_nr ORDER BY abs(snapshot_step - tgt), snapshot_step) AS k FROM t, snaps) SELECT p.step_nr, r.snapshot_step FROM poses p LEFT JOIN r ON r.step_nr = p.step_nr AND r.k = 1""",
    "poses",
)
def nearest_snapshot_step(spark, d):
    p = b.poses(spark, d)
    return align.nearest_snapshot(p, p.where("(step_nr + 1) % 10 = 0").select(F.col("step_nr").alias("snapshot_step")))


@query("WITH o AS (SELECT step_nr, row_number() OVER (ORDER BY step_nr) - 1 AS i, count(*) OVER () AS n FROM poses) SELECT step_nr, CAST(floor(i / CAST(greatest(n - 1, 1) AS DOUBLE) * 299.0E0) AS BIGINT) AS frame_idx FROM o", "poses")
def trajectory_video_map(spark, d):
    return align.video_frames(b.poses(spark, d), 300)


@query("SELECT step_nr, tx, ty, tz FROM poses WHERE (step_nr + 1) % 10 = 0", "poses")
def snapshot_gate(spark, d):
    return files.snapshot_rows(b.poses(spark, d)).select("step_nr", "tx", "ty", "tz")


@query("SELECT step_nr, CASE WHEN step_nr % 3 = 0 THEN count(*) ELSE 0 END AS n FROM detections GROUP BY step_nr", "detections")
def detection_gate(spark, d):
    return b.detections(spark, d).groupBy("step_nr").agg(F.count_if(F.pmod("step_nr", F.lit(3)) == 0).alias("n"))


@query("WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) SELECT user_id, event_id, CAST(k AS INT) AS k FROM r WHERE k <= 7")
def memory_bank_last7(spark, d):
    f = b.table(spark, d, "events").selectExpr("user_id", "event_id", "event_id AS frame_idx", "false AS conditioning")
    return memory.bank(f, key="user_id").select("user_id", "event_id", "k")


_FRAMES = "fr AS (SELECT user_id AS object_id, event_id AS frame_idx, event_type = 'purchase' AS conditioning, value AS score FROM events)"


def _frames(spark, d):
    return b.table(spark, d, "events").selectExpr("user_id AS object_id", "event_id AS frame_idx", "event_type = 'purchase' AS conditioning", "value AS score")


@query(f"WITH {_FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY frame_idx DESC) AS k FROM fr WHERE NOT conditioning) SELECT object_id, frame_idx, CAST(k AS INT) AS k FROM r WHERE k <= 7")
def memory_bank_unconditioned(spark, d):
    return memory.bank(_frames(spark, d)).select("object_id", "frame_idx", "k")


@query(f"WITH {_FRAMES} SELECT object_id, frame_idx FROM fr f WHERE NOT EXISTS (SELECT 1 FROM fr c WHERE c.conditioning AND c.object_id = f.object_id AND abs(c.frame_idx - f.frame_idx) <= 140)")
def memory_cleared(spark, d):
    f = _frames(spark, d)
    return memory.cleared(f, f.where("conditioning"), 140).select("object_id", "frame_idx")


@query(f"WITH {_FRAMES}, o AS (SELECT f.frame_idx // 100 AS frame_idx, f.object_id, max(score) AS score FROM fr f GROUP BY 1, 2), ids AS (SELECT DISTINCT a.frame_idx, g.object_id FROM o a JOIN o g ON a.frame_idx // 10 = g.frame_idx // 10) SELECT ids.frame_idx, ids.object_id, coalesce(score, -1024) AS score FROM ids LEFT JOIN o USING (frame_idx, object_id)")
def outputs_consolidated(spark, d):
    """All objects; each frame is filled in for the objects of its ten frames."""
    out = _frames(spark, d).groupBy(F.expr("frame_idx DIV 100").alias("frame_idx"), "object_id").agg(F.max("score").alias("score"))
    ten = F.expr("frame_idx DIV 10").alias("ten")
    wanted = out.select("frame_idx", ten).distinct().join(out.select(ten, "object_id").distinct(), "ten").drop("ten")
    return memory.consolidated(wanted, out)


@query(
    f"""WITH {_FRAMES}, a AS (SELECT object_id, frame_idx // 2 AS frame_idx, conditioning, score, 1 AS rk FROM fr WHERE frame_idx % 2 = 0), z AS (SELECT object_id, frame_idx // 2, conditioning, score, 0 FROM fr WHERE frame_idx % 2 = 1),
 u AS (SELECT *, row_number() OVER (PARTITION BY object_id, frame_idx ORDER BY conditioning DESC, rk DESC) AS k FROM (SELECT * FROM a UNION ALL SELECT * FROM z)) SELECT object_id, frame_idx, conditioning, score FROM u WHERE k = 1"""
)
def outputs_merged(spark, d):
    """All events: the even frames with the odd ones behind them."""
    f = _frames(spark, d)
    half = lambda r: f.where(f"frame_idx % 2 = {r}").withColumn("frame_idx", F.expr("frame_idx DIV 2"))
    return memory.merged(half(0), half(1))


@query("WITH v AS (SELECT CAST(step_nr % 16 AS INT) AS keyframe_id, step_nr AS valid_from, tx, ty, tz FROM poses WHERE step_nr <= (SELECT max(step_nr) // 2 FROM poses)), r AS (SELECT *, row_number() OVER (PARTITION BY keyframe_id ORDER BY valid_from DESC) AS k FROM v) SELECT keyframe_id, tx, ty, tz FROM r WHERE k = 1", "poses")
def keyframe_poses_asof(spark, d):
    """As of the middle of the run."""
    p = b.poses(spark, d)
    half = p.agg(F.expr("max(step_nr) DIV 2")).first()[0]
    return memory.poses_as_of(p.selectExpr("CAST(step_nr % 16 AS INT) AS keyframe_id", "step_nr AS valid_from", "tx", "ty", "tz"), half)


# ---- scene


@query(
    """WITH rays AS (SELECT step_nr, 'ray' AS kind, i AS idx, tx AS ax, ty AS ay, tz AS az, i * (2 * pi() / 8) AS t1, NULL AS t0 FROM poses, range(8) r(i)),
 ring AS (SELECT step_nr, 'ring' AS kind, i AS idx, (i + 1) * (2 * pi() / 16) AS t1, i * (2 * pi() / 16) AS t0 FROM poses, range(16) r(i)),
 al AS (SELECT step_nr, kind, idx, t0, t1 FROM rays UNION ALL SELECT step_nr, kind, idx, t0, t1 FROM ring),
 l AS (SELECT al.*, p.*, 1.5E0 * tan(radians(45)) * cos(t1) AS ux, 1.5E0 * tan(radians(45)) * sin(t1) AS uy, 1.5E0 * tan(radians(45)) * cos(t0) AS wx, 1.5E0 * tan(radians(45)) * sin(t0) AS wy, 1.5E0 AS uz FROM al JOIN poses p USING (step_nr))
 SELECT step_nr, kind, CAST(idx AS INT) AS idx,
 round(CASE kind WHEN 'ray' THEN tx ELSE tx + (1-2*(qy*qy+qz*qz))*wx + 2*(qx*qy-qz*qw)*wy + 2*(qx*qz+qy*qw)*uz END, 5) + 0.0E0 AS ax,
 round(CASE kind WHEN 'ray' THEN ty ELSE ty + 2*(qx*qy+qz*qw)*wx + (1-2*(qx*qx+qz*qz))*wy + 2*(qy*qz-qx*qw)*uz END, 5) + 0.0E0 AS ay,
 round(CASE kind WHEN 'ray' THEN tz ELSE tz + 2*(qx*qz-qy*qw)*wx + 2*(qy*qz+qx*qw)*wy + (1-2*(qx*qx+qy*qy))*uz END, 5) + 0.0E0 AS az,
 round(tx + (1-2*(qy*qy+qz*qz))*ux + 2*(qx*qy-qz*qw)*uy + 2*(qx*qz+qy*qw)*uz, 5) + 0.0E0 AS bx, round(ty + 2*(qx*qy+qz*qw)*ux + (1-2*(qx*qx+qz*qz))*uy + 2*(qy*qz-qx*qw)*uz, 5) + 0.0E0 AS by,
 round(tz + 2*(qx*qz-qy*qw)*ux + 2*(qy*qz+qx*qw)*uy + (1-2*(qx*qx+qy*qy))*uz, 5) + 0.0E0 AS bz FROM l""",
    "poses",
)
def view_cone_lines(spark, d):
    out = scene.view_cones(b.poses(spark, d).withColumn("distance", F.lit(None).cast("double")))
    return out.withColumns({c: F.col(c) + 0.0 for c in ("ax", "ay", "az", "bx", "by", "bz")})


@query(
    """WITH c AS (SELECT avg(x) AS cx, avg(z) AS cz FROM points), l AS (SELECT a AS axis, CAST(i AS INT) - 5 AS idx, cx, cz FROM c, (SELECT unnest(['u', 'v']) AS a), range(11) r(i))
 SELECT axis, idx, round(CASE axis WHEN 'u' THEN cx - idx ELSE cx + 5 END, 5) AS ax, 0.0E0 AS ay, round(CASE axis WHEN 'u' THEN cz + 5 ELSE cz - idx END, 5) AS az,
 round(CASE axis WHEN 'u' THEN cx - idx ELSE cx - 5 END, 5) AS bx, 0.0E0 AS by, round(CASE axis WHEN 'u' THEN cz - 5 ELSE cz - idx END, 5) AS bz FROM l""",
    "points",
)
def floor_grid_lines(spark, d):
    centre = b.points(spark, d).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"))
    out = scene.floor_grid(centre, FLOOR)
    return out.withColumns({"ay": F.abs("ay"), "by": F.abs("by")})


@query("WITH l AS (SELECT step_nr, tx, ty, tz, lead(tx) OVER w AS bx, lead(ty) OVER w AS \"by\", lead(tz) OVER w AS bz FROM poses WINDOW w AS (ORDER BY step_nr)) SELECT *, round(sqrt((bx-tx)**2 + (\"by\"-ty)**2 + (bz-tz)**2), 6) AS length FROM l WHERE bx IS NOT NULL", "poses")
def trajectory_segments(spark, d):
    return scene.trajectory_segments(b.poses(spark, d))


@query(f"WITH s AS (SELECT segment_id, row_number() OVER (ORDER BY segment_id) - 1 AS k FROM (SELECT DISTINCT segment_id FROM points)) SELECT segment_id, [{', '.join(repr(c) for c in scene.PALETTE)}][k % 12 + 1] AS colour FROM s WHERE segment_id <> 0", "points")
def segment_palette(spark, d):
    return scene.segment_palette(b.points(spark, d))


@query(
    """WITH p AS (SELECT p_partkey AS video_id, CASE WHEN p_size % 3 = 0 THEN 'matroska' ELSE 'mov,mp4' END AS container, CASE WHEN p_size % 5 = 0 THEN 'yuv420p10le' ELSE 'yuv420p' END AS pix_fmt,
 CASE WHEN p_size % 7 = 0 THEN 'High 10' ELSE 'High' END AS profile, CASE WHEN p_size % 11 = 0 THEN 'bt2020nc' ELSE 'bt709' END AS cs, CASE WHEN p_size % 13 = 0 THEN 'av1' ELSE 'h264' END AS codec, p_size % 17 = 0 AS dv FROM part),
 r AS (SELECT video_id, list_filter([CASE WHEN container NOT LIKE '%mp4%' THEN 'container' END, CASE WHEN pix_fmt LIKE '%10le%' THEN '10-bit' END, CASE WHEN profile LIKE '%High 10%' THEN 'profile' END,
 CASE WHEN cs = 'bt2020nc' THEN 'colour space' END, CASE WHEN dv THEN 'dolby vision' END, CASE WHEN codec = 'av1' THEN 'av1' END], lambda x: x IS NOT NULL) AS l FROM p) SELECT video_id, coalesce(array_to_string(l, ','), '') AS reasons, len(l) > 0 AS convert FROM r"""
)
def video_compat_reasons(spark, d):
    p = b.table(spark, d, "part").selectExpr(
        "p_partkey AS video_id", "CASE WHEN p_size % 3 = 0 THEN 'matroska' ELSE 'mov,mp4' END AS container", "CASE WHEN p_size % 5 = 0 THEN 'yuv420p10le' ELSE 'yuv420p' END AS pix_fmt",
        "CASE WHEN p_size % 7 = 0 THEN 'High 10' ELSE 'High' END AS profile", "CASE WHEN p_size % 11 = 0 THEN 'bt2020nc' ELSE 'bt709' END AS color_space", "CASE WHEN p_size % 13 = 0 THEN 'av1' ELSE 'h264' END AS codec",
        "CASE WHEN p_size % 17 = 0 THEN array('DOVI configuration record') ELSE array('x') END AS side_data",
    )
    return video.compatibility(p)


@query("SELECT printf('%.6f %.6f %.6f %.6f %.6f %.6f %.6f %.6f', CAST(step_nr AS DOUBLE), tx, ty, tz, qx, qy, qz, qw) AS line FROM poses", "poses")
def trajectory_txt(spark, d):
    return b.poses(spark, d).select(F.format_string("%.6f %.6f %.6f %.6f %.6f %.6f %.6f %.6f", F.col("step_nr").cast("double"), "tx", "ty", "tz", "qx", "qy", "qz", "qw").alias("line"))


# ---- event time and grouping beyond the trajectory operators


def _zoned_events(spark, d):
    """Watermarks need times with a zone; it is taken off again from what comes out."""
    return b.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _unzoned(df: DataFrame) -> DataFrame:
    return df.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, d):
    return _unzoned(stateful.windowed_counts(_zoned_events(spark, d), total="value")).withColumn("total", F.round("total", 4))


@query("SELECT time_bucket(INTERVAL '30 minutes', ts) - k * INTERVAL '30 minutes' AS start, count(*) AS n FROM events, range(2) r(k) GROUP BY 1")
def events_sliding(spark, d):
    return _unzoned(stateful.windowed_counts(_zoned_events(spark, d), slide="30 minutes", by=()))


@query(
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '2 hours' OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def events_session(spark, d):
    return _unzoned(stateful.sessions(_zoned_events(spark, d)))


@query("SELECT class_name, coalesce(detection_id, -1) AS detection_id, count(*) AS n, round(avg(confidence), 6) AS mean FROM detections GROUP BY CUBE (class_name, detections.detection_id)", "detections")
def cube_rollup_classes(spark, d):
    return b.detections(spark, d).cube("class_name", "detection_id").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean")).withColumn("detection_id", F.coalesce("detection_id", F.lit(-1)))


from . import catalog_outputs, catalog_runs  # noqa: E402, F401  (register their queries)
