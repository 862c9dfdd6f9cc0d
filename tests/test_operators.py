import itertools
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailstone.functions import geometry as g
from trailstone.functions import proximity
from trailstone.operators import align, asof, floor, fusion, knn, masks, memory, sampling, stats, video
from trailstone.operators import scene as scene_tables
from trailstone.plans import pipeline

POINTS = [(0, 0.0, 0.0, 1.0, 0), (1, 0.0, 0.05, 1.0, 1), (2, 0.0, 1.5, 2.0, 1), (3, 1.0, 1.5, 2.0, 2), (4, 0.0, 1.5, -1.0, 2), (5, 0.0, 0.5, 0.5, 1), (6, 0.3, 1.5, 0.0, 0), (7, 0.0, 1.5, 0.0, 3)]
POSE = [(0, 0.0, 1.5, 0.0, 0.0, 0.0, 0.0, 1.0)]
FLOOR = (0.0, 1.0, 0.0, 0.0)


@pytest.fixture(scope="module")
def scene(spark):
    points = spark.createDataFrame(POINTS, "point_id long, x double, y double, z double, segment_id int")
    poses = spark.createDataFrame(POSE, "step_nr long, tx double, ty double, tz double, qx double, qy double, qz double, qw double")
    return points, poses


@pytest.mark.parametrize(
    "plane, cone, segments, expected",
    [
        (FLOOR, 45.0, False, [(2, 2.0), (3, 2.236068)]),
        (FLOOR, 45.0, True, [(2, 2.0), (3, 2.236068)]),
        (FLOOR, None, True, [(7, 0.0), (5, 0.5), (4, 1.0), (2, 2.0), (3, 2.236068)]),
        (FLOOR, None, False, [(7, 0.0), (6, 0.3), (5, 0.5), (4, 1.0), (2, 2.0), (3, 2.236068)]),
        (None, None, False, [(7, 0.0), (6, 0.3), (4, 1.0), (5, 1.118034), (1, 1.761391), (0, 1.802776), (2, 2.0), (3, 2.236068)]),
        (None, 45.0, False, [(2, 2.0), (3, 2.236068)]),
    ],
)
def test_nearest_points_by_hand(scene, plane, cone, segments, expected):
    got = knn.nearest_points(*scene, floor=plane, half_angle=cone, only_segmented=segments).orderBy("point_idx").collect()
    assert [(r.point_id, r.distance) for r in got] == expected
    one = knn.nearest_points(*scene, k=1, floor=plane, half_angle=cone, only_segmented=segments).collect()
    assert [(r.point_id, r.distance) for r in one] == expected[:1]


def test_nearest_points_of_nothing(scene):
    points, poses = scene
    assert knn.nearest_points(points.limit(0), poses).count() == 0
    assert knn.nearest_points(points, poses.limit(0)).count() == 0


def test_nearest_points_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    pts = pd.DataFrame({"point_id": range(800), **{c: rng.normal(size=800) * s for c, s in zip("xyz", (8, 1, 3), strict=True)}, "segment_id": rng.integers(0, 4, 800)})
    q = rng.normal(size=(25, 4))
    poses = pd.DataFrame({"step_nr": range(25), **{f"t{c}": rng.normal(size=25) * 6 for c in "xyz"}, **dict(zip(("qx", "qy", "qz", "qw"), q.T, strict=True))})
    got = knn.nearest_points(spark.createDataFrame(pts), spark.createDataFrame(poses), k=7, half_angle=60.0).toPandas()
    for i, p in poses.iterrows():
        x, y, z, w = (q[i] / np.linalg.norm(q[i])).tolist()
        f = np.array([2 * (x * z + y * w), 2 * (y * z - x * w), 1 - 2 * (x * x + y * y)])
        d = pts[["x", "y", "z"]].to_numpy() - p[["tx", "ty", "tz"]].to_numpy(float)
        n = np.linalg.norm(d, axis=1)
        ok = (pts["segment_id"] > 0) & (n > 1e-6) & (d @ f >= n * math.cos(math.radians(60)))
        want = sorted((round(a, 6), b) for a, b in zip(n[ok], pts["point_id"][ok], strict=True))[:7]
        mine = got[got["step_nr"] == i].sort_values("point_idx")
        assert list(zip(mine["distance"], mine["point_id"], strict=True)) == want


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def values(spark, columns):
    return list(spark.range(1).select(*(c.alias(f"v{i}") for i, c in enumerate(columns))).first())


def test_rotation_by_hand(spark):
    for q in ((0, 0.6, 0, 0.8), (0, 1.2, 0, 1.6)):
        q = tuple(F.lit(float(v)) for v in q)
        flat = values(spark, [c for row in g.rotation(q) for c in row])
        assert flat == pytest.approx([0.28, 0, 0.96, 0, 1, 0, -0.96, 0, 0.28])
        assert values(spark, g.forward(q)) == pytest.approx([0.96, 0, 0.28])
        assert values(spark, g.down(q)) == pytest.approx([0, -1, 0])
    assert values(spark, g.spherical(g.const(1, 2, 3))) == pytest.approx([3.741657, 1.107149, 0.640522], abs=1e-6)


@settings(max_examples=8, deadline=None)
@given(st.tuples(*[st.floats(-1, 1)] * 4).filter(lambda q: sum(x * x for x in q) > 0.01), st.tuples(*[st.floats(-5, 5)] * 6), st.floats(0.1, 3))
def test_similarity_inverts_and_keeps_angles(spark, q, v, s):
    q, t, p = tuple(map(F.lit, q)), tuple(map(F.lit, v[:3])), tuple(map(F.lit, v[3:]))
    back = g.sim3_invert(q, t, F.lit(s), g.sim3_apply(q, t, F.lit(s), p))
    m = g.rotation(q)
    out = values(spark, [*back, *g.matrix_to_quaternion(m), *(g.dot(a, b) for a, b in itertools.combinations_with_replacement(m, 2))])
    assert out[:3] == pytest.approx(v[3:], abs=1e-6)
    assert out[7:] == pytest.approx([1, 0, 0, 1, 0, 1], abs=1e-9)
    again = values(spark, [c for row in g.rotation(tuple(F.lit(x) for x in out[3:7])) for c in row])
    assert again == pytest.approx(values(spark, [c for row in m for c in row]), abs=1e-6)


@pytest.mark.parametrize(
    "offset, phrase",
    [((0, 0, 0.05), "directly in front"), ((0, 0, 1), "to your ahead"), ((0, 0, -1), "to your behind"), ((1, 0, 2), "ahead-right"), ((0, -1, 0.5), "ahead-above"), ((0.5, 0.5, 0), "right-below"), ((1, 1, 1), "ahead-right-below"), ((-1, 0, -1), "behind-left"), ((0.1, 0.1, 0.1), "directly in front")],
)
def test_direction_phrases(spark, offset, phrase):
    assert value(spark, proximity.direction_phrase(g.const(*offset))) == phrase


def test_levels_and_messages(spark):
    levels = [value(spark, proximity.warning_level(F.lit(d))) for d in (0.2, 0.21, 0.4, 0.41, 0.6, 0.61)]
    assert levels == ["critical", "strong", "strong", "caution", "caution", "normal"]

    def message(d, label, direction, **how):
        d = F.lit(d)
        return value(spark, proximity.warning_message(d, proximity.warning_level(d), F.lit(label), F.lit(5), F.lit(direction).cast("string"), **how))

    assert message(0.15, "Chair", "ahead-right") == "🚨 CRITICAL: Chair #5 0.15m ahead-right!"
    assert message(0.3, "Chair", None) == "⚠️ WARNING: Chair #5 at 0.30m"
    assert message(0.8, "Chair", "ahead-right") == "Distance: 0.80m (ahead-right) - Chair #5"
    assert message(0.5, "unknown", "ahead-right") == "⚠️ CAUTION: Object #5 0.50m ahead-right"
    assert message(0.5, None, None, objects=False) == "⚠️ CAUTION: Point at 0.50m"
    assert message(0.15, "Chair", None, enabled=False) == "Distance: 0.150m (Chair #5)"
    assert message(0.15, "unknown", None, enabled=False) == "Distance: 0.150m (Segment 5)"
    assert message(0.1, "Chair", None) == "🚨 CRITICAL: Chair #5 at 0.10m!"
    assert value(spark, proximity.duration_text(F.lit(3725.5))) == "1h 2m 5.50s" and value(spark, proximity.duration_text(F.lit(4.25))) == "4.25s"


def test_statistics_by_hand(spark):
    s = stats.distance_stats(spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "distance double")).first()
    assert (s.mean, s.min, s.max) == (2, 1, 3) and s["std"] == pytest.approx(0.8165, abs=1e-4)
    assert stats.distance_stats(spark.createDataFrame([], "distance double")).first()["mean"] is None
    frames = spark.createDataFrame([(0,), (1,), (2,)], "step_nr long")
    found = spark.createDataFrame([(0, "Chair", 0.5), (0, "Chair", 0.7), (2, "Table", 0.9), (2, "Chair", 0.4)], "step_nr long, class_name string, confidence double")
    r = stats.detection_stats(frames, found).first()
    assert (r.frames, r.frames_with, r.rate, r.total, r.avg_per_frame, r.max_per_frame, r.classes) == (3, 2, 0.666667, 4, 1.333333, 2, 2)
    assert (r.conf_mean, r.conf_min, r.conf_max, r.conf_std) == (0.625, 0.4, 0.9, 0.192029)


def test_alignment_by_hand(spark):
    poses = lambda n: spark.range(n).withColumnRenamed("id", "step_nr")
    snaps = spark.createDataFrame([(9,), (19,), (29,)], "snapshot_step long")
    assert [r.snapshot_step for r in align.nearest_snapshot(poses(5), snaps).orderBy("step_nr").collect()] == [9, 9, 19, 19, 29]
    assert [r.snapshot_step for r in align.nearest_snapshot(poses(3), snaps).orderBy("step_nr").collect()] == [9, 19, 29]
    assert [r.frame_idx for r in align.video_frames(poses(4), 10).orderBy("step_nr").collect()] == [0, 3, 6, 9]
    assert [r.frame_idx for r in align.video_frames(poses(1), 10).collect()] == [0]
    a = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k long, v string")
    assert {(r.v, r.i) for r in align.with_ordinal(a, "k").collect()} == {("a", 0), ("b", 1), ("c", 2)}
    zipped = align.zip_by_position(a, snaps.limit(2), "k", "snapshot_step")
    assert zipped.count() == 2


def test_fusion_by_hand(spark):
    obs = spark.createDataFrame([(0, 1, 1.0, 1.0), (0, 2, 4.0, 2.0), (0, 3, 10.0, 1.0)], "pixel long, frame long, x double, c double")
    w = fusion.weighted(obs).first()
    assert (w.x, w.c_sum, w.n, round(w.avg_confidence, 6)) == (4.75, 4.0, 3, 1.333333)
    assert (fusion.recent(obs).first().x, fusion.independent(obs).first().x, fusion.first(obs).first().x) == (10.0, 4.0, 4.0)


def test_asof_ties_gaps_and_nulls(spark):
    left = spark.createDataFrame([(1, 5), (1, 0), (2, 5), (1, None)], "g long, t long")
    right = spark.createDataFrame([(1, 1, "a", 1), (1, 5, "b", 1), (1, 5, "c", 2), (2, 6, "z", 1), (1, None, "n", 1)], "g long, t long, v string, o long")
    got = {(r.g, r.t): r.v for r in asof.asof_join(left, right, "t", ["g"], ["v"], tie="o").collect()}
    assert got == {(1, 5): "c", (1, 0): None, (2, 5): None, (1, None): None}


def test_floor_schedule_and_score(spark):
    assert floor.schedule(30, 3, 10) == [(3, "detect"), (10, "refine"), (20, "refine"), (30, "refine")]
    plane = spark.createDataFrame([(0, 0.0, 1.0, 0.0, 0.0)], "iter long, nx double, ny double, nz double, d double")
    sample = spark.createDataFrame([(0.0, y, 0.0) for y in (0.0, 0.01, 0.049, 0.05)], "x double, y double, z double")
    cameras = spark.createDataFrame([(0.0, 1.5, 0.0), (0.0, 0.05, 0.0)], "tx double, ty double, tz double")
    s = floor.score_planes(plane, sample, cameras).first()
    assert (s.inliers, s.horizontality, s.support, s.score) == (3, 1.0, 0.5, 1280.0)
    assert floor.best_plane(floor.score_planes(plane, sample, cameras), min_inliers=100).count() == 0


def test_floor_sample_follows_the_ratio_up_to_its_bound(spark):
    points = spark.range(20_000).selectExpr("id AS point_id", "(id * 7919 % 1000) * 0.01D AS x", "(id % 3) * 0.02D AS y", "(id * 104729 % 997) * 0.01D AS z")
    planes, sample = floor.hypotheses(points)
    assert sample.count() == 3000 and 900 < planes.count() <= 1000
    assert floor.hypotheses(points, 1, ratio=1.0)[1].count() == 15_000
    cameras = spark.createDataFrame([(0.0, 1.5, 0.0)], "tx double, ty double, tz double")
    scored = floor.score_planes(planes, sample, cameras).toPandas().set_index("iter")
    p = sample.toPandas()
    for r in planes.limit(50).collect():
        assert scored.loc[r.iter, "inliers"] == (abs(p.x * r.nx + p.y * r.ny + p.z * r.nz - r.d) < 0.05).sum()


def test_sampling_sizes(spark):
    points = spark.range(1000).selectExpr("id AS point_id", "id % 10 AS x", "id % 7 AS y", "id * 0.01D AS z", "id % 3 AS step_nr")
    assert sampling.exact_sample(points, 0.333).count() == 333
    assert sampling.stratified_sample(points, 0.5).count() == 500
    assert sampling.stratified_sample(points.limit(0), 0.5).count() == 0
    kept = {r.step_nr: r["count"] for r in sampling.percentage_subsample(points, 0.5, "step_nr").groupBy("step_nr").count().collect()}
    assert kept == {0: 167, 1: 166, 2: 333}
    size = sampling.voxel_size_for(points, 100, 1.0)
    assert 1e-3 <= size <= 10


def test_masks_by_hand(spark):
    px = lambda rows: spark.createDataFrame(rows, "mask_id long, row long, col long")
    assert masks.iou(px([(1, 0, 0), (1, 0, 1)]), px([(2, 0, 1), (2, 1, 1)])).first().iou == 0.333333
    over = {(r.row, r.col): r.mask_id for r in masks.overwrite(px([(1, 0, 0), (2, 0, 0), (1, 0, 1)])).collect()}
    assert over == {(0, 0): 2, (0, 1): 1}
    sizes = px([(1, i, 0) for i in range(200)] + [(2, i, 0) for i in range(201)])
    assert [r.mask_id for r in masks.by_area(sizes, 200).collect()] == [2]


def test_assignment_is_optimal():
    rng = np.random.default_rng(5)
    for n, m in itertools.product(range(1, 5), range(1, 6)):
        cost = rng.random((n, m))
        rows = range(n)
        best = min((sum(cost[i, j] for i, j in zip(rows, p, strict=False)) for p in itertools.permutations(range(m), n)), default=None) if n <= m else min(sum(cost[i, j] for j, i in enumerate(p)) for p in itertools.permutations(rows, m))
        assert sum(cost[i, j] for i, j in masks._assign(cost)) == pytest.approx(best)


def test_cleared_frames_near_conditioning_ones(spark):
    rng = np.random.default_rng(2)
    rows = [(int(o), int(f), bool(c)) for o, f, c in zip(rng.integers(0, 4, 400), rng.integers(-900, 900, 400), rng.random(400) < 0.1, strict=True)] + [(None, 5, True), (1, None, True), (9, 3, False), (None, 6, False)]
    frames = spark.createDataFrame(rows, "object_id long, frame_idx long, conditioning boolean")
    for reach in (0, 1, 7, 60):
        near = lambda o, f: any(c and None not in (o, f, o2, f2) and o == o2 and abs(f - f2) <= reach for o2, f2, c in rows)  # noqa: E731, B023
        got = memory.cleared(frames, frames.where("conditioning"), reach)
        assert got.columns == frames.columns
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(r) for r in rows if not near(*r[:2]))
    plan = memory.cleared(frames, frames.where("conditioning"), 10**6)
    assert plan.count() <= len(rows)  # two million frames a conditioning one would not be listed
    assert "BroadcastHashJoin" not in plan._jdf.queryExecution().executedPlan().toString()


def test_suppression_of_many_small_groups_and_a_large_one(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(3000):
        x, y, w, h = (float(v) for v in rng.integers(1, 60, 4))
        rows.append((i % 700 if i > 900 else -1, "ab"[i % 2], i, float(rng.integers(0, 5)) / 4, x, y, x + w, y + h))
    frames = spark.createDataFrame(rows, "step_nr long, class_name string, detection_id long, confidence double, x1 double, y1 double, x2 double, y2 double")
    want = []
    for key in {r[:2] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[:2] == key), key=lambda r: (-r[3], r[2])):
            area = lambda b: (b[6] - b[4]) * (b[7] - b[5])
            shared = lambda a, b: max(min(a[6], b[6]) - max(a[4], b[4]), 0.0) * max(min(a[7], b[7]) - max(a[5], b[5]), 0.0)
            if not any(shared(r, k) > 0.5 * (area(r) + area(k) - shared(r, k)) for k in kept):
                kept.append(r)
        want += kept
    got = masks.suppress(frames)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()  # no frame of its own a group


def test_suppression_keeps_the_strongest(spark):
    d = spark.createDataFrame([(0, "a", 0, 0.9, 0.0, 0.0, 10.0, 10.0), (0, "a", 1, 0.8, 1.0, 1.0, 10.0, 10.0), (0, "b", 2, 0.7, 1.0, 1.0, 10.0, 10.0), (0, "a", 3, 0.6, 20.0, 20.0, 30.0, 30.0)], "step_nr long, class_name string, detection_id int, confidence double, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r.detection_id for r in masks.suppress(d).collect()) == [0, 2, 3]


def test_labels_round_as_their_sql_does(spark):
    shares = [k / 1000 for k in range(300, 4000)]  # 0.575 * 100 is less than 57.5
    d = spark.createDataFrame([(0, i, None if i == 7 else "Chair", c) for i, c in enumerate(shares)], "step_nr long, detection_id int, class_name string, confidence double")
    got = {r.detection_id: r.label for r in scene_tables.detection_labels(d).collect()}
    want = duckdb.sql("SELECT i, CASE WHEN i <> 7 THEN 'Chair (' || printf('%.2f', round((i + 300) / 1000, 2)) || ')' END FROM range(3700) t(i)").fetchall()
    assert got == dict(want) and got[275] == "Chair (0.57)" and got[7] is None
    assert "0.57m" in spark.range(1).select(proximity.warning_message(F.lit(0.575), F.lit("caution"), F.lit("Chair"), F.lit(5), F.lit(None).cast("string"))).first()[0]


def test_estimated_users_need_one_sketch_a_class(spark):
    d = spark.range(60_000).selectExpr("concat('c', id % 3) AS class_name", "CASE WHEN id % 50 = 0 THEN NULL ELSE id DIV 4 END AS user_id")
    got = stats.users_of_classes(d)
    want = d.groupBy("class_name").agg(F.countDistinct("user_id").alias("users"), F.approx_count_distinct("user_id", 0.01).alias("about"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    sketched = [line for line in plan.splitlines() if "approx_count_distinct" in line]
    assert sketched and all("Aggregate [class_name#" in line and ", user_id#" not in line.split("], [")[0] for line in sketched)


def test_video_reasons(spark):
    rows = [(1, "mp4", "yuv420p", "High", "bt709", "h264", None), (2, "matroska", "yuv420p10le", "High 10", "bt2020nc", "av1", ["DOVI configuration record"])]
    got = {r.video_id: (r.reasons, r.convert) for r in video.compatibility(spark.createDataFrame(rows, "video_id long, container string, pix_fmt string, profile string, color_space string, codec string, side_data array<string>")).collect()}
    assert got == {1: ("", False), 2: ("container,10-bit,profile,colour space,dolby vision,av1", True)}


def test_object_numbers_are_dense_in_order_of_appearance(spark):
    d = spark.createDataFrame([("b", 3), ("a", 1), ("c", 1), ("b", 9), (None, 0)], "k string, step_nr long")
    assert {(r.k, r.object_nr) for r in asof.object_numbers(d, "k").collect()} == {("a", 1), ("c", 2), ("b", 3)}


def test_pipeline_validates_before_running(spark, scene):
    config = {"pipeline": {"components": [{"type": "floor_detection", "config": {"min_inliers": 4}}, {"type": "closest_points", "config": {"half_angle": None}}, {"type": "distance_statistics"}]}}
    steps = pipeline.steps_of(config)
    with pytest.raises(ValueError, match="needs"):
        pipeline.validate(steps, {"points"})
    with pytest.raises(ValueError, match="unknown"):
        pipeline.steps_of({"pipeline": {"components": [{"type": "nothing"}]}})
    with pytest.raises(ValueError, match="no type"):
        pipeline.steps_of({"pipeline": {"components": [{}]}})
    points, poses = scene
    assert pipeline.run(steps, {"points": points, "poses": poses})["distance_stats"].first().n > 0
