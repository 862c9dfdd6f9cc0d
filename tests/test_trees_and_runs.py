"""The cell tree of the nearest-point search, gaps in sequences, several runs in one table, subsampling, files of a run."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trailstone.operators import graph, knn, masks, memory, sampling, scene, stats
from trailstone.operators import points as pt
from trailstone.plans import staging
from trailstone.sources import files


def slow_nearest(pts, pose, k, degrees):
    """By the definition: all points against one pose."""
    x, y, z, w = pose["q"]
    f = np.array([2 * (x * z + y * w), 2 * (y * z - x * w), 1 - 2 * (x * x + y * y)])
    d = pts[["x", "y", "z"]].to_numpy() - pose["t"]
    n = np.linalg.norm(d, axis=1)
    ok = np.ones(len(pts), bool) if degrees is None else (n > 1e-6) & (d @ f >= n * math.cos(math.radians(degrees)))
    return sorted(zip(np.round(n[ok], 6).tolist(), pts["point_id"][ok].tolist(), strict=True))[:k]


def clouds():
    rng = np.random.default_rng(11)
    even = rng.uniform(-5, 5, (1500, 3))
    far = np.concatenate([even, [[4e6, -3e6, 1e6]]])  # one outlier must not put all others into one cell
    cluster = np.concatenate([rng.normal(0, 1e-4, (1500, 3)) + 3, even[:200]])  # a cell far denser than others
    same = np.concatenate([np.tile([1.0, 2.0, 3.0], (700, 1)), even[:50]])  # points that no cell can part
    flat = even * [1, 1, 0]
    return {"even": even, "far": far, "cluster": cluster, "same": same, "flat": flat, "one": even[:1]}


@pytest.mark.parametrize(("name", "degrees"), [*((n, 30.0) for n in clouds()), ("even", None), ("far", None), ("same", None), ("even", 120.0), ("cluster", 120.0)])
def test_nearest_points_of_any_cloud(spark, name, degrees):
    xyz = clouds()[name]
    pts = pd.DataFrame({"point_id": np.arange(len(xyz)), **dict(zip("xyz", xyz.T, strict=True)), "segment_id": 1})
    rng = np.random.default_rng(5)
    poses = [{"t": t, "q": q / np.linalg.norm(q)} for t, q in zip([*rng.uniform(-6, 6, (9, 3)), np.array([3.0, 3, 3]), np.array([40.0, 0, 0])], rng.normal(size=(11, 4)), strict=True)]
    rows = [(i, *p["t"].tolist(), *p["q"].tolist()) for i, p in enumerate(poses)]
    frame = spark.createDataFrame(rows, "step_nr long, tx double, ty double, tz double, qx double, qy double, qz double, qw double")
    got = knn.nearest_points(spark.createDataFrame(pts), frame, k=8, half_angle=degrees).toPandas()
    for i, p in enumerate(poses):
        mine = got[got["step_nr"] == i].sort_values("point_idx")
        assert list(zip(mine["distance"], mine["point_id"], strict=True)) == slow_nearest(pts, p, 8, degrees), (name, i)


def test_trees_keep_leaves_small_and_poses_away_from_most_points(spark):
    for name in ("even", "far", "cluster"):
        xyz = clouds()[name]
        frame = spark.createDataFrame(pd.DataFrame({"point_id": np.arange(len(xyz)), **dict(zip("xyz", xyz.T, strict=True))}))
        placed, nodes, _ = knn.cell_tree(frame)
        assert placed.count() == len(xyz) and placed.select("point_id").distinct().count() == len(xyz)
        assert placed.groupBy("leaf").count().agg(F.max("count")).first()[0] <= knn.LEAF * knn.DENSE
        leaves = nodes.where("leaf AND parent <> node")
        assert leaves.agg(F.sum("n")).first()[0] == len(xyz)


def test_points_without_place_are_left_out(spark):
    rows = [(1, 0.5, 0.0, 1.0, 1), (2, None, 0.0, 1.0, 1), (3, float("nan"), 0.0, 1.0, 1), (4, float("inf"), 0.0, 1.0, 1), (None, 0.0, 0.0, 1.0, 1)]
    points = spark.createDataFrame(rows, "point_id long, x double, y double, z double, segment_id int")
    poses = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)], "step_nr long, tx double, ty double, tz double, qx double, qy double, qz double, qw double")
    assert [r.point_id for r in knn.nearest_points(points, poses, half_angle=None).collect()] == [1]
    assert [r.point_id for r in knn.points_in_cone(points, poses, 2.0).collect()] == [1]


def test_edges_over_gaps_and_blocks(spark):
    rng = np.random.default_rng(2)
    ids = np.cumsum(rng.integers(1, 10**9, 40))
    e = rng.normal(size=(40, 6))
    rows = [(s, int(i), v.tolist()) for s in ("a", "b") for i, v in zip(ids, e * (1 if s == "a" else -1), strict=True)] + [("a", 5, None)]
    frame = spark.createDataFrame(rows, "run string, keyframe_id long, embedding array<float>")
    got = {(r.run, r.keyframe_id): [] for r in frame.collect()}
    for r in graph.retrieve(frame, k=3, threshold=0.1, by=["run"], block=7).collect():
        got[r.run, r.keyframe_id].append((-r.similarity, r.match_id))
    f = e.astype(np.float32).astype(float)
    for i in range(40):
        s = np.round(f[:i] @ f[i], 6)
        want = sorted((-v, int(m)) for v, m in zip(s, ids, strict=False) if v > 0.1)[:3]
        for run in ("a", "b"):
            mine = sorted(got[run, int(ids[i])])
            assert [m for _, m in mine] == [m for _, m in want] and np.allclose([v for v, _ in mine], [v for v, _ in want])
    before = {(r.run, r.src): r.dst for r in graph.consecutive(frame, ["run"]).collect()}
    assert all(before["b", int(y)] == x for x, y in zip(ids, ids[1:], strict=False)) and ("b", int(ids[0])) not in before
    one = frame.where("run = 'b'").drop("run")
    assert graph.edges(one).where(f"src = {ids[1]}").select("dst").distinct().count() == 1
    assert graph.retrieve(one.limit(0)).count() == 0 and graph.edges(one.limit(0)).count() == 0


def test_lines_span_gaps_within_a_run(spark):
    rows = [("a", s, float(s), 0.0, 0.0) for s in (0, 4, 9)] + [("b", s, 0.0, float(s), 0.0) for s in (2, 3)] + [(None, 7, 0.0, 0.0, 0.0)]
    got = scene.trajectory_segments(spark.createDataFrame(rows, "run string, step_nr long, tx double, ty double, tz double"), ["run"]).collect()
    assert sorted((r.run, r.step_nr, r.length) for r in got) == [("a", 0, 4.0), ("a", 4, 5.0), ("b", 2, 1.0)]


def test_subsampling_takes_voxels_or_an_exact_sample(spark):
    rng = np.random.default_rng(0)
    even = pd.DataFrame({"point_id": np.arange(2000), **dict(zip("xyz", rng.uniform(0, 3, (3, 2000)), strict=True)), "segment_id": 1})
    points = spark.createDataFrame(even)
    shown, how = sampling.subsample(points, 0.5, also=["segment_id"])
    assert how in ("voxels", "grid") and abs(shown.count() / 2000 - 0.5) <= 0.05
    same = points.withColumns({c: F.lit(1.0) for c in "xyz"})  # one voxel, whatever its size
    shown, how = sampling.subsample(same, 0.5)
    assert (how, shown.count()) == ("grid", 1000)
    assert sampling.subsample(points, 0.5, last=True)[1] == sampling.subsample(points, 0.5, enabled=False)[1] == sampling.subsample(points.limit(0))[1] == "all"
    assert sampling.first_voxel_size(points, 1000) == pytest.approx(math.sqrt(27) / 10, rel=0.01)
    two = points.withColumn("run", F.col("point_id") % 2)
    assert sampling.voxels(two, 0.5, ["segment_id"], ["run"]).agg(F.sum("n")).first()[0] == 2000


def test_a_hot_step_is_sampled_like_any_other(spark):
    points = spark.range(3000).selectExpr("id AS point_id", "CASE WHEN id < 2500 THEN 1 WHEN id < 2999 THEN id % 7 + 2 END AS step_nr")
    kept = {r.step_nr: r["count"] for r in sampling.percentage_subsample(points, 0.25, "step_nr").groupBy("step_nr").count().collect()}
    sizes = {r.step_nr: r["count"] for r in points.groupBy("step_nr").count().collect()}
    assert kept == {s: n if s == 8 else max(1, n // 4) for s, n in sizes.items()}


def test_reports_of_nothing(spark):
    none = spark.createDataFrame([], "step_nr long, segment_id int, class_label string, class_name string, confidence double")
    r = stats.segmentation_report(none).first()
    assert (r.frames, r.total_frames, r.rate, r.classes, r.class_distribution) == (0, 0, 0.0, [], {})
    assert stats.detection_report(none, none).first().class_counts == {}
    assert stats.stage_timing(2.0, 4) == {"total_s": 2.0, "s_per_frame": 0.5, "frames_per_s": 2.0} and stats.stage_timing(0, 0)["frames_per_s"] == 0


def test_masks_memory_and_colours_by_hand(spark):
    logits = spark.createDataFrame([(1, 0, 0, 0.5), (2, 0, 0, 0.5), (3, 0, 0, -1.0), (2, 0, 1, 0.0)], "mask_id long, row long, col long, logit double")
    assert {(r.mask_id, r.col) for r in masks.from_logits(logits).collect()} == {(1, 0), (2, 0)}
    assert {(r.col, r.mask_id) for r in masks.without_overlap(logits).collect()} == {(0, 1), (1, 2)}
    best = spark.createDataFrame([(7, 1, 0.5), (7, 2, 0.9), (7, 3, 0.9)], "object_id long, mask_id long, predicted_iou double")
    assert [(r.object_id, r.mask_id) for r in masks.best_by_predicted_iou(best).collect()] == [(7, 2)]
    frames = spark.createDataFrame([(1, 0), (1, 5), (2, 0)], "object_id long, frame_idx long")
    assert {(r.object_id, r.frame_idx) for r in memory.reset(frames, spark.createDataFrame([(1, 3), (1, 0)], "object_id long, reset_at long")).collect()} == {(1, 5), (2, 0)}
    bytes_ = spark.createDataFrame([(0.0, 0.5, 1.0)], "r double, g double, b double")
    assert tuple(pt.byte_colours(bytes_).first()) == (0, 127, 255)
    assert tuple(pt.byte_colours(spark.createDataFrame([(0.0, 0.5, 200.9)], "r double, g double, b double")).first()) == (0, 0, 200)
    scored = masks.score_frames(spark.range(3), lambda f: f.assign(twice=f["id"] * 2), "id long, twice long")
    assert sorted(tuple(r) for r in scored.collect()) == [(0, 0), (1, 2), (2, 4)]


def test_calibration_videos_and_overrides(spark, tmp_path):
    path = tmp_path / "camera.yaml"
    path.write_text("width: 640\nheight: 480 # pixels\ncalibration: [500.5, 501, 320, 240, 0.1, -0.2]\n")
    c = files.calibration(spark, str(path), True)
    assert c == {"width": 640, "height": 480, "fx": 500.5, "fy": 501, "cx": 320, "cy": 240, "distortion": [0.1, -0.2]}
    assert files.calibration(spark, None, False) is None and files.calibration(spark, str(tmp_path / "no"), False) is None
    for bad in (None, str(tmp_path / "no")):
        with pytest.raises(ValueError, match="calibration"):
            files.calibration(spark, bad, True)
    (tmp_path / "v").mkdir()
    for name in ("b.MP4", "a.mov", "c.Mp4", "d.txt"):
        (tmp_path / "v" / name).write_bytes(b"x")
    assert [r.path.rsplit("/", 1)[1] for r in files.video_files(spark, str(tmp_path / "v")).collect()] == ["a.mov", "b.MP4"]
    (tmp_path / "metadata.json").write_text('{"pipeline_configuration": {"components": [{"type": "b", "config": {"x": 45}}]}}')
    assert files.overridden({"x": 1, "y": 2}, files.read_metadata(spark, str(tmp_path / "metadata.json")), "b") == {"x": 45, "y": 2}


def test_clusters_need_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, other):
                return other

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_folder(Session())


def test_a_hundred_thousand_points_on_one_spot(spark):
    """The k smallest ids of a spot stand for it; poses don't meet the rest."""
    spot = spark.range(100_000).selectExpr("id AS point_id", "1.0D AS x", "2.0D AS y", "3.0D AS z", "1 AS segment_id")
    near = spark.range(40).selectExpr("500000 + id AS point_id", "id * 0.25D - 5 AS x", "0.5D AS y", "3.5D AS z", "1 AS segment_id")
    poses = spark.createDataFrame([(i, i * 0.1, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0) for i in range(30)], "step_nr long, tx double, ty double, tz double, qx double, qy double, qz double, qw double")
    placed, _, _ = knn.cell_tree(spot.unionByName(near), (), 5)
    assert placed.count() <= 5 + 40
    got = knn.nearest_points(spot.unionByName(near), poses, k=5, half_angle=None).collect()
    for step in range(30):
        own = sorted((r.distance, r.point_id) for r in got if r.step_nr == step)
        rows = [(i, 1.0, 2.0, 3.0) for i in range(5)] + [(500_000 + i, i * 0.25 - 5, 0.5, 3.5) for i in range(40)]
        want = sorted((round(math.dist((step * 0.1, 1.0, 0.0), p[1:]), 6), p[0]) for p in rows)[:5]
        assert own == want


def test_columns_left_out_hold_no_point_of_a_cone(spark):
    rng = np.random.default_rng(8)
    x = rng.uniform(-2, 2, (1500, 3))
    q = rng.normal(size=(40, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    t = rng.uniform(-1.5, 1.5, (40, 3))
    points = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "point_id long, x double, y double, z double")
    poses = spark.createDataFrame([(i, *map(float, a), *map(float, r)) for i, (a, r) in enumerate(zip(t, q, strict=True))], "step_nr long, tx double, ty double, tz double, qx double, qy double, qz double, qw double")
    a, b, c, d = q.T
    f = np.stack([2 * (a * c + b * d), 2 * (b * c - a * d), 1 - 2 * (a * a + b * b)], 1)
    for half in (20.0, 45.0, 100.0):
        v = x[None] - t[:, None]
        inside = ((v * f[:, None]).sum(2) >= np.linalg.norm(v, axis=2) * np.cos(np.radians(half))) & (np.hypot(v[..., 0], v[..., 2]) <= 0.7)
        got = knn.points_in_cone(points, poses, 0.7, floor=(0.0, 1.0, 0.0, 0.0), half_angle=half).select("step_nr", "point_id").collect()
        assert {tuple(r) for r in got} == set(map(tuple, np.argwhere(inside).tolist())) and len(got) == inside.sum()
