import json
from datetime import datetime

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from trailstone.sources import files, ply, runs


def test_ply_round_trip_with_and_without_optional_columns(spark, tmp_path):
    full = spark.createDataFrame([(i * 0.5, 1.0, -i * 1.0, i % 256, 2, 3, 0.25, i % 300) for i in range(1000)], "x double, y double, z double, r short, g short, b short, confidence double, segment_id int")
    for columns in (["x", "y", "z"], ["x", "y", "z", "r", "g", "b"], full.columns):
        ply.write_ply(full.select(*columns), str(tmp_path / "cloud"))
        back = ply.read_ply(spark, str(tmp_path / "cloud" / "*.ply"))
        assert back.count() == 1000
        got = sorted(tuple(r) for r in back.select(*columns).collect())
        want = sorted((*r[:7], r[7] % 256) if len(r) == 8 else tuple(r) for r in full.select(*columns).collect())
        assert got == want
        assert all(v is None for v in back.select(*(c for c in full.columns if c not in columns), "step_nr").first())


def test_ply_ascii_steps_and_bad_files(spark, tmp_path):
    head = "ply\nformat ascii 1.0\ncomment x\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n"
    for step in (3, 12):
        d = tmp_path / f"step_{step:06d}"
        d.mkdir()
        (d / "pointcloud.ply").write_text(head + f"1 2 3 10 20 30\n4 5 {step} 1 2 3\n")
    bad = tmp_path / "step_000020"
    bad.mkdir()
    (bad / "pointcloud.ply").write_bytes(b"not a cloud")
    got = ply.read_ply(spark, str(tmp_path / "step_*" / "pointcloud.ply"), skip_bad=True)
    assert sorted((r.step_nr, r.z, r.r) for r in got.collect()) == [(3, 3.0, 1), (3, 3.0, 10), (12, 3.0, 10), (12, 12.0, 1)]
    with pytest.raises(Exception, match="PLY"):
        ply.read_ply(spark, str(tmp_path / "step_*" / "pointcloud.ply")).count()


def test_trajectory_round_trip(spark, tmp_path):
    poses = spark.createDataFrame([(i * 0.5, 1.0, 2.0, 3.0, 0.0, 0.6, 0.0, 0.8) for i in range(5)], files.TRAJECTORY)
    files.write_trajectory(poses, str(tmp_path / "t"))
    assert sorted(files.read_trajectory(spark, str(tmp_path / "t")).collect()) == sorted(poses.collect())


def test_floor_files(spark, tmp_path):
    planes = spark.createDataFrame([(0.0, 1.0, 0.0, 0.1, 4), (0.0, 1.0, 0.0, 0.2, 9)], "nx double, ny double, nz double, offset double, step_nr long")
    files.write_floor(planes, str(tmp_path / "f"))
    r = files.read_floor(spark, str(tmp_path / "f")).first()
    assert (r.ny, r.offset, r.step_nr, r.timestamp) == (1.0, 0.2, 9, None)
    (tmp_path / "f.json").write_text(json.dumps({"floor_normal": [0, 1, 0], "floor_offset": 0.3, "detection_step": 2, "timestamp": "5.5"}))
    assert files.read_floor(spark, str(tmp_path / "f.json")).first().timestamp == 5.5


def test_closest_files(spark, tmp_path):
    c = spark.createDataFrame([(0, 0, 1.0, 2.0, 3.0, 7, 0.5, None, None), (0, 1, 1.0, 2.0, 4.0, 8, 0.6, 3, "Chair")], "step_nr long, point_idx int, x double, y double, z double, point_id long, distance double, segment_id int, class_label string")
    files.write_closest_points(c, str(tmp_path / "p"))
    assert [(r.point_idx, r.point_id) for r in files.read_closest_points(spark, str(tmp_path / "p")).collect()] == [(0, 7)]
    files.write_closest_objects(c, str(tmp_path / "o"))
    assert sorted((r.segment_id, r.class_label) for r in files.read_closest_objects(spark, str(tmp_path / "o")).collect()) == [(-1, "unknown"), (3, "Chair")]
    ragged = {"n_closest_points_3d": [[[1, 2, 3], [4, 5, 6]], []], "n_closest_points_indices": [[9, 8], []], "n_closest_points_distances": [[0.1, 0.2], []]}
    (tmp_path / "p.json").write_text(json.dumps(ragged))
    assert [(r.step_nr, r.point_idx, r.z, r.point_id) for r in files.read_closest_points(spark, str(tmp_path / "p.json")).collect()] == [(0, 0, 3.0, 9), (0, 1, 6.0, 8)]
    with pytest.raises(ValueError, match="missing"):
        files.read_closest_objects(spark, str(tmp_path / "p"))


def test_detection_and_label_files(spark, tmp_path):
    frames = spark.createDataFrame([(0, 0.0), (1, 0.1)], "step_nr long, ts_sec double")
    d = spark.createDataFrame([(0, "Chair", 1.0, 2.0, 4.0, 6.0, 0.5, 3, 0)], "step_nr long, class_name string, x1 double, y1 double, x2 double, y2 double, confidence double, class_id int, detection_id int")
    files.write_detections(frames, d, str(tmp_path / "d"))
    assert spark.read.option("header", True).csv(str(tmp_path / "d")).count() == 2
    assert [(r.class_name, r.w, r.h) for r in files.read_detections(spark, str(tmp_path / "d")).collect()] == [("Chair", 3.0, 4.0)]
    labels = spark.createDataFrame([(0, 0.0, 5, "Chair")], "step_nr long, ts_sec double, segment_id int, class_label string")
    files.write_labels(labels, str(tmp_path / "l"))
    assert files.read_labels(spark, str(tmp_path / "l")).first().class_label == "Chair"


def test_metadata_snapshots_and_run_names(spark, tmp_path):
    text = files.metadata_row(spark.createDataFrame([(3, 1.5)], "poses long, duration double"), {"k": "20"}, {}).first().value
    assert json.loads(text) == {"data_summary": {"poses": 3, "duration": 1.5}, "configuration": {"k": "20"}, "file_paths": {}}
    files.write_snapshots(spark.range(40).selectExpr("id AS step_nr", "id AS point_id"), str(tmp_path / "s"))
    assert sorted(r.step_nr for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [9, 19, 29, 39]
    assert runs.next_run_name(["run_2", "run_10", "other", "run_x"]) == "run_11" and runs.next_run_name([]) == "run_0"
    frames = spark.range(10).withColumnRenamed("id", "frame_idx")
    assert sorted(r.frame_idx for r in files.sampled_frames(frames, 2).collect()) == [0, 1, 2, 3, 4]


def test_component_config_and_candidate_paths(spark, tmp_path):
    doc = {"pipeline_configuration": {"components": [{"type": "a", "config": {"x": 1}}, {"type": "b", "config": {"x": 45}}, {"type": "b", "config": {"x": 9}}]}}
    (tmp_path / "metadata.json").write_text(json.dumps(doc))
    meta = files.read_metadata(spark, str(tmp_path / "metadata.json"))
    assert files.component_config(meta, "b") == {"x": 45} and files.component_config(meta, "c") == {}
    assert files.first_existing(spark, None, str(tmp_path / "no"), str(tmp_path)) == str(tmp_path)
    assert files.first_existing(spark, str(tmp_path / "no")) is None


# ---- PLY as a data source


def cloud(spark, n, steps=1):
    return spark.range(n).selectExpr("id AS n", f"id % {steps} AS step_nr", "CAST(id AS DOUBLE) AS x", "id * 0.5D AS y", "-1.0D * id AS z", "CAST(id % 250 AS SHORT) AS r", "CAST(id % 7 AS SHORT) AS g", "CAST(id % 11 AS SHORT) AS b")


def mapped(path):
    """store://<a folder's name in hex>/...: a store that only this function knows."""
    host, _, inside = path.removeprefix("store://").partition("/")
    return pafs.SubTreeFileSystem(bytes.fromhex(host).decode(), pafs.LocalFileSystem()), inside


def test_ranges_of_one_file_go_to_many_tasks(spark, tmp_path):
    ply.write_ply(cloud(spark, 100_000).coalesce(1), str(tmp_path / "c"))
    assert len(list((tmp_path / "c").glob("*.ply"))) == 1
    back = ply.read_ply(spark, str(tmp_path / "c"), vertices="7000")
    assert back.rdd.getNumPartitions() == 15
    r = back.agg(F.count("*"), F.sum("x"), F.countDistinct("point_id"), F.sum(F.col("x") - F.col("point_id"))).first()
    assert tuple(r) == (100_000, sum(range(100_000)), 100_000, 0.0)


def test_filters_leave_files_and_ranges_out(spark, tmp_path):
    ply.write_ply(cloud(spark, 3000, steps=30), str(tmp_path / "c"), by_step=True)
    assert len(list((tmp_path / "c").glob("step_*"))) == 30
    back = ply.read_ply(spark, str(tmp_path / "c"), vertices="10")
    for condition, tasks, rows in (("step_nr = 4", 10, 100), ("step_nr IN (4, 5)", 20, 200), ("step_nr > 27", 20, 200), ("step_nr <= 2 AND point_id < 20", 6, 60), ("step_nr = 99", 1, 0), ("step_nr = 3 AND x > 3000", 10, 0)):
        got = back.where(condition)
        assert (got.rdd.getNumPartitions(), got.count()) == (tasks, rows), condition
    assert {r.step_nr for r in back.select("step_nr").distinct().collect()} == set(range(30))


def test_only_the_last_step(spark, tmp_path):
    ply.write_ply(cloud(spark, 1000, steps=4), str(tmp_path / "c"), only_last=True)
    assert sorted(r.x for r in ply.read_ply(spark, str(tmp_path / "c")).collect()) == [float(i) for i in range(3, 1000, 4)]


def test_files_hold_at_most_so_many_vertices_and_appends_add(spark, tmp_path):
    where = str(tmp_path / "c")
    ply.write_ply(cloud(spark, 1000).coalesce(1), where, most="300")
    assert len(list((tmp_path / "c").glob("*.ply"))) == 4 and not (tmp_path / "c" / "_temporary").exists()
    ply.write_ply(cloud(spark, 10).coalesce(1), where, mode="append")
    assert ply.read_ply(spark, where).count() == 1010
    ply.write_ply(cloud(spark, 10).coalesce(1), where)
    assert ply.read_ply(spark, where).count() == 10


def test_a_write_that_fails_leaves_what_there_was(spark, tmp_path):
    where = str(tmp_path / "c")
    ply.write_ply(cloud(spark, 10), where)
    bad = cloud(spark, 1000).withColumn("x", F.when(F.col("n") < 900, F.col("x")).otherwise(F.raise_error(F.lit("no"))))
    with pytest.raises(Exception, match="no"):
        ply.write_ply(bad.repartition(4), where)
    assert ply.read_ply(spark, where).count() == 10 and not (tmp_path / "c" / "_temporary").exists()


def test_stores_of_other_schemes(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    where = f"store://{str(tmp_path).encode().hex()}/run/clouds"
    with pytest.raises(Exception, match="(?i)store|scheme|filesystem"):
        ply.write_ply(cloud(spark, 10), where)
    assert list(tmp_path.iterdir()) == []  # no folder of that name
    ply.write_ply(cloud(spark, 1000, steps=3), where, by_step=True, filesystem="tests.test_sources:mapped")
    assert len(list((tmp_path / "run" / "clouds").glob("step_*/*.ply"))) == 3
    back = ply.read_ply(spark, f"{where}/step_*/*.ply", filesystem="tests.test_sources:mapped")
    assert back.where("step_nr = 1").count() == 333 and back.first().path.startswith("store://")


def test_ascii_and_big_endian_files(spark, tmp_path):
    (tmp_path / "a.ply").write_text("ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n4 5 6\n7 8 9\n")
    data = np.array([(1.5, 2, 3), (4, 5, 6)], [("x", ">f4"), ("y", ">f4"), ("z", ">f4")]).tobytes()
    (tmp_path / "b.ply").write_bytes(b"ply\nformat binary_big_endian 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n" + data)
    got = {(r.path.rsplit("/", 1)[1], r.point_id): (r.x, r.y, r.z) for r in ply.read_ply(spark, str(tmp_path)).collect()}
    assert got == {("a.ply", 0): (1, 2, 3), ("a.ply", 1): (4, 5, 6), ("a.ply", 2): (7, 8, 9), ("b.ply", 0): (1.5, 2, 3), ("b.ply", 1): (4, 5, 6)}
    (tmp_path / "c.ply").write_text("ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nend_header\n1\n")
    with pytest.raises(Exception, match="ends after 1 of 3"):
        ply.read_ply(spark, str(tmp_path)).count()
    assert ply.read_ply(spark, str(tmp_path), skip_bad=True).count() == 5


# ---- a run's folder


def test_runs_get_folders_of_their_own(spark, tmp_path):
    assert [runs.new_run(spark, str(tmp_path)).rsplit("/", 1)[1] for _ in range(3)] == ["run_0", "run_1", "run_2"]
    with pytest.raises(FileNotFoundError):
        runs.new_run(spark, str(tmp_path / "nowhere"))
    assert runs.output_folder("/a/", "slam", datetime(2024, 2, 29, 7, 8, 9)) == "/a/slam_20240229_070809" and runs.output_folder("/a", "slam") == "/a/slam"


def test_which_file_is_read(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    assert runs.resolved(spark, str(tmp_path), None, "trajectory_path", runs.TRAJECTORIES) == at(runs.TRAJECTORIES[0])
    (tmp_path / runs.TRAJECTORIES[1]).write_text("")
    assert runs.resolved(spark, str(tmp_path), None, "trajectory_path", runs.TRAJECTORIES) == at(runs.TRAJECTORIES[1])
    assert runs.resolved(spark, str(tmp_path), {"trajectory_path": "elsewhere/t.txt"}, "trajectory_path", runs.TRAJECTORIES) == at("t.txt")
    assert runs.resolved(spark, str(tmp_path), {"trajectory_path": "/abs/t.txt"}, "trajectory_path", runs.TRAJECTORIES) == "/abs/t.txt"
    assert runs.closest_source(spark, str(tmp_path)) is None
    (tmp_path / runs.CLOSEST_POINTS[0]).write_text("")
    assert runs.closest_source(spark, str(tmp_path)) == ("points", at(runs.CLOSEST_POINTS[0]))
    (tmp_path / runs.CLOSEST_OBJECTS[1]).write_text("")
    assert runs.closest_source(spark, str(tmp_path)) == ("objects", at(runs.CLOSEST_OBJECTS[1]))
    assert runs.closest_source(spark, str(tmp_path), prefer_points=True) == ("points", at(runs.CLOSEST_POINTS[0]))


def test_the_converted_video_comes_first(spark, tmp_path):
    out, work = tmp_path / "runs" / "run_0", tmp_path / "work"
    out.mkdir(parents=True)
    work.mkdir()
    found = lambda p: runs.video_path(spark, p, str(out), str(work), str(tmp_path / "home"))
    assert found(None) is None and found("v.mov") is None
    (tmp_path / "runs" / "v.mov").write_text("")
    assert found("v.mov") == str(tmp_path / "runs" / "v.mov")
    (work / "v.mov").write_text("")
    assert found("v.mov") == str(work / "v.mov")
    (work / "v_rerun_compatible.mp4").write_text("")
    assert found("v.mov") == found(str(work / "v.mov")) == str(work / "v_rerun_compatible.mp4")
