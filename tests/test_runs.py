"""Running values, checks, versions, sketches and the SQL face against plain Python."""

import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from trailstone import sql
from trailstone.operators import checks, sketches, versions
from trailstone.operators.ordered import running


@pytest.mark.parametrize("block", [2, 3, 64])
def test_running_of_a_function_that_does_not_commute(spark, block):
    """2 x 2 matrices modulo a prime; one key holds most rows."""
    rng = random.Random(block)
    rows = [(0 if rng.random() < 0.7 else None if rng.random() < 0.3 else rng.randrange(1, 9), i, *(rng.randrange(97) for _ in range(4))) for i in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, at long, a long, b long, c long, d long")
    state = F.struct("a", "b", "c", "d")

    def times(x, y):
        cell = lambda p, q, r, s: (x[p] * y[q] + x[r] * y[s]) % 97
        return F.struct(cell("a", "a", "b", "c").alias("a"), cell("a", "b", "b", "d").alias("b"), cell("c", "a", "d", "c").alias("c"), cell("c", "b", "d", "d").alias("d"))

    got = {(r.k, r.at): tuple(r.m) for r in running(df, ["k"], ["at"], state, times, "m", block).collect()}

    def plain(x, y):
        return ((x[0] * y[0] + x[1] * y[2]) % 97, (x[0] * y[1] + x[1] * y[3]) % 97, (x[2] * y[0] + x[3] * y[2]) % 97, (x[2] * y[1] + x[3] * y[3]) % 97)

    want = {}
    for key in {r[0] for r in rows}:
        own = sorted((r[1], r[2:]) for r in rows if r[0] == key)
        want |= {(key, own[i][0]): reduce(plain, [m for _, m in own[: i + 1]]) for i in range(len(own))}
    assert got == want and running(df.limit(0), ["k"], ["at"], state, times, "m").count() == 0


def test_rows_that_break_rules(spark):
    rows = [(1, [0.0, 0.0, 1.0, 1.0]), (2, [0.0, 0.0, 1.0]), (3, [1.0, 0.0, 0.0, 1.0]), (4, None), (5, [0.0, float("nan"), 1.0, 1.0]), (6, [0.0, 0.0, None, 1.0])]
    df = spark.createDataFrame(rows, "id int, bbox array<double>")
    good, rejects, counts = checks.split(df, checks.box_rules())
    assert [r.id for r in good.collect()] == [1]
    assert {r.id: r.broken for r in rejects.collect()} == {2: ["four_numbers", "positive_area"], 3: ["positive_area"], 4: ["four_numbers", "finite", "positive_area"], 5: ["finite", "positive_area"], 6: ["finite", "positive_area"]}
    assert counts["rows"] == 6 and counts["four_numbers"] == 2 and counts["finite"] == 3
    assert checks.required(df.where("id = 1"), checks.box_rules()).count() == 1
    with pytest.raises(Exception, match=r"box breaks positive_area: .*\"id\":3"):
        checks.required(df.where("id = 3"), checks.box_rules(), "box").collect()


def test_tracker_tables(spark):
    outputs = spark.createDataFrame([(1, 0), (1, 5), (2, 3), (2, 4)], "object_id int, frame_idx int")
    assert sorted(tuple(r) for r in checks.late_objects(outputs, 2).collect()) == [(2, 3, 3), (2, 4, 3)]
    final = spark.createDataFrame([(1, 0), (2, 9), (2, 9)], "object_id int, frame_idx int")
    assert sorted(tuple(r) for r in checks.output_conflicts(outputs, final).collect()) == [(1, 0, 1, 1), (2, 9, 0, 2)]


def test_versions(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "keyframe_id long, pose string")
    t = versions.VersionedTable(spark, str(tmp_path / "v"), "keyframe_id long, pose string")
    assert t.as_of().count() == 0
    t.apply(1, 10, rows((1, "a"), (2, "b")))
    t.apply(1, 10, rows((1, "a"), (2, "b")))  # twice
    t.apply(2, 20, rows((1, "c"), (3, "d")))
    t.apply(3, 30, rows((2, "e")), deleted=rows((3, None)))
    at = lambda s: sorted((r.keyframe_id, r.pose, r.valid_from) for r in t.as_of(s).collect())
    assert at(5) == [] and at(10) == at(19) == [(1, "a", 10), (2, "b", 10)]
    assert at(20) == [(1, "c", 20), (2, "b", 10), (3, "d", 20)] and at(None) == [(1, "c", 20), (2, "e", 30)]
    t.withdraw(4, 2)  # its relocalisation failed
    assert at(25) == [(1, "a", 10), (2, "b", 10)] and at(None) == [(1, "a", 10), (2, "e", 30)]
    t.withdraw(5, 1, rows((2, None)))
    assert at(25) == [(1, "a", 10)]
    assert sorted((r.keyframe_id, r.valid_from, r.valid_to) for r in t.intervals().collect()) == [(1, 10, None), (2, 30, None)]
    asked = spark.createDataFrame([(1, 9), (1, 10), (2, 29), (2, 30), (9, 1)], "keyframe_id long, step_nr long")
    got = versions.as_of_each(t.intervals(), asked, values=["pose"])
    assert sorted((r.keyframe_id, r.step_nr, r.pose) for r in got.collect()) == [(1, 9, None), (1, 10, "a"), (2, 29, None), (2, 30, "e"), (9, 1, None)]


def test_many_batches_are_applied_and_withdrawn_at_once(spark, tmp_path):
    log = [(b, 10 * b, k, f"{b}-{k}") for b in range(1, 40) for k in (b % 5, 7)]
    changes = spark.createDataFrame(log, "batch long, step_nr long, keyframe_id long, pose string")
    one, many = (versions.VersionedTable(spark, str(tmp_path / n), "keyframe_id long, pose string") for n in ("one", "many"))
    for batch in range(1, 40):
        one.apply(batch, 10 * batch, changes.where(F.col("batch") == batch))
    for batch in (4, 8, 12):
        one.withdraw(100 + batch, batch)
    many.apply(3, 30, changes.where("batch = 5"))  # replaced below
    many.apply(50, 500, changes.where("batch = 5"))  # stays
    one.apply(50, 500, changes.where("batch = 5"))
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    many.apply_all(changes)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - len(before) < 8  # not a job a batch
    many.apply_all(changes)
    many.withdraw(100, spark.createDataFrame([(4,), (8,), (12,)], "withdrawn_batch long"))
    rows = lambda t: sorted(tuple(r) for r in t.intervals().na.fill(-1).collect())
    assert rows(many) == rows(one) and len(rows(many)) == 2 * 39 + 2 - 2 * 3
    assert sorted(map(tuple, many.as_of(85).collect())) == sorted(map(tuple, one.as_of(85).collect()))


def test_sketches_merged_over_runs_are_within_their_bounds(spark):
    df = spark.range(200_000).selectExpr("id % 3 AS c", "id % 40 AS run", "(id * 7919) % 20011 AS who", "CAST((id * 104729) % 100003 AS DOUBLE) AS v")
    parts = sketches.by_run(df, ["c"], "run", "who", "v")
    assert parts.count() == 120
    once = {r.c: r for r in sketches.merged(sketches.by_run(df.withColumn("run", F.lit(0)), ["c"], "run", "who", "v"), ["c"]).collect()}
    exact = {r.c: r for r in df.groupBy("c").agg(F.countDistinct("who").alias("who"), F.count("*").alias("n")).collect()}
    for r in sketches.merged(parts, ["c"]).collect():
        assert r.n == exact[r.c].n and r.about == once[r.c].about  # merging adds nothing to the error of the count
        assert abs(r.about - exact[r.c].who) <= 4 * 1.04 / 64 * exact[r.c].who
        for q, name in ((0.25, "low"), (0.5, "middle"), (0.75, "high")):
            for found in (r[name], once[r.c][name]):
                rank = df.where(f"c = {r.c} AND v <= {found}").count() / r.n
                assert abs(rank - q) <= 0.03


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT warning_level(0.2D) a, warning_level(0.21D) b, warning_level(0.61D) c, warning_level(NULL) d, plane_distance(1D, 2D, 3D, 0D, 1D, 0D, 0.5D) e, camera_forward(0D, 0.6D, 0D, 0.8D) f").first()
    assert (row.a, row.b, row.c, row.d, row.e) == ("critical", "strong", "normal", None, 1.5)
    assert (round(row.f.x, 9), round(row.f.y, 9), round(row.f.z, 9)) == (0.96, 0.0, 0.28)
    assert spark.sql("SELECT count(*) n FROM VALUES (0D), (NULL) t(x), LATERAL view_cone(x, 0D, 0D, 0D, 0D, 0D, 1D, 1D) c").first().n == 24
    slanted = spark.sql("SELECT * FROM floor_grid(1D, 2D, 3D, 0.6D, 0.8D, 0D, 1D)").collect()
    assert len(slanted) == 22 and all(abs(0.6 * r.ax + 0.8 * r.ay - 1) < 1e-9 and abs(0.6 * r.bx + 0.8 * r.by - 1) < 1e-9 for r in slanted)


def test_components_of_a_whole_run(spark, tmp_path):
    """Detections, segmentation, scene and writer as steps of one pipeline."""
    from trailstone.plans import pipeline
    from trailstone.sources import bindings as b
    from trailstone.sources import files, ply

    d = "/root/testdata/sf0.001"
    raw = b.detections(spark, d)
    odd = raw.limit(3).withColumn("x2", F.col("x1") - 1)
    logits = spark.range(4000).selectExpr("id % 3 AS mask_id", "id DIV 3 % 40 AS row", "id DIV 120 AS col", "CAST(id % 7 AS LONG) - 3 AS logit")
    steps = pipeline.steps_of({"pipeline": {"components": [{"type": "detections", "config": {"per_frame": 2}}, {"type": "segmentation", "config": {"min_area": 100}}, {"type": "scene"}, {"type": "output_writer", "config": {"folder": str(tmp_path), "only_save_last": False}}]}})
    given = {"raw_detections": raw.unionByName(odd), "mask_logits": logits, "poses": b.poses(spark, d), "segment_labels": b.segment_labels(spark, d), "points": b.points(spark, d)}
    out = pipeline.run(steps, given)
    assert out["rejected_detections"].count() == 3 and out["detections"].groupBy("step_nr").count().agg(F.max("count")).first()[0] == 2
    sizes = [r["count"] for r in out["mask_pixels"].groupBy("mask_id").count().collect()]
    assert sizes and min(sizes) > 100 and out["mask_pixels"].groupBy("row", "col").count().where("count > 1").isEmpty()
    log = out["scene_log"]
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"pose", "detection", "label"} and log.where("kind = 'detection'").count() == out["detections"].count()
    written = {r.kind: r for r in out["written_files"].collect()}
    assert written["pointcloud"].rows == given["points"].count() == ply.read_ply(spark, written["pointcloud"].path).count()
    assert written["trajectory"].rows == 5 == files.read_trajectory(spark, written["trajectory"].path).count()
    with pytest.raises(ValueError, match="folder"):
        pipeline.run(pipeline.steps_of({"pipeline": {"components": [{"type": "output_writer"}]}}), given)
