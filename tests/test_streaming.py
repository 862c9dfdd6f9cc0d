from pyspark.sql import functions as F

from trailstone.operators import floor
from trailstone.streaming import stateful

DATA = "/root/testdata/sf0.001"


def feed(spark, frames, tmp_path, schema, build, mode):
    """Writes each list of rows as a file of a stream and gives all that the query put out, in order of triggers."""
    out = []
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = build(stream).writeStream.outputMode(mode).foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return out


def test_floor_schedule_equals_the_batch_form(spark, tmp_path):
    frames = [[("s", i) for i in range(a, a + 8)] for a in (0, 8, 16, 24)]
    out = feed(spark, frames, tmp_path, "session_id string, step_nr long", lambda s: stateful.floor_schedule(s, 3, 10), "append")
    assert sorted((r.step_nr + 1, r.action) for r in out if r.action != "none") == floor.schedule(32, 3, 10)


def test_gate_carries_its_last_run(spark, tmp_path):
    frames = [[("s", 0), ("s", 1)], [("s", 2), ("s", 3), ("s", 4)], [("s", 5), ("s", 6)]]
    out = feed(spark, frames, tmp_path, "session_id string, step_nr long", lambda s: stateful.detector_gate(s, 3), "append")
    assert sorted(r.step_nr for r in out if r.run) == [0, 3, 6]


def test_label_memory_keeps_the_newest(spark, tmp_path):
    frames = [[("s", 1, 0, "Chair")], [("s", 1, 5, "Table"), ("s", 2, 5, "Lamp")], [("s", 1, 3, "Late")]]
    out = feed(spark, frames, tmp_path, "session_id string, segment_id int, step_nr long, class_label string", stateful.label_memory, "update")
    last = {r.segment_id: r.class_label for r in out}
    assert last == {1: "Table", 2: "Lamp"}


def test_windows_on_a_stream_equal_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id", "event_id")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = stateful.windowed_counts(stream).writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.start, r.event_type): r.n for r in spark.table("w").collect()}
    want = {(r.start, r.event_type): r.n for r in stateful.windowed_counts(events).collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(want) - len(got) <= 10
    q = stateful.without_repeats(stream.unionByName(stream)).writeStream.format("memory").queryName("y").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("y").count() == events.count()
    q = stateful.sessions(stream).writeStream.format("memory").queryName("x").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("x").count() > 0


def test_floor_detector_tries_until_it_succeeds_and_keeps_its_plane(spark, tmp_path):
    fails, good = {2, 3, 9}, lambda i: (0.0, 1.0, 0.0, i / 10)
    rows = [("s", i, *((None,) * 4 if i in fails else good(i))) for i in range(14)]
    out = feed(spark, [rows[:5], rows[5:8], rows[8:]], tmp_path, "session_id string, step_nr long, nx double, ny double, nz double, offset double", lambda s: stateful.floor_detector(s, 3, 5), "append")
    got = {r.step_nr: (r.action, r.offset) for r in out}
    # frames count from 1: tried at the 3rd, 4th and 5th, refined at the 6th (5 after none), 11th
    assert [got[i][0] for i in range(14)] == ["none", "none", "detect", "detect", "detect", "refine", "none", "none", "none", "none", "refine", "none", "none", "none"]
    assert [got[i][1] for i in (3, 4, 5, 9, 10, 13)] == [None, 0.4, 0.5, 0.5, 1.0, 1.0]


def test_floor_detector_keeps_the_plane_where_refining_fails(spark, tmp_path):
    rows = [("s", i, *((0.0, 1.0, 0.0, i / 10) if i < 4 else (None,) * 4)) for i in range(12)]
    out = feed(spark, [rows], tmp_path, "session_id string, step_nr long, nx double, ny double, nz double, offset double", lambda s: stateful.floor_detector(s, 3, 5), "append")
    got = {r.step_nr: (r.action, r.offset) for r in out}
    assert got[2] == ("detect", 0.2) and got[4] == ("refine", 0.2) and got[9] == ("refine", 0.2) and got[11] == ("none", 0.2)


def test_objects_are_numbered_over_triggers(spark, tmp_path):
    frames = [[("s", 1, "b"), ("s", 1, "a"), ("t", 1, "z")], [("s", 2, "a"), ("s", 2, "c"), ("s", 2, None)], [("s", 9, "b")]]
    out = feed(spark, frames, tmp_path, "session_id string, step_nr long, object_key string", stateful.object_numbers, "append")
    assert {(r.session_id, r.object_key): r.object_nr for r in out} == {("s", "a"): 1, ("s", "b"): 2, ("s", "c"): 3, ("t", "z"): 1} and len(out) == 6


def test_warning_changes_cross_triggers(spark, tmp_path):
    frames = [[("s", 0, "normal", 0.9), ("s", 1, "caution", 0.5)], [("s", 2, "caution", 0.45), ("s", 3, "critical", 0.1)]]
    out = feed(spark, frames, tmp_path, "session_id string, step_nr long, level string, distance double", stateful.warning_changes, "append")
    assert sorted((r.step_nr, r.level, r.previous_level, r.previous_distance) for r in out) == [(0, "normal", None, None), (1, "caution", "normal", 0.9), (3, "critical", "caution", 0.45)]
