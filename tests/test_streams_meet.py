"""Streams joined with streams, and files that a batch writes once."""

import random

import pytest
from pyspark.sql import functions as F

from trailstone.operators import asof
from trailstone.plans import pipeline, timing
from trailstone.sources import files
from trailstone.streaming import joins, sinks
from tests.test_frames import rocks  # noqa: F401

START = 1_700_000_000


def table(spark, rows, schema):
    return spark.createDataFrame(rows, f"seconds long, {schema}").withColumn("ts", F.timestamp_seconds("seconds")).drop("seconds")


def stream_of(spark, path, cuts, schema):
    for i, rows in enumerate(cuts):
        table(spark, rows, schema).coalesce(1).write.parquet(str(path / f"{i:03d}"))
    return spark.readStream.schema(table(spark, [], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(path / "*"))


def collected(df, tmp_path):
    out = []
    q = df.writeStream.outputMode("append").foreachBatch(lambda d, _: out.extend(d.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return out


def shuffled(rows, size, seed):
    """Rows at most nine seconds late, `size` a trigger, and two of a later time that push the watermark on."""
    rng = random.Random(seed)
    rows = sorted(rows, key=lambda r: r[0] + rng.uniform(0, 9))
    return [rows[i : i + size] for i in range(0, len(rows), size)]


@pytest.mark.parametrize("size", [7, 50])
def test_joined_steps_equal_batch_with_late_rows_on_both_sides(spark, tmp_path, size):
    lefts = [(START + i, "s", i, f"l{i}") for i in range(40)]
    rights = [(START + i + 2, "s", i, f"r{i}") for i in range(0, 40, 3)] + [(START + 5, "t", 5, "other")]
    push = [(START + 1000, "end", 0, "x")], [(START + 2000, "end", 1, "x")]
    a = stream_of(spark, tmp_path / "l", [*shuffled(lefts, size, 1), *push], "session_id string, step_nr long, a string")
    b = stream_of(spark, tmp_path / "r", [*shuffled(rights, size, 2), *push], "session_id string, step_nr long, b string")
    got = [r for r in collected(joins.join_steps(a, b), tmp_path) if r.session_id != "end"]
    want = joins.join_steps(table(spark, lefts, "session_id string, step_nr long, a string"), table(spark, rights, "session_id string, step_nr long, b string")).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and sum(r.b is None for r in got) == 26


@pytest.mark.parametrize("size", [9, 60])
def test_newest_of_another_stream_equals_the_asof_join(rocks, tmp_path, size):  # noqa: F811
    spark = rocks
    lefts = [(START + i, s, i) for i in range(2, 40) for s in ("a", "b")] + [(START + 7, "a", 7)]
    rights = [(START + i, "a", i % 5, f"v{i}") for i in range(4, 40, 4)] + [(START + 1, "b", 1, None), (START + 8, "a", 9, "twice")]
    push = [(START + 1000, "end", 0)], [(START + 2000, "end", 1)]
    a = stream_of(spark, tmp_path / "l", [*shuffled(lefts, size, 3), *push], "session_id string, step_nr long")
    b = stream_of(spark, tmp_path / "r", [*shuffled(rights, size, 4), *([(*p[0], "x")] for p in push)], "session_id string, k long, v string")
    got = [r for r in collected(joins.asof_streams(a, b, "session_id", ["k", "v"]), tmp_path) if r.session_id != "end"]
    left, right = table(spark, lefts, "session_id string, step_nr long"), table(spark, rights, "session_id string, k long, v string")
    want = asof.asof_join(left, right, "ts", ["session_id"], ["k", "v"], tie="k").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == 77


def test_a_batch_that_runs_twice_is_there_once(spark, tmp_path):
    schema = "step_nr long, class_name string, confidence double"
    cuts = [[(START + i, i, "abc"[i % 3], i / 10) for i in range(a, a + 10)] for a in (0, 10, 20)]
    stream = stream_of(spark, tmp_path / "in", cuts, schema)
    folder = sinks.RunFolder(str(tmp_path / "out"), ["confidence"], ["class_name"])
    write, died = folder.writer("detections"), []

    def dies_before_it_commits(rows, batch):
        write(rows, batch)
        if batch == 1 and not died:
            died.append(batch)
            raise RuntimeError("killed")

    def start():
        return stream.writeStream.foreachBatch(dies_before_it_commits).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()

    with pytest.raises(Exception, match="killed"):
        start().awaitTermination()
    start().awaitTermination()
    rows = folder.read(spark, "detections")
    assert sorted((r.step_nr, r.batch) for r in rows.collect()) == [(i, i // 10) for i in range(30)]
    got = {r.class_name: (r.n, round(r.confidence_mean, 9), round(r.confidence_std_pop, 9), r.confidence_max) for r in folder.summary(spark, "detections").collect()}
    want = rows.groupBy("class_name").agg(F.count("*"), F.round(F.avg("confidence"), 9), F.round(F.stddev_pop("confidence"), 9), F.max("confidence")).collect()
    assert got == {r[0]: tuple(r)[1:] for r in want}
    assert folder.read(spark, "nothing", schema).count() == 0


def test_unfinished_batches_are_not_read(spark, tmp_path):
    folder = sinks.RunFolder(str(tmp_path / "out"))
    folder.writer("t")(spark.range(5), 0)
    folder.writer("t")(spark.range(7), 1)
    (tmp_path / "out" / "t" / "rows" / "batch=000000001" / "_SUCCESS").unlink()
    assert folder.read(spark, "t").count() == 5


def test_files_by_batch(spark, tmp_path):
    write = sinks.export(files.write_trajectory, str(tmp_path / "t"))
    poses = spark.createDataFrame([(0.5, 1.0, 2.0, 3.0, 0.0, 0.6, 0.0, 0.8)], files.TRAJECTORY)
    for _ in range(2):
        write(poses, 3)
    assert files.read_trajectory(spark, str(tmp_path / "t" / "batch-000000003")).count() == 1


def test_seconds_and_rows_of_a_batch_run(spark):
    calls = spark.sparkContext.accumulator(0)

    @pipeline.register("timing_test_double", {"points"}, {"doubled"})
    def _double(t):
        def run(batches):
            for batch in batches:
                calls.add(batch.num_rows)
                yield batch

        return {"doubled": t["points"].unionByName(t["points"]).mapInArrow(run, "id long")}

    steps = pipeline.steps_of({"pipeline": {"components": [{"type": "timing_test_double"}]}})
    tables, report = timing.run_timed(steps, {"points": spark.range(500)})
    assert [(r.step, r.type, r.table, r.rows) for r in report.collect()] == [(0, "timing_test_double", "doubled", 1000)]
    assert tables["doubled"].count() == 1000 and calls.value == 1000  # no second pass
    total = timing.run_totals(report, 50).first()
    assert total.seconds > 0 and abs(total.seconds_a_frame * 50 - total.seconds) < 1e-3
    assert timing.run_totals(report, 0).first().seconds_a_frame is None


def test_triggers_of_a_stream(spark, tmp_path):
    cuts = [[(START + i, i) for i in range(a, a + 10)] for a in (0, 10, 20)]
    stream = stream_of(spark, tmp_path / "in", cuts, "step_nr long").observe("seen", F.count("*").alias("rows"), F.max("step_nr").alias("last"))
    with timing.StreamTimes(spark) as times:
        q = stream.writeStream.queryName("frames").format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        times.wait_for(q)
    assert [(t.rows, t.observed["seen"]["rows"], t.observed["seen"]["last"]) for t in times.triggers] == [(10, 10, 9), (10, 10, 19), (10, 10, 29)]
    total = times.totals()["frames"]
    assert (total["batches"], total["rows"]) == (3, 30) and total["seconds"] > 0 and total["rows_a_second"] > 0
