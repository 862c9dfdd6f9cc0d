"""The frame loop as a stream: equal to the batch form however the input is cut into triggers."""

import random

import pytest
from pyspark.sql import functions as F

from trailstone.operators import floor
from trailstone.streaming import frames as fr


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def made(n=40, sessions=("a", "b")):
    rng = random.Random(4)
    quaternions = [(0.0, 0.6, 0.0, 0.8), (0.48, 0.36, 0.48, 0.64), (0.5, 0.5, -0.5, 0.5), (0.0, 0.0, 0.0, 1.0)]
    rows = []
    for s in sessions:
        for i in range(n):
            plane = (0.0, 1.0, 0.0, i / 100) if rng.random() < 0.6 else (None,) * 4
            labels = [(rng.randrange(6), rng.choice(["Chair", "Table", "Lamp"])) for _ in range(rng.randrange(3))]
            rows.append((s, 1_700_000_000 + i, i, *plane, *rng.choice(quaternions), labels))
    return rows


SCHEMA = fr.FRAME.replace("ts timestamp", "seconds long")


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("seconds")).drop("seconds")


def plain(rows):
    return sorted((r.session_id, r.step_nr, r.run, r.action, r.nx, r.offset, r.gx, r.gy, r.gz, str(r.labels)) for r in rows)


def streamed(spark, tmp_path, cuts, settings):
    """All rows of the stream, which a frame of a later session pushes out."""
    for i, rows in enumerate([*cuts, [("end", 1_800_000_000, 0, *(None,) * 8, None)], [("end", 1_900_000_000, 1, *(None,) * 8, None)]]):
        table(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:03d}"))
    stream = spark.readStream.schema(table(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out = []
    q = fr.frame_loop(stream, settings).writeStream.outputMode("append").foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return [r for r in out if r.session_id != "end"]


@pytest.mark.parametrize("way", ["one", "each_four", "late", "repeated"])
def test_stream_equals_batch(rocks, tmp_path, way):
    spark, settings = rocks, fr.Settings(every=4, min_frames=3, interval=6, window=8, first=3)
    rows = made(24)
    rows += [("a", 1_700_000_005, 5, 1.0, 0.0, 0.0, 9.0, 0.0, 0.0, 0.0, 1.0, [(1, "Zebra")])] if way == "repeated" else []
    by_time = sorted(rows, key=lambda r: r[1])
    if way == "late":  # within the ten seconds that the watermark allows
        rng = random.Random(9)
        by_time = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 9))
    size = {"one": 100, "each_four": 8, "late": 7, "repeated": 16}[way]
    cuts = [by_time[i : i + size] for i in range(0, len(by_time), size)]
    want = plain(fr.frame_loop_batch(table(spark, rows), settings).collect())
    assert plain(streamed(spark, tmp_path, cuts, settings)) == want and len(want) == 48


def test_batch_form_equals_the_single_operators(spark):
    settings = fr.Settings(every=7, min_frames=3, interval=10)
    rows = [(r[0], r[1], r[2], 0.0, 1.0, 0.0, r[2] / 100, *r[7:]) for r in made(64, ("a",))]
    got = fr.frame_loop_batch(table(spark, rows), settings).orderBy("step_nr").collect()
    assert [(r.step_nr + 1, r.action) for r in got if r.action != "none"] == floor.schedule(64, 3, 10)
    assert [r.step_nr for r in got if r.run] == list(range(0, 64, 7))
    poses = table(spark, rows).select("step_nr", "qx", "qy", "qz", "qw")
    want = {r.step_nr: (r.gx, r.gy, r.gz) for r in floor.gravity(poses).collect()}
    assert all(abs(a - b) < 2e-6 for r in got for a, b in zip((r.gx, r.gy, r.gz), want[r.step_nr], strict=True))
    known = {}
    for r, row in zip(got, sorted(rows, key=lambda x: x[2]), strict=True):
        for segment in {s for s, _ in row[-1]}:
            known[segment] = max(label for s, label in row[-1] if s == segment)
        assert {x.segment_id: x.class_label for x in r.labels} == known
