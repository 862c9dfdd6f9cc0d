import random

import pytest
from pyspark.sql import functions as F

from trailstone.operators import align, asof, ordered


@pytest.fixture
def many_ranges(spark):
    """Small ranges stay apart, as they would where they are large."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_values_pass_from_range_to_range(many_ranges):
    rnd = random.Random(1)
    key = lambda: rnd.choice(["hot"] * 8 + ["a", "b", None])
    left = [(i, key(), rnd.choice([None, *range(200)])) for i in range(300)]
    right = [(key(), rnd.randrange(200), o, f"v{o}") for o in range(40)]
    joined = asof.asof_join(many_ranges.createDataFrame(left, "id long, k string, t long"), many_ranges.createDataFrame(right, "k string, t long, o long, v string"), "t", ["k"], ["v"], tie="o")
    got = {r.id: r.v for r in joined.collect()}
    for i, k, t in left:
        before = [(r[1], r[2], r[3]) for r in right if t is not None and r[0] == k and r[1] <= t]
        assert got[i] == (max(before)[2] if before else None)
    cut = ordered.ranged(many_ranges.createDataFrame(left, "id long, k string, t long"), "k", "t")
    assert cut.where("k = 'hot'").select("_range").distinct().count() > 2


def test_a_value_crosses_ranges_without_any(many_ranges):
    left = many_ranges.range(1000).select(F.col("id").alias("t"))
    right = many_ranges.createDataFrame([(3, "x")], "t long, v string")
    got = {r.t: r.v for r in asof.asof_join(left, right, "t", values=["v"]).collect()}
    assert got == {t: "x" if t >= 3 else None for t in range(1000)}


@pytest.mark.parametrize(("before", "block"), [(1, 7), (29, 30), (5, 3), (0, 10)])
def test_recent_rows_cross_blocks_and_ranges(many_ranges, before, block):
    steps = list(range(0, 400, 2))
    random.Random(before).shuffle(steps)
    df = many_ranges.createDataFrame([(s, "kept") for s in steps], "s long, x string")
    got = {r.s: r.near for r in ordered.over_recent(df, "s", before, "near", F.collect_list("s"), block).collect()}
    steps.sort()
    assert got == {s: steps[max(0, i - before) : i + 1] for i, s in enumerate(steps)}


def test_ordinals_count_on_over_ranges_and_empty_tables(many_ranges):
    df = many_ranges.range(500).select((F.col("id") * 7 % 500).alias("k"))
    assert all(r.k == r.i for r in ordered.with_ordinal(df, "k").collect())
    none = df.where("k < 0")
    assert ordered.with_ordinal(none, "k").count() == ordered.over_recent(none, "k", 3, "n", F.count("*")).count() == 0
    assert asof.asof_join(none, none.withColumn("v", F.lit(1)), "k", values=["v"]).count() == 0


def test_snapshots_in_many_ranges(many_ranges):
    poses = many_ranges.range(301).select(F.col("id").alias("step_nr"))
    snaps = [9, 40, 41, 120, 299]
    got = {r.step_nr: r.snapshot_step for r in align.nearest_snapshot(poses, many_ranges.createDataFrame([(s,) for s in snaps], "snapshot_step long")).collect()}
    for i in range(301):
        at = int(9 + i / 300 * 290)
        assert got[i] == min(snaps, key=lambda s: (abs(s - at), s))
