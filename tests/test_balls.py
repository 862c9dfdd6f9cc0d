"""Keyframe retrieval down the tree of balls."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailstone.operators import balls, graph, tiles


def clustered(spark, n=6000, centres=40, dim=24, spread=0.02, seed=3):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    x = c[rng.integers(centres, size=n)] + spread * rng.normal(size=(n, dim))
    ids = np.sort(rng.choice(10 * n, n, replace=False))
    return ids, x, spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "keyframe_id long, embedding array<double>")


def brute(ids, x, k, threshold):
    out = set()
    for i in range(len(ids)):
        s = np.round(x[:i] @ x[i], 6)
        order = np.argsort(-s, kind="stable")[:k]
        out |= {(int(ids[i]), int(ids[j]), float(s[j])) for j in order if s[j] > threshold}
    return out


def test_clustered_descriptors_meet_few_block_pairs(spark):
    ids, x, frame = clustered(spark)
    found, pairs = balls.retrieve_by_balls(frame, 3, 5e-3, block=32)
    assert {tuple(r) for r in found.collect()} == brute(ids, x, 3, 5e-3)
    blocks = pairs.select("b").distinct().count()
    queries = pairs.select("q").distinct().count()
    assert queries >= 6000 / 32 and pairs.count() < 0.1 * queries * max(blocks, 6000 // 32)


@pytest.mark.parametrize("kind", ["even", "same", "positive", "one"])
def test_any_descriptors(spark, kind):
    rng = np.random.default_rng(1)
    x = {"even": rng.normal(size=(300, 6)), "same": np.tile([[0.6, 0.8]], (200, 1)), "positive": rng.uniform(0.5, 1, (250, 5)), "one": np.ones((1, 3))}[kind]
    ids = np.arange(len(x)) * 3
    frame = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)] + [(10**6, None)], "keyframe_id long, embedding array<double>")
    found, _ = balls.retrieve_by_balls(frame, 2, 0.1, block=8)
    assert {tuple(r) for r in found.collect()} == brute(ids, x, 2, 0.1)
    assert balls.retrieve_by_balls(frame.limit(0), 2)[0].count() == 0


def test_runs_don_t_meet(spark):
    ids, x, frame = clustered(spark, n=400, centres=5)
    both = frame.withColumn("session_id", F.lit("a")).unionByName(frame.withColumn("session_id", F.lit("b")))
    got = graph.retrieve(both, 2, 5e-3, by=["session_id"], block=16, few=0)
    want = brute(ids, x, 2, 5e-3)
    assert {tuple(r) for r in got.select("session_id", "keyframe_id", "match_id", "similarity").collect()} == {(s, *w) for s in "ab" for w in want}


@pytest.mark.parametrize("kind", ["even", "copies"])
def test_tiles_find_what_all_pairs_hold(kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 9)) if kind == "even" else rng.normal(size=(40, 9))[rng.integers(40, size=3000)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(3000) * 7
    q, m, s = tiles.best_earlier(x, ids, x, ids, 3, 5e-3)
    assert {(int(ids[a]), int(ids[b]), float(c)) for a, b, c in zip(q, m, s, strict=True)} == brute(ids, x, 3, 5e-3)


def test_a_vector_goes_to_a_bounded_number_of_groups(spark):
    for n in (1, 5000, 100_000, 1 << 20):
        for block in (8, 512):
            assert n / (block * tiles.tile_size(n, block)) <= tiles.TILES
    assert tiles.tile_size(1 << 30, 512) * 512 == tiles.MOST
    ids, x, frame = clustered(spark, n=3000, centres=3000, spread=1.0)
    for how in ({"block": 8}, {"block": 8, "few": 0}):  # in 375 blocks: 70,500 pairs of them
        found = graph.retrieve(frame, 3, 5e-3, **how)
        assert {tuple(r) for r in found.collect()} == brute(ids, x, 3, 5e-3)
