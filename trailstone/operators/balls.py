"""Exact retrieval of similar earlier keyframes down a tree of balls over descriptor blocks.

Descriptors are dealt to cells, each to the nearest of a bounded number of pivots (far from each other among a bounded
sample) and, where that leaves cells of many blocks, by the signs of projections on fixed random directions. A cell's
keyframes are cut, in the order of their ids, into blocks. A block is a ball (centre, radius), and so is a tile of
neighbouring blocks (`tiles.py`: a bounded number of tiles until they are full). Two balls hold no pair more similar than

    <c, d> + r |d| + s |c| + r s

A first round compares each block with itself and the one before it in its cell, which gives nearly all keyframes k good
matches. These then ask the tree as the block they are in, with the least of their k-th similarities as what a ball must
reach: tiles of queries meet the tiles that can hold a match, and within such a pair slabs of queries meet the blocks that
can; keyframes with fewer or far worse matches than the rest of their block (the first of a cell, outliers) are put into
blocks of their own, so that they don't lower what others ask for. Only pairs of blocks that the tree leaves are
multiplied. Where descriptors don't cluster that is nearly all of them, but a vector still goes to no more groups than
there are tiles. Nothing is approximate: pivots and directions decide how much is left out, not what is found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.staging import written
from . import tiles
from .ordered import with_ordinal

#: Pivots at most, blocks of a cell about, and queries of a slab at least.
PIVOTS, CELL, SLAB = 512, 4, 128
#: Bytes of the sample that pivots are chosen from, at most, and its rows for each pivot.
SAMPLE_BYTES, SAMPLE = 1 << 24, 8
#: More than rounding to six digits and the bounds' own arithmetic can take from a similarity.
SLIP = 2e-6


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    """A column of packed vectors as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _one(column: pa.Array, i: int, dim: int) -> np.ndarray:
    return np.frombuffer(column[i].as_buffer(), np.float64).reshape(-1, dim)


def ball_of(x: np.ndarray, radii: np.ndarray | float = 0.0) -> tuple[np.ndarray, float]:
    """Centre and radius of a ball around points, or around balls with these centres and radii."""
    centre = x.mean(0)
    return centre, float((np.linalg.norm(x - centre, axis=1) + radii).max()) * (1 + 1e-12)


def choose_pivots(x: np.ndarray, most: int) -> np.ndarray:
    """Rows of x that are far from each other, neighbours in the result near each other."""
    chosen, near = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(most, len(x)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    left = x[chosen]
    d = ((left**2).sum(1)[:, None] + (left**2).sum(1) - 2 * left @ left.T) if len(left) > 1 else np.zeros((1, 1))
    order, open_ = [0], np.ones(len(left), bool)
    open_[0] = False
    while open_.any():
        order.append(int(np.where(open_, d[order[-1]], np.inf).argmin()))
        open_[order[-1]] = False
    return left[order]


def _coded(pivots: np.ndarray, directions: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column("e").flatten(), np.float64).reshape(batch.num_rows, -1)
                cell = ((pivots**2).sum(1) - 2 * x @ pivots.T).argmin(1)
                bits = ((x - pivots[cell]) @ directions.T > 0).astype(np.int64)
                code = (cell << len(directions)) + bits @ (np.int64(1) << np.arange(len(directions), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(code), pa.array([r.tobytes() for r in x], pa.binary())], [*batch.schema.names[:-1], "code", "v"])

    return run


def _packed(dim: int, keep: list[str]):
    """Groups of (keyframe_id, v, kth) as one row each: ids, vectors back to back, ball, and what a match must reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"e": [], "centre": [], "radius": [], "floor": []}
            for i in range(batch.num_rows):
                x = _rows(batch.column("vs")[i].values, dim)
                centre, radius = ball_of(x)
                known = np.asarray(batch.column("kth")[i].values, np.float64)
                for name, value in zip(out, (x.tobytes(), centre.tobytes(), radius, float(known.min())), strict=True):
                    out[name].append(value)
            kinds = {"e": pa.binary(), "centre": pa.binary(), "radius": pa.float64(), "floor": pa.float64()}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(v, kinds[n]) for n, v in out.items())], [*keep, *out])

    return run


def _above(dim: int, names: list[str], least: str):
    """The ball around the balls of a group, with the least of a column."""

    def run(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1)
        centre, radius = ball_of(_rows(table.column("centre").combine_chunks(), dim), np.asarray(table.column("radius")))
        columns = {c: first.column(c) for c in names if c not in ("centre", "radius", least)}
        return pa.table(columns | {"centre": pa.array([centre.tobytes()], pa.binary()), "radius": pa.array([radius]), least: pa.array([min(table.column(least).to_pylist())], table.schema.field(least).type)})

    return run


def _most(c: np.ndarray, r: np.ndarray, d: np.ndarray, s: np.ndarray) -> np.ndarray:
    """More than any similarity between balls around c and balls around d, all against all."""
    most = c @ d.T + r[:, None] * np.linalg.norm(d, axis=1) + np.linalg.norm(c, axis=1)[:, None] * s + r[:, None] * s
    return most + SLIP + 1e-9 * np.abs(most)


def _reach(dim: int):
    """Pairs of a tile of queries and a tile that may hold a match for one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, d = _rows(batch.column("centre"), dim), _rows(batch.column("other"), dim)
            r, s = np.asarray(batch.column("radius")), np.asarray(batch.column("other_radius"))
            most = [float(_most(c[i : i + 1], r[i : i + 1], d[i : i + 1], s[i : i + 1])[0, 0]) for i in range(len(c))]
            keep = pa.array(np.asarray(most) >= np.asarray(batch.column("floor")))
            yield batch.select([n for n in batch.schema.names if n not in ("centre", "radius", "floor") and not n.startswith("other")]).filter(keep)

    return run


def _met(queries: pa.Table, matches: pa.Table, dim: int, block: int, multiplied: bool, k: int, threshold: float, by: list[str]) -> pa.Table:
    """Of two tiles the matches found, or the pairs of blocks that are multiplied for them."""
    queries, matches = queries.sort_by("q"), matches.sort_by("b")
    few = len(queries) == 0 or len(matches) == 0
    first = queries if len(queries) else matches
    kind = first.schema.field("ids").type.value_type
    size_q, size_m = (np.asarray(t.column("ids").combine_chunks().value_lengths()) for t in (queries, matches))
    of_q, of_m = np.repeat(np.arange(len(size_q)), size_q), np.repeat(np.arange(len(size_m)), size_m)
    (c, r), (d, s) = ((tiles.rows_of(t.column("centre"), dim), np.asarray(t.column("radius"))) for t in (queries, matches))
    floor, lo, hi = np.asarray(queries.column("floor")), np.asarray(matches.column("lo")), np.asarray(queries.column("hi"))

    def blocks(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        own = np.unique(of_q[i:j])
        return own, ((_most(c[own], r[own], d, s) >= floor[own, None]) & (lo < hi[own, None])).any(0)

    slab = max(1, SLAB // block) * block
    keys = lambda n: [pa.array(first.column(x).to_pylist()[:1] * n, first.schema.field(x).type) for x in by]
    if multiplied:
        pairs = [np.stack(np.meshgrid(own, np.flatnonzero(some), indexing="ij")).reshape(2, -1) for own, some in (blocks(i, min(i + slab, len(of_q))) for i in range(0, 0 if few else len(of_q), slab))]
        q, m = np.concatenate(pairs, 1) if pairs else np.empty((2, 0), np.int64)
        q, m = np.unique(np.stack([np.asarray(queries.column("q"))[q], np.asarray(matches.column("b"))[m]]), axis=1)
        return pa.table([*keys(len(q)), pa.array(q, pa.int64()), pa.array(m, pa.int64())], [*by, "q", "b"])
    ids, other = (np.asarray(t.column("ids").combine_chunks().flatten()) for t in (queries, matches))
    q, m, s_ = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    if not few:
        q, m, s_ = tiles.best_earlier(tiles.rows_of(queries.column("e"), dim), ids, tiles.rows_of(matches.column("e"), dim), other, k, threshold, floor[of_q], lambda i, j: blocks(i, j)[1][of_m], slab)
    return pa.table([*keys(len(q)), pa.array(ids[q], kind), pa.array(other[m], kind), pa.array(s_, pa.float64())], [*by, "keyframe_id", "match_id", "similarity"])


def _compare(dim: int, k: int, threshold: float, by: list[str]):
    """The best k matches of each query among the earlier keyframes of the other block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                queries, matches = (np.asarray(batch.column(c)[i].values) for c in ("ids_q", "ids"))
                s = np.round(_one(batch.column("e_q"), i, dim) @ _one(batch.column("e"), i, dim).T, 6)
                s[(s <= threshold) | (matches[None] >= queries[:, None])] = -np.inf
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]  # matches are in the order of their ids
                found = np.take_along_axis(s, top, 1)
                q, r = np.nonzero(found > -np.inf)
                keys = [batch.column(c).take(pa.array(np.full(len(q), i))) for c in by]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(queries[q]), pa.array(matches[top[q, r]]), pa.array(found[q, r])], [*by, "keyframe_id", "match_id", "similarity"])

    return run


def retrieve_by_balls(descriptors: DataFrame, k: int = 3, threshold: float = 5e-3, by: Sequence[str] = (), block: int = 512) -> tuple[DataFrame, DataFrame]:
    """What `graph.retrieve` gives, and the pairs of blocks (of queries and of matches) that were multiplied for it."""
    by, spark = list(by), descriptors.sparkSession
    types = dict(descriptors.dtypes)
    keys = ", ".join([*(f"{c} {types[c]}" for c in by), f"keyframe_id {types['keyframe_id']}"])
    of_run = ", ".join(f"{c} {types[c]}, " for c in by).replace(", ,", ",").strip()
    given = descriptors.where("embedding IS NOT NULL").select(*by, "keyframe_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    about = given.agg(F.count("*").alias("n"), F.max(F.size("e")).alias("dim")).first()
    found_schema = f"{keys}, match_id {types['keyframe_id']}, similarity double"
    if not about["n"]:
        return spark.createDataFrame([], found_schema), spark.createDataFrame([], "n long")
    n, dim = about["n"], about["dim"]
    cells = max(1, n // (CELL * block))
    most = max(1, min(cells, PIVOTS, SAMPLE_BYTES // (8 * dim * SAMPLE)))
    sample = given.orderBy(F.xxhash64("keyframe_id", *by), "keyframe_id").limit(most * SAMPLE).select("e").toPandas()["e"]  # SAMPLE_BYTES at most
    pivots = choose_pivots(np.stack(sample.to_list()).astype(np.float64), most)
    bits = min(30, math.ceil(math.log2(max(1.0, cells / len(pivots)))))
    coded = given.mapInArrow(_coded(pivots, np.random.default_rng(7).standard_normal((bits, dim))), f"{keys}, code long, v binary")
    placed = written(with_ordinal(coded, "keyframe_id", by=[*by, "code"]).withColumn("part", F.expr(f"i DIV {block}")).drop("i"), "placed")
    one = F.sort_array(F.collect_list(F.struct("keyframe_id", "v", F.lit(threshold).alias("kth"))))
    inside = [*by, "code", "part"]

    def packed(groups: DataFrame, group: list[str]) -> DataFrame:
        """One row a group; lo and hi are its first and last id."""
        lists = groups.select(*group, F.col("rows.keyframe_id").alias("ids"), F.col("rows.v").alias("vs"), F.col("rows.kth").alias("kth"))
        lists = lists.withColumns({"lo": F.element_at("ids", 1), "hi": F.element_at("ids", -1)})
        kept = [*group, "ids", "lo", "hi"]
        kinds = dict(lists.dtypes)
        return lists.mapInArrow(_packed(dim, kept), ", ".join(f"{c} {kinds[c]}" for c in kept) + ", e binary, centre binary, radius double, floor double")

    blocks = packed(placed.groupBy(*inside).agg(one.alias("rows")), inside)
    blocks = written(with_ordinal(blocks, "code", "part", name="b", by=by), "blocks")

    def compared(pairs: DataFrame) -> DataFrame:
        return pairs.mapInArrow(_compare(dim, k, threshold, by), found_schema)

    asking = blocks.select(*inside, F.col("ids").alias("ids_q"), F.col("e").alias("e_q"), F.explode(F.array("part", F.col("part") - 1)).alias("other"))
    at_home = asking.drop("part").withColumnRenamed("other", "part").join(blocks.select(*inside, "ids", "e"), inside)
    home = written(compared(at_home), "home")
    best = Window.partitionBy(*by, "keyframe_id").orderBy(F.desc("similarity"), "match_id")
    home = written(home.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k), "home")
    kth = home.where(F.col("r") == k).select(*by, "keyframe_id", F.col("similarity").alias("kth"))

    # blocks of queries: those with good matches where they lie, the others by themselves in the order of their ids
    asked = written(placed.join(blocks.select(*inside, "b"), inside).join(kth, [*by, "keyframe_id"], "left").select(*by, "keyframe_id", "v", "kth", "b"), "asked")
    usual = asked.groupBy(*by, "b").agg(F.median("kth").alias("usual"))
    asked = written(asked.join(usual, [*by, "b"]).withColumn("good", F.coalesce(F.col("kth") >= 0.9 * F.col("usual"), F.lit(False))), "asked")
    few = with_ordinal(asked.where("NOT good"), "keyframe_id", by=by).select(*by, "keyframe_id", "v", F.coalesce("kth", F.lit(threshold)).alias("kth"), (-1 - F.expr(f"i DIV {block}")).alias("q"))
    groups = asked.where("good").select(*by, "keyframe_id", "v", "kth", F.col("b").alias("q")).unionByName(few)
    queries = packed(groups.groupBy(*by, "q").agg(F.sort_array(F.collect_list(F.struct("keyframe_id", "v", "kth"))).alias("rows")), [*by, "q"])
    queries = written(queries, "queries")

    # tiles of queries and of blocks as balls, and the pairs of them that may hold a match
    of_tile = tiles.tile_size(n, block)
    queries = queries.withColumn("qt", F.expr(f"CASE WHEN q < 0 THEN -1 - (-1 - q) DIV {of_tile} ELSE q DIV {of_tile} END"))
    blocks = blocks.withColumn("bt", F.expr(f"b DIV {of_tile}"))

    def balls(rows: DataFrame, tile: str, extra: str) -> DataFrame:
        names = [*by, tile, "centre", "radius", extra]
        kind = types["keyframe_id"] if extra == "lo" else "double"
        return rows.select(*names).groupBy(*by, tile).applyInArrow(_above(dim, names, extra), f"{of_run} {tile} long, centre binary, radius double, {extra} {kind}".strip(", "))

    other = balls(blocks, "bt", "lo").select(*by, "bt", F.col("centre").alias("other"), F.col("radius").alias("other_radius"))
    asks = balls(queries, "qt", "floor")
    met = asks.join(other, by) if by else asks.crossJoin(other)
    met = met.select(*by, "qt", "bt", "centre", "radius", "floor", "other", "other_radius")
    met = written(met.mapInArrow(_reach(dim), f"{of_run} qt long, bt long".strip(", ")), "met")
    group = [*by, "qt", "bt"]
    left = queries.join(met, [*by, "qt"]).select(*group, "q", "ids", "hi", "floor", "centre", "radius", "e")
    right = blocks.join(met, [*by, "bt"]).select(*group, "b", "ids", "lo", "centre", "radius", "e")

    def meeting(multiplied: bool, schema: str) -> DataFrame:
        run = lambda q, m: _met(q, m, dim, block, multiplied, k, threshold, by)
        return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(run, schema)

    pairs = meeting(True, f"{of_run} q long, b long".strip(", "))
    away = meeting(False, found_schema)
    every = home.drop("r").unionByName(away).distinct()
    return every.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r"), pairs
