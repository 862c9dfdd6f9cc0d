"""Hard-negative mining: anchor spanning-tree bounds decide which candidates are scored.

Anchors are put in blocks of BLOCK that lie near each other (by the signs of their components), and each block gets a
minimum spanning tree by distance. The score of a candidate c at a child anchor is its score at the parent plus or minus the
length of the edge times the candidate's length, so an interval of scores comes down the tree with every candidate: at
an anchor only those candidates are scored whose interval meets a window in which the anchor still looks for rows, and a
score makes the interval a point again. A window's lower end is raised, before anything is scored, to the k-th greatest
lower end of the intervals inside it, and after the candidates with the greatest upper ends have been scored, to the k-th
best of those.

The same search runs twice: for each anchor's first rows of its own label (one window without ends), and for the first
rows of other labels in the window of each of those positives. Anchors are the query set and meet all candidates in
blocks: a slice of candidates and a block of anchors make one group, both sides of bounded size, and only the first k of
each window leave it. Copies of a row, hot labels and hot regions are dealt out by a hash of the row's number.

Scores are exact: components are whole numbers below 2^31, and products are summed as doubles where they stay below 2^52,
as 64-bit integers elsewhere. Bounds are widened by more than what rounding can take from them.

Defined cases: a row with a null label, a null vector, a null or non-finite component, or a squared length of 2^62 or more
takes no part; shorter vectors count as filled up with zeros; rows that repeat, or share an id, are rows of their own and
may be each other's positives; rows without an id are no anchors and come last among equal scores; other columns of the
input don't matter; an empty table, one without anchors, or one of a single label gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ordered import with_ordinal
from .common import staged

#: Anchors of a block; bytes of a slice of candidates at most, and its rows at least where there are tasks enough.
BLOCK, SLICE_BYTES, LEAST_SLICE = 1024, 1 << 25, 1 << 11
#: Candidates that are scored first to find out how good the k-th best is.
PROBE = 64
_NO_ID = np.iinfo(np.int64).max


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A column of packed int64 vectors as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, dim)


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimum spanning tree's rows from the root down, each one's parent (-1: none) and the length of the edge to it."""
    n = len(x)
    x = x.astype(np.float64)
    near, parent = np.full(n, np.inf), np.full(n, -1)
    left = np.ones(n, bool)
    order, length = np.empty(n, np.int64), np.zeros(n)
    at = 0
    for k in range(n):
        order[k], left[at] = at, False
        length[at] = 0.0 if k == 0 else near[at]
        d = np.sqrt(((x - x[at]) ** 2).sum(1))
        closer = left & (d < near)
        near[closer], parent[closer] = d[closer], at
        at = int(np.where(left, near, np.inf).argmin())
    return order, parent, length


def _trees(dim: int):
    """A block of anchors: seats in the order of its tree."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        order, parent, length = spanning_tree(_matrix(table.column("v").chunk(0), dim))
        seat = np.empty(len(order), np.int64)
        seat[order] = np.arange(len(order))
        up = np.where(parent < 0, -1, seat[parent])
        return table.append_column("seat", pa.array(seat.astype(np.int32))).append_column("parent", pa.array(up.astype(np.int32))).append_column("edge", pa.array(length))

    return run


class Slice:
    """Candidates with their exact scores against any anchor no longer than `reach`."""

    def __init__(self, v: np.ndarray, row: np.ndarray, ids: np.ndarray, label: np.ndarray, reach: float):
        self.row, self.ids, self.label, self.scored = row, ids, label, 0
        self.length = np.sqrt((v.astype(np.float64) ** 2).sum(1))
        small = len(v) == 0 or self.length.max() * reach < 2**52
        self.v = v.astype(np.float64) if small else v
        self.rounding = 0.0 if small else 2.0**-51  # what a whole number may lose as a double, as a share of it

    def scores(self, anchor: np.ndarray, at: np.ndarray) -> np.ndarray:
        self.scored += len(at)
        a = anchor.astype(self.v.dtype)
        found = (self.v @ a)[at] if 2 * len(at) > len(self.v) else self.v[at] @ a
        return found.astype(np.int64)


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k greatest scores, ties by smaller id."""
    part = np.flatnonzero(score >= np.partition(score, -k)[-k]) if len(score) > 4 * k else np.arange(len(score))
    return part[np.lexsort((ids[part], -score[part]))[:k]]


class Bounds:
    """What is known of all candidates' scores at one anchor: an interval each, and the score where it has been found."""

    def __init__(self, candidates: Slice, anchor: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.candidates, self.anchor, self.low, self.high = candidates, anchor, low, high
        self.score = np.zeros(len(low), np.int64)
        self.exact = np.zeros(len(low), bool)

    def find(self, at: np.ndarray) -> None:
        at = at[~self.exact[at]]
        self.score[at] = self.candidates.scores(self.anchor, at)
        near = self.score[at].astype(np.float64)
        off = np.abs(near) * self.candidates.rounding
        self.low[at], self.high[at], self.exact[at] = near - off, near + off, True

    def below(self, edge: float) -> tuple[np.ndarray, np.ndarray]:
        """Intervals at an anchor at this distance, wider by more than rounding takes."""
        reach = edge * self.candidates.length
        reach += 1 + 1e-9 * (reach + np.abs(self.low) + np.abs(self.high))
        return self.low - reach, self.high + reach

    def first(self, right: np.ndarray, least: int, most: int, k: int) -> np.ndarray:
        """The places of the first k of the `right` candidates with a score from least to most, which are scored."""
        off = self.candidates.rounding
        floor, roof = least - abs(least) * off, most + abs(most) * off
        meets = np.flatnonzero(right & (self.low <= roof) & (self.high >= floor))

        def raised(meets: np.ndarray, floor: float) -> tuple[np.ndarray, float]:
            sure = self.low[meets][(self.low[meets] >= least + abs(least) * off) & (self.high[meets] <= most - abs(most) * off)]
            floor = max(floor, np.partition(sure, -k)[-k]) if len(sure) >= k else floor
            return meets[self.high[meets] >= floor], floor

        meets, floor = raised(meets, floor)
        if len(meets) > 4 * PROBE:
            self.find(meets[np.argpartition(self.high[meets], -PROBE)[-PROBE:]])
            meets, floor = raised(meets, floor)
        self.find(meets)
        found = meets[(self.score[meets] >= least) & (self.score[meets] <= most)]
        return found[_first(self.score[found], self.candidates.ids[found], k)]


def search_block(candidates: Slice, anchors: list[dict], k: int, same: bool) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, window, candidate, score) of the first k candidates of each window of each anchor of a tree.

    Anchors come from the root down: v, row, label, parent, edge, and windows as a list of (low, high).
    """
    waiting = [0] * len(anchors)
    for a in anchors[1:]:
        waiting[a["parent"]] += 1
    known: dict[int, Bounds] = {}
    for seat, a in enumerate(anchors):
        if seat:
            bounds = Bounds(candidates, a["v"], *known[a["parent"]].below(a["edge"]))
            waiting[a["parent"]] -= 1
            if not waiting[a["parent"]]:
                del known[a["parent"]]
        else:
            bounds = Bounds(candidates, a["v"], *np.zeros((2, len(candidates.row))))
            bounds.find(np.arange(len(candidates.row)))
        right = (candidates.label == a["label"] if same else candidates.label != a["label"]) & (candidates.row != a["row"])
        for w, (least, most) in enumerate(a["windows"]):
            for c in bounds.first(right, least, most, k):
                yield seat, w, int(c), int(bounds.score[c])
        if waiting[seat]:
            known[seat] = bounds


def _search(k: int, same: bool, dim: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int, int]] = []
        if left.num_rows and right.num_rows:
            left, right = left.sort_by("seat").combine_chunks(), right.combine_chunks()
            v = _matrix(left.column("v").chunk(0), dim)
            anchors = [{"v": v[i], **r} for i, r in enumerate(left.select(["row", "label", "parent", "edge", "windows"]).to_pylist())]
            for a in anchors:
                a["windows"] = [(w["low"], w["high"]) for w in a["windows"]]
            row, ids, label = (np.asarray(x) for x in (right.column("row"), right.column("vec_id").fill_null(_NO_ID), right.column("label")))
            reach = float(np.sqrt((v.astype(np.float64) ** 2).sum(1)).max())
            found = list(search_block(Slice(_matrix(right.column("v").chunk(0), dim), row, ids, label, reach), anchors, k, same))
        seat, window, candidate, score = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 4
        names = {"anchor": left.column("row").take(pa.array(seat)), "anchor_id": left.column("vec_id").take(pa.array(seat)), "window": pa.array(window.astype(np.int32)), "row": right.column("row").take(pa.array(candidate)), "vec_id": right.column("vec_id").take(pa.array(candidate)), "score": pa.array(score)}
        return pa.table(names)

    return run


_FOUND = "anchor long, anchor_id long, window int, row long, vec_id long, score long"


def whole_vectors(vectors: DataFrame, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """row, vec_id, label, v: the rows that take part, components as whole numbers floor(scale * x); written, so that numbers stay."""
    x = F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * scale))
    kept = vectors.where(label.isNotNull() & F.col(vector_col).isNotNull())
    kept = kept.where(F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < 2.0**31 / scale)))
    rows = kept.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("v"))
    length = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
    return staged(rows.where(length < 2.0**62).withColumn("row", F.monotonically_increasing_id()), "vectors")


def _pack(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            lengths, values = np.asarray(v.value_lengths()), np.asarray(v.flatten())
            wide = np.zeros((len(v), dim), np.int64)
            wide[np.repeat(np.arange(len(v)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), batch.column("label"), pa.array([r.tobytes() for r in wide], pa.binary())], ["row", "vec_id", "label", "v"])

    return run


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows made by `whole_vectors`.

    A negative's score is from low[0] / low[1] to high[0] / high[1] of its positive's, ends included; `anchor` says which rows are anchors.
    """
    spark = rows.sparkSession
    about = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    many, dim = about["n"], max(1, about["dim"] or 1)
    packed = staged(rows.mapInArrow(_pack(dim), "row long, vec_id long, label long, v binary"), "packed")
    signs = F.array_join(F.transform(F.slice("v", 1, 16), lambda c: F.when(c < 0, "0").otherwise("1")), "")
    near = with_ordinal(rows.where(anchor).select("row", signs.alias("signs")), "signs", "row")
    blocks = packed.join(near.select("row", F.expr(f"CAST(i DIV {BLOCK} AS INT)").alias("block")), "row")
    trees = staged(blocks.groupBy("block").applyInArrow(_trees(dim), "row long, vec_id long, label long, v binary, block int, seat int, parent int, edge double"), "trees")

    tasks = 2 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    slices = max(1, -(-many * 8 * dim // SLICE_BYTES), min(-(-many // LEAST_SLICE), tasks))
    last_block = trees.agg(F.max("block")).first()[0]
    if last_block is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    of_slice = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    of_block = F.explode(F.sequence(F.lit(0), F.lit(last_block))).alias("block")
    dealt = packed.select("*", F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int").alias("slice"), of_block)

    def search(asked: DataFrame, k: int, same: bool) -> DataFrame:
        """The first k of each window over all slices."""
        found = asked.select("*", of_slice).groupBy("slice", "block").cogroup(dealt.groupBy("slice", "block")).applyInArrow(_search(k, same, dim), _FOUND)
        best = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    everything = F.array(F.struct(F.lit(-(2**63)).alias("low"), F.lit(2**63 - 1).alias("high")))
    found = staged(search(trees.withColumn("windows", everything), positives, True), "positives")

    share = lambda x: F.col("score").cast("decimal(20,0)") * F.lit(x)
    divided = lambda x, n: ((x - F.pmod(x, F.lit(n).cast("decimal(20,0)"))) / n).cast("long")  # noqa: E731  rounded down
    least, most = divided(share(low[0]) + (low[1] - 1), low[1]), divided(share(high[0]), high[1])
    windows = found.groupBy(F.col("anchor").alias("row")).agg(F.sort_array(F.collect_list(F.struct("rank", least.alias("low"), most.alias("high")))).alias("windows"))
    asked = trees.join(windows, "row", "left").withColumn("windows", F.coalesce(F.transform("windows", lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high"))), F.array().cast("array<struct<low: bigint, high: bigint>>")))
    mined = search(asked, negatives, False).select("anchor", F.col("window").alias("place"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = found.select("anchor", "anchor_id", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return mined.join(named, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
