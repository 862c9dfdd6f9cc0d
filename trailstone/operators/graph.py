"""Keyframe retrieval and graph edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import written
from . import tiles
from .balls import retrieve_by_balls
from .ordered import with_ordinal

#: Keyframes that one block of the comparison holds; blocks up to which all pairs of them cost less than a tree.
BLOCK, FEW_BLOCKS = 512, 2048


def retrieve(descriptors: DataFrame, k: int = 3, threshold: float = 5e-3, by: Sequence[str] = (), block: int = BLOCK, few: int = FEW_BLOCKS) -> DataFrame:
    """keyframe_id, match_id, similarity: for each keyframe the k most similar earlier ones (of the same `by`).

    Exact at every size: long sequences go down a tree of balls (`balls.retrieve_by_balls`), short ones are compared tile by
    tile of the sequence (`tiles.in_order`); only the best k of each keyframe come out of a pair of tiles to meet those of
    other pairs. Blocks are cut by position, so ids may have gaps of any size; embeddings are as long as each other,
    keyframes without one are left out.
    """
    given = descriptors.where("embedding IS NOT NULL")
    n, dim = given.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if n > few * block:
        return retrieve_by_balls(descriptors, k, threshold, by, block)[0]
    types = dict(descriptors.dtypes)
    keys = "".join(f"{c} {types[c]}, " for c in by)
    kind = types["keyframe_id"]
    placed = with_ordinal(given.select(*by, "keyframe_id", "embedding"), "keyframe_id", by=by)
    one = F.struct("keyframe_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    rows = placed.groupBy(*by, F.expr(f"i DIV {block}").alias("block")).agg(F.sort_array(F.collect_list(one)).alias("rows"))
    lists = rows.select(*by, "block", F.col("rows.keyframe_id").alias("ids"), F.flatten("rows.e").alias("e"))
    blocks = written(lists.mapInArrow(tiles.packed, f"{keys}block long, ids array<{kind}>, e binary"), "blocks")
    found = tiles.in_order(blocks, k, threshold, by, dim or 1, tiles.tile_size(n, block), f"{keys}keyframe_id {kind}, match_id {kind}, similarity double")
    return tiles.best(found, k, by)


def consecutive(descriptors: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """src, dst: each keyframe with the one before it, whatever ids are missing between them."""
    placed = written(with_ordinal(descriptors.select(*by, "keyframe_id"), "keyframe_id", by=by), "placed")
    before = placed.select(*by, (F.col("i") + 1).alias("i"), F.col("keyframe_id").alias("dst"))
    return placed.join(before, [*by, "i"]).select(*by, F.col("keyframe_id").alias("src"), "dst")


def edges(descriptors: DataFrame, k: int = 3, threshold: float = 5e-3, by: Sequence[str] = ()) -> DataFrame:
    found = retrieve(descriptors, k, threshold, by).select(*by, F.col("keyframe_id").alias("src"), F.col("match_id").alias("dst"))
    return consecutive(descriptors, by).unionByName(found).where("src <> dst").distinct()


def loop_closures(descriptors: DataFrame, k: int = 3, threshold: float = 5e-3, by: Sequence[str] = ()) -> DataFrame:
    """Retrieved edges that don't join a keyframe with the one before it."""
    found = retrieve(descriptors, k, threshold, by).select(*by, F.col("keyframe_id").alias("src"), F.col("match_id").alias("dst"))
    return found.join(consecutive(descriptors, by), [*by, "src", "dst"], "left_anti")
