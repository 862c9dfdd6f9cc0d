"""Order-dependent work over one long sequence, spread over ranges of it: ordinals, overlapping blocks, running values.

Rows are cut into contiguous ranges by Spark's range partitioning and written with the number of their range, so that
everything that reads them later sees the same cut. What passes from range to range is one row a range.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window

from ..plans.staging import written

#: Rows of a sequence that one window of `in_blocks` sees, apart from its overlap.
BLOCK = 4096
#: Rows that one fold of `running` goes through.
SCAN = 256


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """The rows with the number of their range (_range); rows equal in `order` share one."""
    return written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")


def with_ordinal(df: DataFrame, *order: str, name: str = "i", by: Sequence[str] = ()) -> DataFrame:
    """0-based position by `order` among the rows of equal `by`, counted within ranges and offset by what lies before them.

    With `by`, a range's first key alone may go on from the ranges before it, so there are fewer offsets than ranges.
    """
    cut = ranged(df, *by, *order)
    local = cut.withColumn("_n", F.row_number().over(Window.partitionBy("_range", *by).orderBy(*order)) - 1)
    sizes = cut.groupBy("_range", *by).agg(F.count("*").alias("_size"))  # one row a range and key
    before = F.sum("_size").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(F.col("_range").alias("_of"), *(F.col(c).alias(f"_by_{c}") for c in by), before.alias("_before")).where("_before IS NOT NULL")
    same = F.col("_range") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    out = local.join(F.broadcast(offsets), same, "left").withColumn(name, F.col("_n") + F.coalesce("_before", F.lit(0).cast("long")))
    return out.drop("_range", "_n", "_before", "_of", *(f"_by_{c}" for c in by))


def over_recent(df: DataFrame, order: str, before: int, name: str, value: Column, block: int = BLOCK, by: Sequence[str] = ()) -> DataFrame:
    """df with `value`, an aggregate over each row and the `before` rows ahead of it in `order`, of the same `by`.

    A block of the sequence holds the last rows of the block ahead of it too, so that each block is a window of its own.
    """
    block = max(block, before)
    numbered = with_ordinal(df, *by, order, name="_i")
    own = F.floor(F.col("_i") / block)
    lent = F.when(F.col("_i") % block >= block - before, F.array(own, own + 1)).otherwise(F.array(own))
    recent = Window.partitionBy("_block", *by).orderBy("_i").rowsBetween(-before, 0)
    out = numbered.withColumn("_block", F.explode(lent)).withColumn(name, value.over(recent))
    return out.where(F.col("_block") == own).drop("_block", "_i")


def last_so_far(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """df with `value` replaced by the last one that isn't null among the row and those ahead of it of the same `by`.

    A key's rows may fill any number of ranges: each range hands its last value and key to those behind it.
    """
    cut = ranged(df, *by, *order)
    so_far = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = cut.where(F.col(value).isNotNull())
    tails = found.groupBy("_range").agg(F.max_by(F.struct(*by, F.col(value).alias("_handed")), F.struct(*by, *order)).alias("_tail"))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    handed = cut.select("_range").distinct().join(tails, "_range", "left").select("_range", F.last("_tail", ignorenulls=True).over(ahead).alias("_tail"))
    out = cut.withColumn(value, F.last(value, ignorenulls=True).over(so_far)).join(F.broadcast(handed), "_range")
    same = F.lit(True)
    for key in by:
        same = same & F.col(f"_tail.{key}").eqNullSafe(F.col(key))
    return out.withColumn(value, F.coalesce(value, F.when(same, F.col("_tail._handed")))).drop("_range", "_tail")


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], state: Column, combine: Callable[[Column, Column], Column], name: str = "so_far", block: int = SCAN) -> DataFrame:
    """df with `name`: the states of all rows up to and with each one (of equal `by`, in `order`), put together by `combine`.

    `combine(earlier, later)` may be any associative function of two states; it needn't commute, and has no neutral element.
    Positions are cut into blocks of `block` rows, each is folded as an array, and the blocks' totals are a sequence of
    the same kind, `block` times shorter, that the function calls itself for: a hot key is folded by as many tasks as it
    has blocks, and what passes from block to block is one state. Of rows equal in `order` any may come first.
    """
    payload = F.struct(*(F.col(c) for c in df.columns))
    keys = [f"_key{k}" for k in range(len(by))]
    given = df.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), *(F.col(c).alias(f"_order{k}") for k, c in enumerate(order)), payload.alias("_row"), state.alias("_state"))
    placed = with_ordinal(given, *(f"_order{k}" for k in range(len(order))), name="_i", by=keys)
    placed = written(placed.select(*keys, "_i", "_row", "_state"), "states")
    return _scanned(placed, keys, combine, block).select("_row.*", F.col("_state").alias(name))


def _scanned(placed: DataFrame, keys: list[str], combine: Callable[[Column, Column], Column], block: int) -> DataFrame:
    """Rows of (keys, _i, _row, _state) with the states up to each; positions count from 0 within equal keys."""
    kind = placed.schema["_state"].dataType
    none = F.lit(None).cast(kind)
    items = F.sort_array(F.collect_list(F.struct("_i", "_state", "_row")))
    blocks = placed.groupBy(*keys, F.expr(f"_i DIV {block}").alias("_j")).agg(items.alias("_items"))
    start = F.struct(F.array().cast(ArrayType(kind)).alias("all"), none.alias("last"))

    def step(so_far: Column, item: Column) -> Column:
        now = F.when(so_far["last"].isNull(), item["_state"]).otherwise(combine(so_far["last"], item["_state"]))
        return F.struct(F.concat(so_far["all"], F.array(now)).alias("all"), now.alias("last"))

    folded = written(blocks.withColumn("_fold", F.aggregate("_items", start, step)).select(*keys, "_j", "_items", F.col("_fold.all").alias("_all"), F.col("_fold.last").alias("_last")), "folded")
    last = folded.agg(F.max("_j")).first()[0] or 0
    ahead = none
    if last:
        totals = folded.select(*keys, F.col("_j").alias("_i"), F.lit(None).cast("string").alias("_row"), F.col("_last").alias("_state"))
        above = _scanned(totals, keys, combine, block).select(*(F.col(k).alias(f"{k}_") for k in keys), (F.col("_i") + 1).alias("_j_"), F.col("_state").alias("_ahead"))
        same = F.col("_j") == F.col("_j_")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
        folded, ahead = folded.join(written(above, "totals"), same, "left"), F.col("_ahead")
    whole = folded.select(*keys, ahead.alias("_ahead"), F.explode(F.arrays_zip("_items", "_all")).alias("_it"))
    now = F.when(F.col("_ahead").isNull(), F.col("_it._all")).otherwise(combine(F.col("_ahead"), F.col("_it._all")))
    return whole.select(*keys, F.col("_it._items._i").alias("_i"), F.col("_it._items._row").alias("_row"), now.alias("_state"))
