"""The best matches of each vector among the earlier ones, tile by tile of their matrix of similarities.

A run's vectors are cut into a bounded number of tiles, of up to MOST vectors each, and each pair of tiles is one group:
a vector goes to as many groups as there are tiles, not to one for each block it meets, so what is shuffled grows with the
vectors until tiles are full. Within a group the products are taken slab by slab; single precision finds what may reach
the best so far, and only that is computed again in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Tiles of a run where tiles aren't full; vectors of a full tile.
TILES, MOST = 16, 1 << 16
#: Rows and columns of a slab.
TALL, WIDE = 1024, 2048
#: More than rounding to six digits can take from a similarity.
SLIP = 2e-6


def tile_size(n: int, block: int, tiles: int = TILES, most: int = MOST) -> int:
    """Blocks of a tile, for n vectors."""
    return max(1, min(-(-n // (block * tiles)), most // block))


def rows_of(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """A column of packed vectors as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def best_earlier(x: np.ndarray, ids: np.ndarray, y: np.ndarray, other: np.ndarray, k: int, threshold: float, known: np.ndarray | None = None, may: Callable[[int, int], np.ndarray] | None = None, tall: int = TALL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in x and in y, and similarities, of the k best matches (similarity, then smaller id) with smaller ids.

    `known` is a similarity that a match must reach as well; `may` gives, of the rows from i to j, the columns that can
    hold a match for any of them. y is in the order of its ids.
    """
    a, b = x.astype(np.float32), y.astype(np.float32)
    dim = x.shape[1]
    long_a, long_b = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(0, len(x), tall):
        j = min(i + tall, len(x))
        columns = np.flatnonzero((other < ids[i:j].max()) if may is None else may(i, j) & (other < ids[i:j].max()))
        floor = np.full(j - i, threshold) if known is None else np.maximum(known[i:j], threshold)
        q, m, s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        start, width = 0, 64  # narrow at first, so that the bounds are good when slabs get wide
        while start < len(columns):
            c = columns[start : start + width]
            start, width = start + width, min(2 * width, WIDE)
            rough = a[i:j] @ b[c].T
            # what single precision can be off by, at most, for the longest vectors of the slab
            off = (dim + 4) * 2.0**-22 * long_a[i:j] * (long_b[c].max() if len(c) else 0.0)
            least = floor - off - SLIP
            r, t = np.nonzero(~(rough < least[:, None].astype(np.float32)))
            earlier = other[c[t]] < ids[i:j][r]
            r, t = r[earlier], c[t[earlier]]
            exact = np.empty(len(r))
            for cut in range(0, len(r), 1 << 15):
                part = slice(cut, cut + (1 << 15))
                exact[part] = np.round(np.einsum("ij,ij->i", x[i:j][r[part]], y[t[part]]), 6)
            good = exact > threshold
            q, m, s = np.concatenate([q, r[good]]), np.concatenate([m, t[good]]), np.concatenate([s, exact[good]])
            order = np.lexsort((other[m], -s, q))
            q, m, s = q[order], m[order], s[order]
            first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
            rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
            full = rank == k - 1
            floor[q[full]] = np.maximum(floor[q[full]], s[full])
            q, m, s = q[rank < k], m[rank < k], s[rank < k]
        found.append((q + i, m, s))
    return tuple(np.concatenate([f[p] for f in found]) if found else np.empty(0) for p in range(3))


def _pick(by: Sequence[str], table: pa.Table, q: np.ndarray, matches: np.ndarray, s: np.ndarray, kinds: Sequence[pa.DataType]) -> pa.Table:
    first = table.slice(0, 1)
    keys = [pa.array(first.column(c).to_pylist() * len(q), first.schema.field(c).type) for c in by]
    return pa.table([*keys, pa.array(q, kinds[0]), pa.array(matches, kinds[0]), pa.array(s)], [*by, "keyframe_id", "match_id", "similarity"])


def in_order(blocks: DataFrame, k: int, threshold: float, by: Sequence[str], dim: int, blocks_a_tile: int, schema: str) -> DataFrame:
    """Matches from blocks (by, block, ids, e) that are cut in the order of their ids: a tile meets itself and earlier ones."""
    by = list(by)
    tiled = blocks.withColumn("tile", F.expr(f"block DIV {blocks_a_tile}"))
    last = tiled.groupBy(*by).agg(F.max("tile").alias("_last"))
    last = last if by else last.withColumn("_one", F.lit(1))
    keys = by or ["_one"]
    tiled = tiled if by else tiled.withColumn("_one", F.lit(1))
    asking = tiled.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tile"))))
    meeting = tiled.join(F.broadcast(last), keys).withColumn("other", F.col("tile")).withColumn("tile", F.explode(F.sequence(F.col("tile"), F.col("_last")))).drop("_last")
    group, rest = [*by, "tile", "other"], ["block", "ids", "e"]

    def run(queries: pa.Table, matches: pa.Table) -> pa.Table:
        matches = matches.rename_columns([c.removeprefix("_m_") for c in matches.column_names])
        kind = queries.schema.field("ids").type.value_type
        mine, theirs = (t.sort_by("block") for t in (queries, matches))
        ids, other = (np.asarray(t.column("ids").combine_chunks().flatten()) for t in (mine, theirs))
        q, m, s = best_earlier(rows_of(mine.column("e"), dim), ids, rows_of(theirs.column("e"), dim), other, k, threshold) if len(mine) and len(theirs) else (np.empty(0, np.int64),) * 3
        return _pick(by, queries if len(queries) else matches, ids[q], other[m], np.asarray(s, np.float64), [kind])

    # both sides come from one table, so one takes names of its own
    meeting = meeting.select(*(F.col(c).alias(f"_m_{c}") for c in [*group, *rest]))
    return asking.select(*group, *rest).groupBy(*group).cogroup(meeting.groupBy(*(f"_m_{c}" for c in group))).applyInArrow(run, schema)


def best(found: DataFrame, k: int, by: Sequence[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by, "keyframe_id").orderBy(F.desc("similarity"), "match_id"))
    return found.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of numbers in the last column as bytes, back to back."""
    for batch in batches:
        bytes_ = pa.array([np.asarray(batch.column(batch.num_columns - 1)[i].values, np.float64).tobytes() for i in range(batch.num_rows)], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], bytes_], batch.schema.names)
