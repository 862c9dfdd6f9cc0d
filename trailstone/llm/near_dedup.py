"""Near-duplicate detection by SuperMinHash signatures, banding, verification on full sets and union-find grouping.

A document is the set of its k-word shingles. SuperMinHash gives every element its own random permutation of the
registers and drops rank + fraction into them, rank by rank; a document stops as soon as all its registers hold less
than the next rank. Bands of the signature put documents into buckets. What follows never pairs a bucket with itself:

1. documents with equal sets become one class; two sets of fewer than share / (100 - share) shingles (four at 0.8) link only
   if they are equal, so these classes are done;
2. each bucket names a pivot (another for each band), a class is verified against the pivot it shares most bands with,
   and, where it is still in another component, against its other pivots;
3. only where a bucket still spans several components, classes are compared across components: those of the smaller
   component with all of the larger one, and classes that are alone with each other within their bucket. Both sides are
   dealt out in blocks of about BLOCK classes and BLOCK_SHINGLES shingles, a block is compared with a block at once on
   full sets, and only links come out of it.

So every two documents that share a band end in one component or have been compared on their full sets; groups of
thousands of copies cost a few comparisons a member. Rows are: classes by their bands, by the larger components they meet
in a bucket, and, where a bucket holds n classes that are like none of the others, by n / BLOCK blocks. Buckets with many rows are
joined as written tables, so that Spark can split them among tasks.

Links are exact once two documents share a band; with 32 bands of 4 registers a pair at the threshold of 0.8 shares none
with a probability of 5e-8. Sets hold 64-bit hashes of shingles: two of a million shingles are taken for one with a
probability of 3e-8.

Defined cases: null text is empty; texts with fewer than k words are one shingle, the whole sequence; texts without words
have an empty set and link with nothing; repeated rows (same id and text) share their component, and rows that share
their id only are documents of their own; a component is named by its smallest id, ids that are null don't count; a row
without an id is kept where its component has none at all; other columns of the input don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, staged, text_blocks
from .components import components

REGISTERS, BANDS = 128, 32
ROWS = REGISTERS // BANDS
#: Classes of either side that one comparison of blocks holds, about, and their shingles.
BLOCK, BLOCK_SHINGLES = 256, 1 << 19
_FRACTION = 25  # bits below the rank in a register
_SLICE = 120_000  # shingles that a signature step works on at once


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Numbered(dict):
    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct k-word shingles of each text."""
    number, ids = _Numbered(), []
    for text in texts:
        words = text.encode().lower().split()  # bytes: A-Z only, ASCII white space only
        ids.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
    named = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
    out = []
    for x in ids:
        h = named[x]
        if not len(h):
            out.append(np.empty(0, np.uint64))
            continue
        n = min(k, len(h))
        code = np.full(len(h) - n + 1, np.uint64(n))
        for i in range(n):
            code = _mix(code * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
        out.append(np.unique(code))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash registers (rank and fraction in 32 bits), a row for each set; all ones where the set is empty."""
    out = np.full((len(sets), REGISTERS), np.uint32(2**32 - 1))
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    at = np.concatenate([[0], np.cumsum(sizes)])
    start = 0
    while start < len(sets):
        end = max(start + 1, int(np.searchsorted(at, at[start] + _SLICE, "right")) - 1)
        _fill(out[start:end], np.concatenate(sets[start:end]), np.repeat(np.arange(end - start), sizes[start:end]))
        start = end
    return out


def _fill(out: np.ndarray, element: np.ndarray, owner: np.ndarray) -> None:
    flat = out.reshape(-1)
    seats: np.ndarray | None = None  # each element's permutation so far, from rank 2 on
    first = second = np.empty(0, np.int64)
    for rank in range(REGISTERS):
        if rank:  # nothing can fall below a document whose registers all hold less than this rank
            live = (out >= np.uint32(min(rank << _FRACTION, 2**32 - 1))).any(1)[owner]
            if not live.any():
                return
            if not live.all():
                element, owner, first, second = element[live], owner[live], first[live], second[live] if rank > 1 else second
                seats = seats[live] if seats is not None else None
        z = _mix(element + np.uint64((0x9E3779B97F4A7C15 * (rank + 1)) % 2**64))
        fraction = (z >> np.uint64(64 - _FRACTION)).astype(np.uint32)
        draw = rank + ((z & np.uint64(0xFFFFFFFF)) * np.uint64(REGISTERS - rank) >> np.uint64(32)).astype(np.int64)
        if rank == 0:
            seat = first = draw
        elif rank == 1:  # the first swap put 0 where the first draw was
            second = draw
            seat = np.where(draw == first, 0, draw)
        else:
            rows = np.arange(len(element))
            if seats is None:
                seats = np.tile(np.arange(REGISTERS, dtype=np.uint8), (len(element), 1))
                for i, d in enumerate((first, second)):
                    seats[rows, i], seats[rows, d] = seats[rows, d], seats[rows, i].copy()
            seat = seats[rows, draw].astype(np.int64)
            seats[rows, draw] = seats[:, rank]
        np.minimum.at(flat, owner * REGISTERS + seat, fraction | np.uint32(rank << _FRACTION))


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    parts = registers.reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.zeros((len(registers), 1), np.uint64)
    for i in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            sets = shingle_sets(block.column("text").to_pylist(), k)
            registers = signatures(sets)
            keys = band_keys(registers).view(np.int64).ravel()
            names = [np.frombuffer(blake2b(x.tobytes(), digest_size=16).digest(), np.int64) for x in sets]
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("t"), pa.array([len(x) for x in sets], pa.int64()), pa.array([int(x[0]) for x in names], pa.int64()), pa.array([int(x[1]) for x in names], pa.int64()), pa.ListArray.from_arrays(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32), pa.array(keys))],
                ["doc_id", "t", "n_shingles", "s1", "s2", "bands"],
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            sets = shingle_sets(block.column("text").to_pylist(), k)
            right = [np.frombuffer(blake2b(x.tobytes(), digest_size=16).digest(), np.int64).tolist() == [a, b] for x, a, b in zip(sets, block.column("s1").to_pylist(), block.column("s2").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([block.column("id"), pa.array([x.tobytes() for x in sets], pa.binary())], ["id", "shingles"]).filter(pa.array(right))

    return run


def _set(column: pa.Array, i: int) -> np.ndarray:
    """Row i of a column of packed sets, where it lies."""
    return np.frombuffer(column[i].as_buffer(), np.uint64)


def _verify(share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = _set(batch.column("x"), i), _set(batch.column("y"), i)
                if 100 * min(len(x), len(y)) < share * max(len(x), len(y)):
                    continue
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                linked[i] = 100 * both >= share * (len(x) + len(y) - both)
            yield batch.select(["u", "v"]).filter(pa.array(linked))

    return run


def _blocks(share: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Links between documents of different components, one from each side."""
        found: list[tuple[int, int]] = []
        if left.num_rows and right.num_rows:
            theirs = [_set(right.column("shingles"), i) for i in range(right.num_rows)]
            sizes = np.array([len(x) for x in theirs])
            starts = np.cumsum(sizes) - sizes
            known, place = np.unique(np.concatenate(theirs), return_inverse=True)
            v, cv = (np.asarray(right.column(c)) for c in ("id", "c"))
            mark = np.zeros(len(known), bool)
            for i, (u, cu) in enumerate(zip(left.column("id").to_pylist(), left.column("c").to_pylist(), strict=True)):
                own = _set(left.column("shingles"), i)
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                at = at[known[at] == own]
                mark[at] = True
                both = np.add.reduceat(mark[place], starts, dtype=np.int64)
                mark[at] = False
                hit = (cv != cu) & (100 * both >= share * (len(own) + sizes - both))
                found += [(u, int(x)) for x in v[hit]]
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _with(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """u, v and the value of each as x and y."""
    out = pairs.join(table.select(F.col("id").alias("u"), F.col(value).alias("x")), "u")
    return out.join(table.select(F.col("id").alias("v"), F.col(value).alias("y")), "v").select("u", "v", "x", "y")


def near_dedup(docs: DataFrame, k: int = 5, share: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row; links need 100 * intersection >= share * union.

    Ids are of any type that can be ordered; component_id has it too.
    """
    rows = pick(docs, id_col, text_col).withColumn("t", F.xxhash64("text"))  # t tells rows of one id apart
    kind = dict(rows.dtypes)["doc_id"]
    signed = staged(rows.mapInArrow(_sign(k), f"doc_id {kind}, t long, n_shingles long, s1 long, s2 long, bands array<long>"), "signed")
    classes = signed.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"))
    classes = staged(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    # the signature of each class that can link with another: that of a row with its smallest id
    linking = classes.where(F.col("n") * (100 - share) >= share).select("id", "n", *(F.col(c).alias(f"_{c}") for c in ("doc_id", "s1", "s2")))
    own = (F.col("s1") == F.col("_s1")) & (F.col("s2") == F.col("_s2")) & F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    heads = signed.select("doc_id", "t", "s1", "s2", "bands").join(linking, own).select("id", "n", "doc_id", "t", "s1", "s2", "bands").dropDuplicates(["id"])
    heads = staged(heads, "heads")
    seats = heads.select("id", F.explode("bands").alias("key"))
    mask = F.xxhash64("key")
    buckets = staged(seats.groupBy("key").agg(F.count("*").alias("n"), F.min(F.col("id").bitwiseXOR(mask)).alias("first")).where("n > 1").select("key", F.col("first").bitwiseXOR(mask).alias("pivot")), "buckets")
    members = staged(seats.join(buckets, "key").select("key", "id", "pivot"), "members")
    pairs = staged(members.where("id <> pivot").groupBy(F.col("id").alias("u"), F.col("pivot").alias("v")).agg(F.count("*").alias("n")), "pairs")

    needed = heads.join(members.select("id").distinct(), "id", "left_semi").select("id", F.col("doc_id").alias("_id"), F.col("t").alias("_t"), "s1", "s2")
    texts = rows.join(needed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t"))).select("id", "text", "s1", "s2")
    sets = staged(texts.mapInArrow(_sets(k), "id long, shingles binary").dropDuplicates(["id"]), "sets")

    def verified(candidates: DataFrame) -> DataFrame:
        return staged(_with(candidates, sets, "shingles").mapInArrow(_verify(share), "u long, v long").select(F.col("u").alias("a"), F.col("v").alias("b")), "verified")

    def rooted(table: DataFrame, roots: DataFrame, column: str, name: str) -> DataFrame:
        out = table.join(roots.select(F.col("node").alias(column), F.col("root").alias("_root")), column, "left")
        return out.withColumn(name, F.coalesce("_root", column)).drop("_root")

    best = pairs.groupBy("u").agg(F.max_by("v", F.struct("n", "v")).alias("v"))
    links = verified(best)
    roots = components(links)
    apart = rooted(rooted(pairs, roots, "u", "cu"), roots, "v", "cv").where("cu <> cv").select("u", "v").join(best, ["u", "v"], "left_anti")
    links = links.unionByName(verified(staged(apart, "apart")))
    roots = components(links)

    seated = staged(rooted(members.select("key", "id"), roots, "id", "c"), "seated")
    spread = staged(seated.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key"), "spread")
    open_ = seated.join(spread, "key").join(heads.select("id", "n"), "id")
    open_ = staged(open_, "open")
    sized = staged(open_.select("id", "c", "n").distinct().groupBy("c").agg(F.count("*").alias("size"), F.sum("n").alias("load")), "sized")
    open_ = staged(open_.join(sized, "c"), "open")
    block = lambda n: F.pmod(F.xxhash64("id"), n)
    blocks = lambda n, load: F.greatest(F.ceil(n / BLOCK), F.ceil(load / BLOCK_SHINGLES))
    up_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    # the smaller component's classes against all of the larger component
    large = staged(open_.where("size > 1").select("key", F.col("c").alias("g1"), F.col("size").alias("whole"), F.col("load").alias("whole_load")).distinct(), "large")
    meets = open_.join(large, "key").where("c <> g1 AND (size < whole OR size = whole AND c > g1)").select("id", "c", "n", "g1", "whole", "whole_load").distinct()
    meets = staged(meets, "meets")
    dealt = meets.groupBy("g1", "whole", "whole_load").agg(F.count("*").alias("m"), F.sum("n").alias("load"))
    dealt = staged(dealt.select("g1", blocks(F.col("whole"), F.col("whole_load")).alias("nv"), blocks(F.col("m"), F.col("load")).alias("nu")), "dealt")
    left = meets.select("id", "c", "g1").join(dealt, "g1").withColumn("ub", block(F.col("nu"))).withColumn("vb", up_to("nv"))
    grown = staged(open_.select("id", "c").distinct(), "grown")
    right = grown.join(dealt.withColumnRenamed("g1", "c"), "c").withColumn("g1", F.col("c")).withColumn("vb", block(F.col("nv"))).withColumn("ub", up_to("nu"))
    place = [F.lit(0).alias("g0"), "g1", (F.col("vb") * F.col("nu") + F.col("ub")).alias("g2"), "id", "c"]
    left, right = left.select(*place), right.select(*place)

    # classes that are alone, within their bucket
    alone = open_.where("size = 1").select("key", "id", "c", "n")
    crowd = staged(alone.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("load")).where("m > 1").select("key", blocks(F.col("m"), F.col("load")).alias("nb")), "crowd")
    alone = staged(alone.join(crowd, "key").withColumn("b", block(F.col("nb"))), "alone")
    one = alone.withColumn("o", F.explode(F.sequence(F.col("b"), F.col("nb") - 1))).select(F.lit(1).alias("g0"), F.col("key").alias("g1"), (F.col("b") * F.col("nb") + F.col("o")).alias("g2"), "id", "c")
    other = alone.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b")))).select(F.lit(1).alias("g0"), F.col("key").alias("g1"), (F.col("o") * F.col("nb") + F.col("b")).alias("g2"), "id", "c")

    group = ["g0", "g1", "g2"]
    sides = [x.unionByName(y).join(sets, "id").select(*(F.col(k).alias(k) for k in (*group, "id", "c", "shingles"))).groupBy(*group) for x, y in ((left, one), (right, other))]
    links = links.unionByName(staged(sides[0].cogroup(sides[1]).applyInArrow(_blocks(share), "a long, b long"), "across"))
    roots = components(links)

    rooted_ = staged(rooted(classes.select("s1", "s2", "doc_id", "id"), roots, "id", "c"), "rooted")
    names = staged(rooted_.groupBy("c").agg(F.min("doc_id").alias("component_id")), "names")
    named = staged(rooted_.join(names, "c").select("s1", "s2", "component_id"), "named")
    out = signed.select("doc_id", "n_shingles", "s1", "s2").join(named, ["s1", "s2"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
