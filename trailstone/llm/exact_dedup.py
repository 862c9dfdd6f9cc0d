"""Exact deduplication by composable polynomial fingerprints.

A text is normalised (each run of ASCII white space becomes one space) and cut into chunks of 1 KiB. A chunk's hash is
the sum of byte * B^position under two 31-bit primes, computed for all chunks of a block in one matrix product; hashes
of neighbouring pieces combine as left + B^len(left) * right, so a huge text is hashed piece by piece in any order of
work. Rows with equal (fingerprint, length) are then compared chunk by chunk: each chunk position of a group must hold
one value. Where it doesn't (a collision), the SHA-256 of the text splits the group.

Defined cases: null text counts as empty, and all empty texts are equal; a null doc_id loses against any other; of rows
that agree in doc_id and text one is kept; an empty table gives no rows; other columns of the input don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, staged, text_blocks, text_bytes

CHUNK = 1024
#: Primes just below 2^31 and a base for each.
PRIMES = np.array([2147483647, 2147483629], np.int64)
BASES = np.array([1000003, 69069421], np.int64)
#: Bytes of a text that one row of the comparison holds.
COMPARE = 16 * CHUNK


def _powers(step: np.ndarray, n: int) -> np.ndarray:
    """step^0 .. step^(n-1) under each prime, by doubling."""
    out = np.ones((max(n, 1), len(PRIMES)), np.int64)
    have, factor = 1, step % PRIMES
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * factor % PRIMES
        have, factor = have + take, factor * factor % PRIMES
    return out


_IN_CHUNK = _powers(BASES, CHUNK).astype(np.float64)  # 255 * 2^31 * 1024 stays below 2^53: the float product is exact
_SHIFT = np.array([pow(int(b), CHUNK, int(p)) for b, p in zip(BASES, PRIMES, strict=True)], np.int64)


def combine(left: tuple[np.ndarray, int], right: tuple[np.ndarray, int]) -> tuple[np.ndarray, int]:
    """The (hash, length) of two neighbouring pieces from those of each."""
    (a, n), (b, m) = left, right
    shift = np.array([pow(int(x), n, int(p)) for x, p in zip(BASES, PRIMES, strict=True)], np.int64)
    return (a + shift * b % PRIMES) % PRIMES, n + m


def normalised(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run of ASCII white space inside a text becomes one space; new bytes and offsets."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    again = np.zeros(len(data), bool)
    again[1:] = space[1:] & space[:-1]
    again[at[:-1][at[:-1] < len(data)]] = False
    kept = np.zeros(len(at), np.int64)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        kept[full + 1] = np.add.reduceat(~again, at[full], dtype=np.int64)
    return np.where(space, np.uint8(32), data)[~again], np.cumsum(kept)


def fingerprints(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of hashes, one under each prime, for every text of the block."""
    sizes = np.diff(at)
    chunks = -(-sizes // CHUNK)
    first = np.concatenate([[0], np.cumsum(chunks)])
    out = np.zeros((len(sizes), len(PRIMES)), np.int64)
    if not first[-1]:
        return out
    padded = np.zeros(first[-1] * CHUNK, np.uint8)  # zeros behind a text add nothing to its hash
    for i in np.flatnonzero(sizes):
        padded[first[i] * CHUNK : first[i] * CHUNK + sizes[i]] = data[at[i] : at[i + 1]]
    grid, rows = padded.reshape(-1, CHUNK), []
    for i in range(0, len(grid), 2048):
        rows.append((grid[i : i + 2048].astype(np.float64) @ _IN_CHUNK).astype(np.int64) % PRIMES)
    hashes = np.concatenate(rows)
    number = np.arange(first[-1]) - np.repeat(first[:-1], chunks)
    hashes = hashes * _powers(_SHIFT, int(chunks.max()))[number] % PRIMES
    full = np.flatnonzero(chunks)
    out[full] = np.add.reduceat(hashes, first[full]) % PRIMES
    return out


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in text_blocks(batches):
        data, at = normalised(*text_bytes(block.column("text")))
        marks, raw = fingerprints(data, at), data.tobytes()
        digests = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(marks[:, 0] << 31 | marks[:, 1]), pa.array(np.diff(at)), pa.array(digests)], ["doc_id", "mark", "n_bytes", "text_sha256"])


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in text_blocks(batches):
        data, at = normalised(*text_bytes(block.column("text")))
        marks, raw = fingerprints(data, at), data.tobytes()
        keys, sizes, numbers, chunks = [], [], [], []
        for (x, y), a, b in zip(marks.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            for k, i in enumerate(range(a, b, COMPARE)):
                keys.append(x << 31 | y)
                sizes.append(b - a)
                numbers.append(k)
                chunks.append(raw[i : min(i + COMPARE, b)])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(numbers, pa.int32()), pa.array(chunks, pa.binary())], ["mark", "n_bytes", "chunk", "bytes"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = -1) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256, mark, n_bytes.

    Ids are of any type that can be ordered, null ones last. `bits` masks the fingerprint: fewer bits make collisions, which the comparison then has to resolve.
    """
    rows = pick(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]
    hashed = rows.mapInArrow(_hash_rows, f"doc_id {kind}, mark long, n_bytes long, text_sha256 string")
    hashed = hashed.withColumn("mark", F.col("mark").bitwiseAND(bits)).withColumn("row", F.monotonically_increasing_id())
    hashed = staged(hashed, "fingerprints")
    repeated = staged(hashed.groupBy("mark", "n_bytes").agg(F.count("*").alias("n")).where("n > 1"), "repeated")

    # equal fingerprints: every chunk position must hold one value; min and max are combined before the shuffle
    members = staged(hashed.join(repeated, ["mark", "n_bytes"], "left_semi").select(F.col("doc_id").alias("_id")).distinct(), "members")
    chunks = rows.join(members, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").mapInArrow(_chunk_rows, "mark long, n_bytes long, chunk int, bytes binary").withColumn("mark", F.col("mark").bitwiseAND(bits))
    unlike = chunks.groupBy("mark", "n_bytes", "chunk").agg(F.min("bytes").alias("a"), F.max("bytes").alias("b")).where("a <> b").select("mark", "n_bytes", F.lit(True).alias("unlike")).distinct()
    unlike = staged(unlike, "unlike")

    keyed = hashed.join(unlike, ["mark", "n_bytes"], "left").withColumn("split", F.when(F.col("unlike"), F.col("text_sha256")).otherwise(F.lit(""))).drop("unlike")
    groups = keyed.groupBy("mark", "n_bytes", "split").agg(F.count("*").alias("group_size"), F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row")).alias("first")).where("group_size > 1")
    groups = staged(groups, "groups")
    # singles need no partner; the hot group's rows can be split among tasks, as both sides are plain scans
    out = keyed.join(groups, ["mark", "n_bytes", "split"], "left")
    alone = F.col("first").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("first.row"))).alias("kept"),
        "text_sha256", "mark", "n_bytes",
    )
