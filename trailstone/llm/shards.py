"""Sharding by a two-pass external shuffle, on DataFrame functions alone.

Pass one scatters every row into a bucket by a seeded hash of its id, text and further columns. Pass two takes a bucket at a
time, numbers its rows in a fixed order, shuffles the numbers (Spark's `shuffle` is a Fisher-Yates shuffle, with a seed of
its own for each bucket), puts the rows into that order and writes them. A bucket's rows follow those of the buckets before
it; the sequence that results is cut into shards, so that the numbers of rows in two shards differ by one at most, and
most buckets go to a single shard. There is a bucket for each BUCKET_BYTES, up to MOST_BUCKETS; what a task has in memory
is its bucket's numbers (at 100 TB, about a million), the rows themselves are sorted with spilling.

Rows that are equal in all columns have the same hash. Where there are more than REPEATS of them, the row is kept once and
its copies are made again behind the hash that tells them apart by number: a row that fills a third of the table fills
as many buckets as any other third. Groups of equal texts under different ids are dealt out like all other rows.

What decides is the rows' values, the seed and the number of shards: no task, file or partition number, so that the result
is the same on every cluster and a task that runs again makes the same rows. Texts cross the network once.

Defined cases: a null text has no bytes, its crc32 is that of no bytes, and it stays null in the output; null ids are hashed
as nulls; rows that repeat are rows of their own; further columns are carried where `keep` names them (of types that
Spark can hash and order, so no maps); an empty table gives no rows; with fewer rows than shards some shards stay empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.staging import shared_folder
from .common import staged

#: Bytes of texts that a bucket holds, about; buckets at most.
BUCKET_BYTES, MOST_BUCKETS = 8 << 20, 1 << 16
#: Copies of one row that may share a bucket; copies that one task makes at once.
REPEATS, _RUN = 1024, 1 << 16
#: What a row takes besides its text, in bytes.
ROW_BYTES = 16


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) and ROW_BYTES, as a long."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def external_shuffle(docs: DataFrame, shards: int, seed: int = 0, keep: Sequence[str] = (), id_col: str = "doc_id", text_col: str = "text", path: str | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes doc_id, text, the `keep` columns and slot in folders by shard, to `path` or the shared folder; returns that table.

    Slots count from 0 in each shard without gaps, in the order of the shuffle; files hold their rows in that order.
    """
    body = F.struct(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c) for c in keep))
    rows = docs.select(body.alias("row")).select("row", F.xxhash64(F.lit(seed), "row").alias("h1"), F.xxhash64(F.lit(~seed), "row").alias("h2"))
    names = staged(rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max(size_of(F.col("row.text"))).alias("size")), "names")
    total = names.agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("size")).alias("bytes")).first()
    many = total["rows"] or 0
    buckets = min(max(1, -(-(total["bytes"] or 0) // bucket_bytes)), MOST_BUCKETS)

    starts = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(_RUN).cast("long"))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "h1", "h2", "copy"), F.lit(buckets)).cast("int").alias("bucket")
    heavy = staged(names.where(F.col("n") > REPEATS).select("h1", "h2", "n"), "heavy")

    def copies(repeated: DataFrame, *columns: str) -> DataFrame:
        """A row for each copy, numbered; runs of copies are dealt out among tasks before they are made."""
        dealt = repeated.select("h1", "h2", "n", *columns, F.explode(starts).alias("at")).repartition("h1", "h2", "at")
        return dealt.withColumn("copy", F.explode(F.sequence("at", F.least("n", F.col("at") + _RUN) - 1))).drop("n", "at")

    once = F.lit(0).cast("long").alias("copy")
    light = names.where(F.col("n") <= REPEATS).select("h1", "h2", once, F.col("n").alias("m"))
    sizes = light.unionByName(copies(heavy).withColumn("m", F.lit(1).cast("long"))).select(bucket, "m").groupBy("bucket").agg(F.sum("m").alias("m"))
    sizes = staged(sizes, "sizes")
    firsts = sizes.select("bucket", "m", (F.sum("m").over(Window.orderBy("bucket")) - F.col("m")).alias("first"))  # one row a bucket
    numbers = F.sequence(F.lit(0).cast("long"), F.col("m") - 1)
    order = firsts.repartitionById(buckets, "bucket").select("bucket", "first", F.shuffle(numbers, seed).alias("numbers"))
    order = order.select("bucket", "first", F.posexplode("numbers").alias("pos", "i")).select("bucket", "i", (F.col("first") + F.col("pos")).alias("place"))

    one = rows.join(heavy, ["h1", "h2"]).groupBy("h1", "h2", "n").agg(F.element_at(F.collect_set("row"), 1).alias("row"))
    dealt = rows.join(heavy, ["h1", "h2"], "left_anti").select("row", "h1", "h2", once).unionByName(copies(one, "row"))
    dealt = dealt.select(bucket, "row", "h1", "h2", "copy").repartitionById(buckets, "bucket")
    numbered = dealt.withColumn("i", (F.row_number().over(Window.partitionBy("bucket").orderBy("h1", "h2", "copy")) - 1).cast("long"))
    shard = F.expr(f"(place * {shards}) DIV {max(many, 1)}")
    placed = numbered.join(order.hint("merge"), ["bucket", "i"]).select("row.*", shard.cast("int").alias("shard"), "place")
    slot = F.col("place") - F.expr(f"(shard * {many}L + {shards - 1}) DIV {shards}")
    path = path or f"{shared_folder(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    out = placed.withColumn("slot", slot).drop("place").sortWithinPartitions("shard", "slot")
    out.write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)
