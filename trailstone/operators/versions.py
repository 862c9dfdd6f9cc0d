"""Keyframes as a versioned table: batches of upserts and withdrawals, read as of any step.

A batch is a folder of the table named by its number, so that applying it twice leaves it there once. A version holds from
the step of its batch until the next one of the same keyframe; a batch whose relocalisation failed is withdrawn, and what
held before it holds on. Reading as of a step is one aggregation by keyframe (combined before the shuffle), no window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class VersionedTable:
    """Rows of `schema` by `key`; `key` is one column."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "keyframe_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.columns = spark.createDataFrame([], schema).columns
        kind = dict(spark.createDataFrame([], schema).dtypes)[key]
        self.schema = f"{schema}, step_nr long, deleted boolean, batch long"
        self.gone = f"withdrawn_batch long, {key} {kind}, batch long"

    def apply(self, batch: int, step: int, rows: DataFrame, deleted: DataFrame | None = None) -> None:
        """Upserts `rows` as of `step`, and removes the keys of `deleted`. The batch replaces what it wrote before."""
        out = rows.select(*self.columns, F.lit(step).cast("long").alias("step_nr"), F.lit(False).alias("deleted"))
        if deleted is not None:
            rest = [F.lit(None).cast(t).alias(c) for c, t in rows.select(*self.columns).dtypes if c != self.key]
            out = out.unionByName(deleted.select(self.key, *rest, F.lit(step).cast("long").alias("step_nr"), F.lit(True).alias("deleted")))
        out.write.mode("overwrite").parquet(f"{self.path}/changes/batch={batch}")

    def apply_all(self, changes: DataFrame) -> None:
        """Many batches in one job: `changes` has `batch` and `step_nr` beside the table's columns, and may say what is `deleted`.

        A batch that has rows there replaces what it wrote before; the folders of others stay as they are.
        """
        gone = F.col("deleted") if "deleted" in changes.columns else F.lit(False).alias("deleted")
        out = changes.select(*self.columns, F.col("step_nr").cast("long").alias("step_nr"), gone, F.col("batch").cast("long").alias("batch"))
        out.hint("rebalance", "batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/changes")

    def withdraw(self, batch: int, withdrawn: int | DataFrame, keys: DataFrame | None = None) -> None:
        """Batch `batch` takes back batch `withdrawn` (or all of a table of withdrawn_batch), or its `keys` alone."""
        if isinstance(withdrawn, DataFrame):
            own = F.lit(None).cast(self.gone.split()[3].rstrip(",")).alias(self.key)
            withdrawn.select(F.col("withdrawn_batch").cast("long").alias("withdrawn_batch"), own).write.mode("overwrite").parquet(f"{self.path}/withdrawals/batch={batch}")
            return
        rows = keys.select(self.key) if keys is not None else self.spark.sql(f"SELECT CAST(NULL AS {self.gone.split()[3].rstrip(',')}) AS {self.key}")
        rows.select(F.lit(withdrawn).cast("long").alias("withdrawn_batch"), self.key).write.mode("overwrite").parquet(f"{self.path}/withdrawals/batch={batch}")

    def _read(self, part: str, schema: str) -> DataFrame:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        if not path.getFileSystem(context._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")

    def changes(self) -> DataFrame:
        """All changes that haven't been withdrawn."""
        rows = self._read("changes", self.schema)
        gone = self._read("withdrawals", self.gone).select(F.col("withdrawn_batch").alias("_batch"), F.col(self.key).alias("_key"))
        return rows.join(gone, (F.col("batch") == F.col("_batch")) & (F.col("_key").isNull() | (F.col("_key") == F.col(self.key))), "left_anti")

    def as_of(self, step: int | None = None) -> DataFrame:
        """The rows that hold at a step (None: now): of each key the change of the greatest step, then batch."""
        rows = self.changes() if step is None else self.changes().where(F.col("step_nr") <= step)
        newest = rows.groupBy(self.key).agg(F.max_by(F.struct(*self.columns, "step_nr", "deleted"), F.struct("step_nr", "batch")).alias("v"))
        return newest.where("NOT v.deleted").select(*(F.col(f"v.{c}").alias(c) for c in self.columns), F.col("v.step_nr").alias("valid_from"))

    def intervals(self) -> DataFrame:
        """Each version with valid_from and valid_to (the step of the next change of its key, null: still valid)."""
        own = Window.partitionBy(self.key, "step_nr").orderBy(F.desc("batch"))
        single = self.changes().withColumn("_r", F.row_number().over(own)).where("_r = 1").drop("_r")
        ahead = Window.partitionBy(self.key).orderBy("step_nr")
        out = single.withColumn("valid_to", F.lead("step_nr").over(ahead)).where("NOT deleted")
        return out.select(*self.columns, F.col("step_nr").alias("valid_from"), "valid_to")


def as_of_each(versions: DataFrame, asked: DataFrame, key: str = "keyframe_id", step: str = "step_nr", values: Sequence[str] = ()) -> DataFrame:
    """asked (key, step) with the values of the version that holds then, null where none does; `versions` as from `intervals`."""
    held = versions.select(F.col(key).alias("_k"), "valid_from", "valid_to", *values)
    on = (F.col(key) == F.col("_k")) & (F.col("valid_from") <= F.col(step)) & (F.col("valid_to").isNull() | (F.col(step) < F.col("valid_to")))
    return asked.join(held, on, "left").drop("_k", "valid_from", "valid_to")
