"""A stream's tables and their summaries as files that a batch writes once, however often it runs.

A trigger's rows go to a folder that is named by the stream and the batch's number; a batch that is run again (its driver
died between writing and committing) replaces that folder. Beside it lies the batch's partial summary: counts, sums and
extremes, which merge without the rows. Readers take only folders that were finished.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class RunFolder:
    """Tables of a run under one folder; a stream's writer is `writer(name)`, for `writeStream.foreachBatch`."""

    def __init__(self, path: str, summaries: Sequence[str] = (), by: Sequence[str] = ()):
        """summaries: number columns that are summed up for each of `by` (nothing: for the whole batch)."""
        self.path, self.summaries, self.by = path.rstrip("/"), list(summaries), list(by)

    def writer(self, name: str) -> Callable[[DataFrame, int], None]:
        def write(rows: DataFrame, batch: int) -> None:
            place = f"batch={batch:09d}"
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/rows/{place}")
            if self.summaries or self.by:
                written = rows.sparkSession.read.schema(rows.schema).parquet(f"{self.path}/{name}/rows/{place}")
                self.partial(written).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}/summary/{place}")

        return write

    def partial(self, rows: DataFrame) -> DataFrame:
        sums = []
        for c in self.summaries:
            x = F.col(c).cast("double")
            sums += [F.count(c).alias(f"{c}_n"), F.sum(x).alias(f"{c}_sum"), F.sum(x * x).alias(f"{c}_squares"), F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max")]
        return rows.groupBy(*self.by).agg(F.count("*").alias("n"), *sums)

    def _finished(self, spark: SparkSession, name: str, part: str) -> list[str]:
        """Folders of batches whose write ended."""
        context = spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/{part}/batch=*/_SUCCESS")
        found = path.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(path) or []
        return sorted(str(f.getPath().getParent()) for f in found)

    def read(self, spark: SparkSession, name: str, schema: str | None = None) -> DataFrame:
        """All rows, with the number of their batch."""
        places = self._finished(spark, name, "rows")
        if not places:
            return spark.createDataFrame([], f"{schema or ''}{', ' if schema else ''}batch long")
        reader = spark.read.option("basePath", f"{self.path}/{name}/rows")
        return (reader.schema(f"{schema}, batch long") if schema else reader).parquet(*places).withColumn("batch", F.col("batch").cast("long"))

    def summary(self, spark: SparkSession, name: str) -> DataFrame:
        """n, and mean, std_pop, min, max of each summarised column, merged from the batches' partial ones."""
        places = self._finished(spark, name, "summary")
        if not places:
            raise FileNotFoundError(f"{self.path}/{name} has no summary")
        parts = spark.read.parquet(*places)
        merged = [F.sum("n").alias("n")]
        for c in self.summaries:
            n, s, q = F.sum(f"{c}_n"), F.sum(f"{c}_sum"), F.sum(f"{c}_squares")
            spread = F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0)))
            merged += [(s / n).alias(f"{c}_mean"), spread.alias(f"{c}_std_pop"), F.min(f"{c}_min").alias(f"{c}_min"), F.max(f"{c}_max").alias(f"{c}_max")]
        return parts.groupBy(*self.by).agg(*merged)


def export(write: Callable[[DataFrame, str], None], path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch for a writer of files (`files.write_...`): each batch's file is named by the batch and replaced when it runs again."""

    def run(batch_rows: DataFrame, batch: int) -> None:
        write(batch_rows, f"{path.rstrip('/')}/batch-{batch:09d}")

    return run
