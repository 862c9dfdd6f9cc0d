"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in spark.checkpoint.dir, removed when the driver ends.

    Where that isn't set, a local folder serves a local master (tests); executors of a cluster would not share it.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="trailstone-")
        context.setCheckpointDir(found)
    folder = f"{found.rstrip('/')}/trailstone-{context.applicationId}"
    if folder not in _own:
        _own.add(folder)
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return folder


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows as a Parquet table: lineage ends there and a lost executor loses nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
