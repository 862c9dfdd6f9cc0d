"""Bounded samples of labelled rows for the classifiers that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows of each class that a classifier is fitted on at most.
SAMPLE_ROWS = 6000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, label (0/1) of at most `rows` labelled rows of each class, the first in the order of a hash of the id.

    The choice reads ids and labels only, a top-n per class without a sort of the table; the chosen ids, at most
    2 * rows of them, are broadcast to the texts. Null labels and ids are left out.
    """
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label).alias("label")).where(learn & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("label")]
    chosen = [marked.where(F.col("label") == k).orderBy(*order).limit(rows) for k in (0, 1)]
    few = chosen[0].unionByName(chosen[1]).groupBy("doc_id").agg(F.min("label").alias("label"))  # 0 where labels disagree
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(few), "doc_id")


def class_counts(labels: DataFrame, label: str, learn: Column, id_col: str = "doc_id") -> tuple[int, int]:
    """Learnable rows with label 0 and with label 1, over all of them."""
    row = labels.select(F.col(id_col).alias("doc_id"), F.col(label).alias("label")).where(learn & F.col("doc_id").isNotNull()).agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).first()
    return int(row[0]), int(row[1])
