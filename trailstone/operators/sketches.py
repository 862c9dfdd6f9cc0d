"""Distinct counts and quantiles from sketches that are kept for each run and merged over runs.

A run's sketches are bytes in a table: HyperLogLog (2^LOG_K registers: standard error about 1.04 / sqrt(2^LOG_K), 1.6 %) and
KLL quantiles (K: normalised rank error about 1.3 % at 200, of a rank, not of a value). Merging adds no error of its own for
the counts, and stays within the same bound for quantiles, so that a table of runs answers for any set of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG_K, K = 12, 200


def by_run(rows: DataFrame, by: Sequence[str], run: str, distinct: str, value: str) -> DataFrame:
    """One row for each of `by` and run: n, who (sketch of the distinct values), values (sketch of the values)."""
    return rows.groupBy(*by, run).agg(F.count("*").alias("n"), F.hll_sketch_agg(distinct, F.lit(LOG_K)).alias("who"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(K)).alias("values"))


def merged(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """n, about (distinct values, estimated), low, middle, high (quartiles, estimated) over all runs of the table."""
    total = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("who")).alias("about"), F.kll_merge_agg_double("values").alias("values"))
    at = lambda q: F.kll_sketch_get_quantile_double("values", F.lit(q))
    return total.select(*by, "n", "about", at(0.25).alias("low"), at(0.5).alias("middle"), at(0.75).alias("high"))
