"""The engine's canonical tables as views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Orientations xyzw: none, about a slanted axis, about x, with a negative w, half a turn about y.
TURNS = ((0.0, 0.0, 0.0, 1.0), (0.48, 0.36, 0.48, 0.64), (-0.6, 0.0, 0.0, 0.8), (0.5, 0.5, -0.5, -0.5), (0.0, 1.0, 0.0, 0.0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS point_id", "CAST(o_orderkey % 16 AS INT) AS keyframe_id", "(o_custkey % 200) * 0.05D - 5.0D AS x",
        "CASE WHEN o_orderkey % 4 = 0 THEN (o_orderkey % 5) * 0.01D ELSE 0.1D + (o_orderkey % 59) * 0.05D END AS y",
        "o_totalprice / 50000.0D AS z", "1.0D + (o_custkey % 9) * 0.25D AS confidence",
        "CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 12 END AS INT) AS segment_id",
    )


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pose for each 200 neighbouring events, placed by sums over all of them; one of five orientations, about different axes."""
    part = lambda i: "CASE step_nr % 5 " + " ".join(f"WHEN {k} THEN {q[i]}D" for k, q in enumerate(TURNS)) + " END"
    sums = [F.min("ts").alias("ts"), F.sum("user_id").alias("u"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("v")]
    return table(spark, sf_dir, "events").groupBy(F.expr("event_id DIV 200").alias("step_nr")).agg(*sums).selectExpr(
        "step_nr", "ts", "(u % 40) * 0.25D - 5.0D AS tx", "1.0D + (v % 11) * 0.1D AS ty", "(v % 490) / 50.0D AS tz",
        *(f"{part(i)} AS {n}" for i, n in enumerate(("qx", "qy", "qz", "qw"))), "1.0D AS scale",
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "CAST(get_json_object(props, '$.k') AS DOUBLE)"
    return table(spark, sf_dir, "events").selectExpr(
        "event_id DIV 10 AS step_nr", "ts", "event_type AS class_name", "value / 500.0D AS confidence", f"{k} AS x1", f"{k} * 0.5D AS y1",
        f"{k} + 10 + event_id % 50 AS x2", f"{k} * 0.5D + 5 + event_id % 30 AS y2", "CAST(event_id % 10 AS INT) AS detection_id", "user_id",
    )


def segment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey % 50 AS step_nr", "CAST(c_custkey % 12 AS INT) AS segment_id", "c_mktsegment AS class_label", "c_custkey AS ord")


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("CAST(vec_id AS INT) AS keyframe_id", "embedding", "label")


def floor_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plane each 7th pose."""
    return poses(spark, sf_dir).where("step_nr % 7 = 3").selectExpr("step_nr", "0.0D AS nx", "1.0D AS ny", "0.0D AS nz", "(step_nr % 5) * 0.01D AS offset")


#: DuckDB twins of the views, as common table expressions.
SQL = {
    "points": """points AS (SELECT o_orderkey AS point_id, CAST(o_orderkey % 16 AS INT) AS keyframe_id, (o_custkey % 200) * 0.05E0 - 5.0E0 AS x,
  CASE WHEN o_orderkey % 4 = 0 THEN (o_orderkey % 5) * 0.01E0 ELSE 0.1E0 + (o_orderkey % 59) * 0.05E0 END AS y, o_totalprice / 50000.0E0 AS z,
  1.0E0 + (o_custkey % 9) * 0.25E0 AS confidence, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 12 END AS INT) AS segment_id FROM orders)""",
    "poses": """sums AS (SELECT event_id // 200 AS step_nr, min(ts) AS ts, CAST(sum(user_id) AS BIGINT) AS u, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS v FROM events GROUP BY 1),
 turns(k, qx, qy, qz, qw) AS (VALUES (0, 0.0E0, 0.0E0, 0.0E0, 1.0E0), (1, 0.48E0, 0.36E0, 0.48E0, 0.64E0), (2, -0.6E0, 0.0E0, 0.0E0, 0.8E0),
  (3, 0.5E0, 0.5E0, -0.5E0, -0.5E0), (4, 0.0E0, 1.0E0, 0.0E0, 0.0E0)),
 poses AS (SELECT step_nr, ts, (u % 40) * 0.25E0 - 5.0E0 AS tx, 1.0E0 + (v % 11) * 0.1E0 AS ty, (v % 490) / 50.0E0 AS tz, qx, qy, qz, qw, 1.0E0 AS scale
  FROM sums JOIN turns ON turns.k = sums.step_nr % 5),
 seen AS (SELECT *, 2 * (qx * qz + qy * qw) AS fx, 2 * (qy * qz - qx * qw) AS fy, 1 - 2 * (qx * qx + qy * qy) AS fz FROM poses)""",
    "detections": """detections AS (SELECT event_id // 10 AS step_nr, ts, event_type AS class_name, value / 500.0E0 AS confidence, k AS x1, k * 0.5E0 AS y1,
  k + 10 + event_id % 50 AS x2, k * 0.5E0 + 5 + event_id % 30 AS y2, CAST(event_id % 10 AS INT) AS detection_id, user_id
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events))""",
    "segment_labels": "segment_labels AS (SELECT c_custkey % 50 AS step_nr, CAST(c_custkey % 12 AS INT) AS segment_id, c_mktsegment AS class_label, c_custkey AS ord FROM customer)",
    "descriptors": "descriptors AS (SELECT CAST(vec_id AS INT) AS keyframe_id, embedding, label FROM embeddings)",
    "floors": "floors AS (SELECT step_nr, 0.0E0 AS nx, 1.0E0 AS ny, 0.0E0 AS nz, (step_nr % 5) * 0.01E0 AS \"offset\" FROM poses WHERE step_nr % 7 = 3)",
}
