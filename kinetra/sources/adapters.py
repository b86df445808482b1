"""Movement-record views of the driver's synthetic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.config import QualityConfig

#: Cities of the synthetic recordings, by user_id modulo 4.
CITIES = ("Changchun", "Chongqing", "Tianjin", "Xi'an")
#: Thresholds at which every branch of the quality rules occurs in the synthetic tables.
QUALITY = QualityConfig(min_duration_s=6.7, stationary_distance_m=2700.0, stationary_speed_mps=18.0, stop_speed_mps=1.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame for each event, one track for each user."""
    k = F.get_json_object("props", "$.k").cast("int")
    city = F.lit(CITIES[3])
    for n in (2, 1, 0):
        city = F.when(F.col("user_id") % 4 == n, CITIES[n]).otherwise(city)
    return table(spark, sf_dir, "events").select(
        city.alias("city"),
        F.concat(F.lit("r"), (F.col("user_id") % 12).cast("string")).alias("recording_id"),
        F.col("user_id").alias("track_id"),
        F.col("event_id").alias("frame_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0 / 360000.0).alias("timestamp_ms"),
        F.when(F.col("event_type") == "error", "truck").when(F.col("event_type") == "view", " Car ").otherwise("car").alias("agent_type"),
        F.col("value").alias("x"),
        k.cast("double").alias("y"),
        (F.col("value") / 10.0).alias("vx"),
        (k / 50.0).alias("vy"),
        ((k - 50) / 10.0).alias("a_lon"),
    )


FRAMES_SQL = """frames AS (
  SELECT CASE user_id % 4 WHEN 0 THEN 'Changchun' WHEN 1 THEN 'Chongqing' WHEN 2 THEN 'Tianjin' ELSE 'Xi''an' END AS city,
    'r' || CAST(user_id % 12 AS VARCHAR) AS recording_id, user_id AS track_id, event_id AS frame_id,
    epoch_us(ts) / 1000.0 / 360000.0 AS timestamp_ms,
    CASE event_type WHEN 'error' THEN 'truck' WHEN 'view' THEN ' Car ' ELSE 'car' END AS agent_type,
    value AS x, CAST(k AS DOUBLE) AS y, value / 10.0 AS vx, k / 50.0 AS vy, (k - 50) / 10.0 AS a_lon
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional metadata of one city: two rows for every tenth track, labels with stray spaces, one rare class."""
    users = table(spark, sf_dir, "events").select("user_id").distinct().where("user_id % 4 = 2")
    u = F.col("user_id")
    crossing = F.when(u % 40 == 2, "Others").when(u % 3 == 0, "LeftTurn ").when(u % 3 == 1, " StraightCross").otherwise("RightTurn")
    violation = F.when(u % 28 == 6, " red-light running").when(u % 20 == 14, "yellow-light running ").otherwise("No violation of traffic lights")
    base = users.select(F.lit("Tianjin").alias("city"), F.concat(F.lit("r"), (u % 12).cast("string")).alias("recording_id"), u.alias("trackId"), F.lit(0).alias("row"), F.lit("car").alias("class"), crossing.alias("CrossType"), violation.alias("Signal_Violation_Behavior"))
    return base.unionByName(base.where(F.col("trackId") % 10 == 2).withColumn("row", F.lit(1)).withColumn("class", F.lit("bus")))


METADATA_SQL = """metadata AS (
  SELECT 'Tianjin' AS city, 'r' || CAST(user_id % 12 AS VARCHAR) AS recording_id, user_id AS track_id, 'car' AS class,
    CASE WHEN user_id % 40 = 2 THEN 'Others' WHEN user_id % 3 = 0 THEN 'LeftTurn ' WHEN user_id % 3 = 1 THEN ' StraightCross' ELSE 'RightTurn' END AS CrossType,
    CASE WHEN user_id % 28 = 6 THEN ' red-light running' WHEN user_id % 20 = 14 THEN 'yellow-light running ' ELSE 'No violation of traffic lights' END AS Signal_Violation_Behavior
  FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 4 = 2))"""


def vectors(spark: SparkSession, sf_dir: str, dims: int = 10) -> DataFrame:
    """(vec_id, label, d0..): the first dimensions of the embeddings as doubles."""
    e = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"), *[e[k].alias(f"d{k}") for k in range(dims)])


def vectors_sql(dims: int = 10) -> str:
    cols = ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS d{k}" for k in range(dims))
    return f"vectors AS (SELECT vec_id, CAST(label AS INTEGER) AS label, {cols} FROM embeddings)"
