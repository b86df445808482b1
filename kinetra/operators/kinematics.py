"""Frame-level kinematics and one row for each trajectory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetra.config import TRACK_KEY
from kinetra.functions.text import strip, trajectory_uid


def length(x: Column, y: Column) -> Column:
    """sqrt(x * x + y * y), each step rounded as in SQL: `hypot` may differ in the last bit, and so on either side of a threshold."""
    return F.sqrt(x * x + y * y)


def is_car(agent_type: str = "agent_type") -> Column:
    return F.coalesce(F.lower(strip(F.col(agent_type))) == "car", F.lit(False))


def car_frames(frames: DataFrame, stop_speed: float) -> DataFrame:
    """Car rows with speed, squares and the stop predicate."""
    return (
        frames.where(is_car())
        .withColumn("speed", length(F.col("vx"), F.col("vy")))
        .withColumn("speed_sq", F.col("speed") * F.col("speed"))
        .withColumn("a_lon_sq", F.col("a_lon") * F.col("a_lon"))
        .withColumn("stopped", F.coalesce(F.col("speed") < stop_speed, F.lit(False)))
    )


def frame_kinematics(cars: DataFrame) -> DataFrame:
    """Differences within a track in time order: dt, jerk (null where dt <= 0), step (first row 0) and stop transitions.

    The window and the later aggregate share one hash exchange on the track key.
    """
    w = W.partitionBy(*TRACK_KEY).orderBy("timestamp_ms", "frame_id")
    lag = lambda c: F.lag(c).over(w)
    return (
        cars.withColumn("dt_s", (F.col("timestamp_ms") - lag("timestamp_ms")) / 1000.0)
        .withColumn("_da", F.col("a_lon") - lag("a_lon"))
        .withColumn("step_m", F.coalesce(length(F.col("x") - lag("x"), F.col("y") - lag("y")), F.lit(0.0)))
        .withColumn("stop_transition", F.coalesce(~lag("stopped") & F.col("stopped"), F.lit(False)).cast("int"))
        .withColumn("jerk", F.when(F.col("dt_s") > 0, F.try_divide("_da", "dt_s")))
        .drop("_da")
    )


def trajectories(kinematics: DataFrame) -> DataFrame:
    """One row for each track: times, counts, distances and the ten core features."""
    agg = kinematics.groupBy(*TRACK_KEY).agg(
        F.min("timestamp_ms").alias("start_timestamp_ms"),
        F.max("timestamp_ms").alias("end_timestamp_ms"),
        F.count(F.lit(1)).alias("frame_count"),
        F.avg("speed").alias("mean_speed_mps"),
        F.max("speed").alias("max_speed_mps"),
        F.coalesce(F.stddev_pop("speed"), F.lit(0.0)).alias("speed_std_mps"),
        F.avg("a_lon").alias("mean_long_acc_mps2"),
        F.greatest(F.max("a_lon"), F.lit(0.0)).alias("max_acceleration_mps2"),
        (0.0 - F.least(F.min("a_lon"), F.lit(0.0))).alias("max_deceleration_mps2"),
        F.coalesce(F.stddev_pop("a_lon"), F.lit(0.0)).alias("acceleration_std_mps2"),
        F.coalesce(F.avg(F.abs("jerk")), F.lit(0.0)).alias("mean_abs_jerk_mps3"),
        F.sum("stop_transition").alias("observed_stop_transition_count"),
        F.avg(F.col("stopped").cast("double")).alias("stopped_time_ratio"),
        F.sum("step_m").alias("travel_distance_m"),
        length(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("position_span_m"),
    )
    return agg.select(
        trajectory_uid().alias("trajectory_uid"),
        *agg.columns[:5],
        ((F.col("end_timestamp_ms") - F.col("start_timestamp_ms")) / 1000.0).alias("trajectory_duration_s"),
        *agg.columns[5:],
    )


def track_series(frames: DataFrame, city: str, recording_id: str, track_id: int) -> DataFrame:
    """The time series of one track, time counted from its first frame; an unknown track has no rows."""
    w = W.partitionBy(*TRACK_KEY).orderBy("timestamp_ms", "frame_id")
    rows = frames.where((F.col("city") == city) & (F.col("recording_id") == recording_id) & (F.col("track_id") == track_id))
    t0 = F.first("timestamp_ms").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    out = rows.withColumn("time_s", (F.col("timestamp_ms") - t0) / 1000.0).withColumn("speed", length(F.col("vx"), F.col("vy")))
    dt = (F.col("timestamp_ms") - F.lag("timestamp_ms").over(w)) / 1000.0
    return out.withColumn("dt_s", dt).withColumn("jerk", F.when(F.col("dt_s") > 0, F.try_divide(F.col("a_lon") - F.lag("a_lon").over(w), F.col("dt_s"))))
