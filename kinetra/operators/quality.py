"""Quality flags, exclusion reasons, inventories and table checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetra.config import CONTEXT, CORE_FEATURES, TRACK_KEY, QualityConfig
from kinetra.functions.quantiles import checkpointed, medians
from kinetra.functions.text import short_number
from kinetra.operators.kinematics import is_car


def add_quality_flags(tracks: DataFrame, config: QualityConfig) -> DataFrame:
    """is_short, is_stationary, exclusion_reason ("" if none) and is_eligible."""
    short = F.col("trajectory_duration_s") < config.min_duration_s
    still = (F.col("travel_distance_m") <= config.stationary_distance_m) & (F.col("max_speed_mps") <= config.stationary_speed_mps)
    reason = F.concat_ws("; ", F.when(F.col("is_short"), f"duration_below_{short_number(config.min_duration_s)}s"), F.when(F.col("is_stationary"), "stationary_full_trajectory"))
    return tracks.withColumn("is_short", short).withColumn("is_stationary", still).withColumn("exclusion_reason", reason).withColumn("is_eligible", F.col("exclusion_reason") == "")


def model_features(flagged: DataFrame) -> DataFrame:
    return flagged.where("is_eligible").select(*CONTEXT, "trajectory_duration_s", "frame_count", "travel_distance_m", "position_span_m", *CORE_FEATURES)


def exclusion_log(flagged: DataFrame) -> DataFrame:
    return flagged.where("NOT is_eligible").select(*CONTEXT, "trajectory_duration_s", "frame_count", "travel_distance_m", "max_speed_mps", "is_short", "is_stationary", "exclusion_reason")


def recording_inventory(frames: DataFrame, audited: Sequence[str] = ("track_id", "frame_id", "timestamp_ms", "agent_type")) -> DataFrame:
    """Rows, distinct tracks and car tracks, and missing cells over the audited columns, for each recording. Reads those columns only."""
    missing = sum(F.sum(F.col(c).isNull().cast("long")) for c in audited)
    return frames.groupBy("city", "recording_id").agg(F.count(F.lit(1)).alias("vehicle_rows"), F.countDistinct("track_id").alias("vehicle_tracks"), F.countDistinct(F.when(is_car(), F.col("track_id"))).alias("car_tracks"), missing.alias("missing_cells"))


def city_inventory(recordings: DataFrame) -> DataFrame:
    return recordings.groupBy("city").agg(F.count(F.lit(1)).alias("recordings"), *[F.sum(c).alias(c) for c in ("vehicle_rows", "vehicle_tracks", "car_tracks", "missing_cells")])


def processing_summary(frames: DataFrame, flagged: DataFrame) -> DataFrame:
    """Raw and flagged counts by recording; a recording without cars keeps its row."""
    raw = frames.groupBy("city", "recording_id").agg(F.count(F.lit(1)).alias("raw_rows"), F.countDistinct("track_id").alias("raw_tracks"), F.count_if(is_car()).alias("car_rows"))
    cars = flagged.groupBy("city", "recording_id").agg(
        F.count(F.lit(1)).alias("car_tracks"),
        F.count_if("is_short").alias("short_tracks"),
        F.count_if("is_stationary").alias("stationary_tracks"),
        F.count_if(F.col("is_short") & F.col("is_stationary")).alias("short_and_stationary"),
        F.count_if(~F.col("is_eligible")).alias("excluded_tracks"),
        F.count_if("is_eligible").alias("eligible_tracks"),
    )
    return raw.join(cars, ["city", "recording_id"], "left").na.fill(0)


SUMMED = ("raw_rows", "raw_tracks", "car_rows", "car_tracks", "short_tracks", "stationary_tracks", "short_and_stationary", "excluded_tracks", "eligible_tracks")


def city_processing_summary(by_recording: DataFrame) -> DataFrame:
    return by_recording.groupBy("city").agg(F.count(F.lit(1)).alias("recordings"), *[F.sum(c).alias(c) for c in SUMMED])


def frame_quality_audit(frames: DataFrame) -> DataFrame:
    """Repeated (track, frame) and (track, time) rows, tracks of several types, time steps that do not advance, and the median step, for each recording."""
    rec = ["city", "recording_id"]
    track = W.partitionBy(*TRACK_KEY)
    in_time, by_frame = track.orderBy("timestamp_ms", "frame_id"), track.orderBy("frame_id")
    again = lambda c, w: (F.row_number().over(w) > 1) & F.col(c).eqNullSafe(F.lag(c).over(w))
    so_far = in_time.rowsBetween(W.unboundedPreceding, W.currentRow)
    mixed = F.lead(F.lit(True)).over(in_time).isNull() & (F.min("agent_type").over(so_far) != F.max("agent_type").over(so_far))  # on the last row of a track
    dealt = frames.select(*TRACK_KEY, "frame_id", "timestamp_ms", "agent_type", again("frame_id", by_frame).alias("same_frame"))
    # all windows share the exchange on the track key; written once for the sums and for the medians, which need other columns and so would deal the frames again
    steps = checkpointed(dealt.select(*rec, (F.col("timestamp_ms") - F.lag("timestamp_ms").over(in_time)).alias("dt"), again("timestamp_ms", in_time).alias("same_time"), "same_frame", mixed.alias("mixed")))
    sums = steps.groupBy(*rec).agg(F.count_if(F.col("dt") <= 0).alias("non_positive_steps"), F.count(F.lit(1)).alias("rows"), F.count_if("same_frame").alias("repeated_frames"), F.count_if("same_time").alias("repeated_times"), F.count_if("mixed").alias("mixed_type_tracks"))
    step = medians(steps.where("dt > 0"), rec, ["dt"]).withColumnRenamed("dt", "median_step_ms")
    return sums.alias("a").join(step.alias("b"), F.col("a.city").eqNullSafe(F.col("b.city")) & F.col("a.recording_id").eqNullSafe(F.col("b.recording_id")), "left").select("a.city", "a.recording_id", "non_positive_steps", "median_step_ms", "rows", "repeated_frames", "repeated_times", "mixed_type_tracks")


def validation_counts(table: DataFrame, key: str, numeric: Sequence[str]) -> DataFrame:
    """One row: rows, distinct keys, null cells and infinite or NaN cells."""
    nulls = sum(F.count_if(F.col(c).isNull()) for c in (key, *numeric))
    odd = sum(F.count_if(F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))) for c in numeric)
    return table.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("distinct_keys"), nulls.alias("null_cells"), odd.alias("infinite_cells"))


def validate_feature_table(table: DataFrame, key: str = "trajectory_uid", numeric: Sequence[str] = CORE_FEATURES, expected_rows: int | None = None) -> DataFrame:
    """Raises on repeated keys, nulls, infinities or another number of rows than expected; returns the table."""
    found = validation_counts(table, key, numeric).first()
    faults = []
    if found.rows != found.distinct_keys:
        faults.append(f"{found.rows - found.distinct_keys} repeated keys")
    if found.null_cells:
        faults.append(f"{found.null_cells} null cells")
    if found.infinite_cells:
        faults.append(f"{found.infinite_cells} infinite cells")
    if expected_rows is not None and found.rows != expected_rows:
        faults.append(f"{found.rows} rows, not {expected_rows}")
    if faults:
        raise ValueError("feature table: " + "; ".join(faults))
    return table


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join that raises if a key repeats on either side or, for an inner join, if rows are lost."""
    for side, df in (("left", left), ("right", right)):
        if df.groupBy(*keys).count().where("count > 1").limit(1).count():
            raise ValueError(f"repeated keys on the {side} side")
    out = left.join(right, list(keys), how)
    if how == "inner" and out.count() != left.count():
        raise ValueError("rows without a partner")
    return out
