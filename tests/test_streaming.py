"""The streaming summary ends where the batch aggregate does."""

import pytest
from pyspark.sql import functions as F

from kinetra.operators import kinematics
from kinetra.sources import adapters
from kinetra.streaming.tracks import track_summaries


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    frames = adapters.frames(spark, sf_dir).withColumn("at", F.timestamp_seconds(F.col("timestamp_ms") / 1000)).cache()
    cut = frames.approxQuantile("timestamp_ms", [0.5], 0.0)[0]
    for k, part in enumerate((frames.where(F.col("timestamp_ms") <= cut), frames.where(F.col("timestamp_ms") > cut))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k == 0:
            stream = spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in"))
            cars = kinematics.car_frames(stream, 1.0)
            q = track_summaries(cars, "at", 1.0).writeStream.outputMode("update").format("memory").queryName("tracks").start()
        q.processAllAvailable()
    q.stop()
    last = spark.table("tracks").groupBy("track_id").agg(F.max_by(F.struct("*"), "frame_count").alias("r")).select("r.*")
    got = {r.track_id: r for r in last.collect()}
    want = {r.track_id: r for r in kinematics.trajectories(kinematics.frame_kinematics(kinematics.car_frames(frames, 1.0))).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        for c in ("frame_count", "mean_speed_mps", "speed_std_mps", "mean_abs_jerk_mps3", "observed_stop_transition_count", "stopped_time_ratio", "travel_distance_m", "max_deceleration_mps2"):
            assert getattr(got[k], c) == pytest.approx(getattr(w, c), rel=1e-6, abs=1e-9)
