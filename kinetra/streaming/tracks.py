"""Trajectory summaries over a stream of frames.

The state of a track is its last frame and running sums, of fixed size; each trigger emits the track's summary so far, with
the same definitions as the batch aggregate. Frames must arrive in time order within a track across triggers; a frame older
than the last one seen is counted in `late_frames` and left out. A track is dropped from the state when the watermark has
passed its last frame by the idle time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinetra.config import TRACK_KEY

SUMS = ("frames", "speed", "speed_sq", "max_speed", "acc", "acc_sq", "max_acc", "min_acc", "jerk", "jerks", "transitions", "stopped", "distance", "late")
LAST = ("first_ms", "last_ms", "last_x", "last_y", "last_acc", "last_stopped")
STATE = ", ".join(f"{n} double" for n in (*SUMS, *LAST))
OUTPUT = "city string, recording_id string, track_id long, frame_count long, late_frames long, trajectory_duration_s double, mean_speed_mps double, max_speed_mps double, speed_std_mps double, mean_long_acc_mps2 double, max_acceleration_mps2 double, max_deceleration_mps2 double, acceleration_std_mps2 double, mean_abs_jerk_mps3 double, observed_stop_transition_count long, stopped_time_ratio double, travel_distance_m double"


def _fold(s: dict[str, float], rows: pd.DataFrame, stop_speed: float) -> None:
    """Adds frames, in time order, to the sums."""
    rows = rows.sort_values(["timestamp_ms", "frame_id"])
    if s["frames"]:
        late = rows.timestamp_ms < s["last_ms"]
        s["late"] += int(late.sum())
        rows = rows[~late]
    if rows.empty:
        return
    t, x, y, acc = (rows[c].to_numpy(dtype=float) for c in ("timestamp_ms", "x", "y", "a_lon"))
    vx, vy = rows.vx.to_numpy(dtype=float), rows.vy.to_numpy(dtype=float)
    speed = np.sqrt(vx * vx + vy * vy)  # as `kinematics.length`
    stopped = speed < stop_speed
    if s["frames"]:
        t, x, y, acc = (np.concatenate([[s[k]], v]) for k, v in (("last_ms", t), ("last_x", x), ("last_y", y), ("last_acc", acc)))
        was = np.concatenate([[bool(s["last_stopped"])], stopped])
    else:
        was = stopped
        s.update(first_ms=t[0], max_speed=-np.inf, max_acc=-np.inf, min_acc=np.inf)
    new = acc[-len(speed) :]
    dt = np.diff(t) / 1000.0
    ok = dt > 0
    jerk = np.abs(np.diff(acc)[ok] / dt[ok])
    s["jerk"] += jerk.sum()
    s["jerks"] += len(jerk)
    s["distance"] += np.sqrt(np.diff(x) ** 2 + np.diff(y) ** 2).sum()
    s["transitions"] += int((~was[:-1] & was[1:]).sum())
    s["frames"] += len(speed)
    s["stopped"] += int(stopped.sum())
    s["speed"] += speed.sum()
    s["speed_sq"] += (speed**2).sum()
    s["acc"] += new.sum()
    s["acc_sq"] += (new**2).sum()
    s["max_speed"] = max(s["max_speed"], speed.max())
    s["max_acc"], s["min_acc"] = max(s["max_acc"], new.max()), min(s["min_acc"], new.min())
    s.update(last_ms=t[-1], last_x=x[-1], last_y=y[-1], last_acc=acc[-1], last_stopped=float(stopped[-1]))


def _summary(key: tuple, s: dict[str, float]) -> pd.DataFrame:
    n = s["frames"]
    std = lambda a, b: float(np.sqrt(max(0.0, b / n - (a / n) ** 2)))
    row = (*key, int(n), int(s["late"]), (s["last_ms"] - s["first_ms"]) / 1000.0, s["speed"] / n, s["max_speed"], std(s["speed"], s["speed_sq"]), s["acc"] / n, max(s["max_acc"], 0.0), 0.0 - min(s["min_acc"], 0.0), std(s["acc"], s["acc_sq"]), s["jerk"] / s["jerks"] if s["jerks"] else 0.0, int(s["transitions"]), s["stopped"] / n, s["distance"])
    return pd.DataFrame([row], columns=[c.split()[0] for c in OUTPUT.split(", ")])


def track_summaries(car_frames: DataFrame, event_time: str, stop_speed: float, late_by: str = "10 minutes", idle_ms: int = 600_000) -> DataFrame:
    """A streaming DataFrame of summaries (output mode update). car_frames: frames of cars with a timestamp column for the watermark."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        s = dict(zip((*SUMS, *LAST), state.get, strict=True)) if state.exists else dict.fromkeys((*SUMS, *LAST), 0.0)
        rows = pd.concat(list(batches))
        _fold(s, rows, stop_speed)
        state.update(tuple(float(s[k]) for k in (*SUMS, *LAST)))
        newest = int(pd.Timestamp(rows[event_time].max()).value // 1_000_000)
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), newest) + idle_ms)
        yield _summary(key, s)

    return car_frames.withWatermark(event_time, late_by).groupBy(*TRACK_KEY).applyInPandasWithState(step, OUTPUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)
