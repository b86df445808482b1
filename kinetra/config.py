"""Frozen settings of the engine's stages."""

from __future__ import annotations

from dataclasses import dataclass

#: The core behaviour features in order; the first eight are continuous and are winsorized.
CORE_FEATURES = (
    "mean_speed_mps",
    "max_speed_mps",
    "speed_std_mps",
    "mean_long_acc_mps2",
    "max_acceleration_mps2",
    "max_deceleration_mps2",
    "acceleration_std_mps2",
    "mean_abs_jerk_mps3",
    "observed_stop_transition_count",
    "stopped_time_ratio",
)
CONTINUOUS_FEATURES = CORE_FEATURES[:8]
TRACK_KEY = ("city", "recording_id", "track_id")
CONTEXT = ("trajectory_uid", *TRACK_KEY)


@dataclass(frozen=True)
class QualityConfig:
    min_duration_s: float = 5.0
    stationary_distance_m: float = 0.5
    stationary_speed_mps: float = 0.1
    stop_speed_mps: float = 0.5


@dataclass(frozen=True)
class EvaluationConfig:
    silhouette_sample: int = 5_000
    seed: int = 42


@dataclass(frozen=True)
class PreprocessingSpec:
    name: str
    winsorize: bool
    scaler: str  # standard or robust
    variance: float = 0.90
    lower: float = 0.01
    upper: float = 0.99


SPECS = (PreprocessingSpec("A", True, "standard"), PreprocessingSpec("B", False, "robust"), PreprocessingSpec("C", True, "robust"))


@dataclass(frozen=True)
class ValidationConfig:
    k: int = 4
    city_restarts: int = 50
    recording_restarts: int = 20
    seed: int = 42
