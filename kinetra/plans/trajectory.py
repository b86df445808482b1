"""Queries from frames to the modelling feature table, inventories and descriptive statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.config import CORE_FEATURES
from kinetra.operators import eda, kinematics, metadata, quality, sampling
from kinetra.plans.registry import c, query, r, rounded
from kinetra.sources import adapters
from kinetra.sources.adapters import FRAMES_SQL, METADATA_SQL, QUALITY, frames, table
from kinetra.sources.archives import archive_name_rules as name_rules

CORE = ", ".join(CORE_FEATURES)
NUMERIC = ("trajectory_duration_s", "travel_distance_m", "position_span_m", *CORE_FEATURES[:8], "stopped_time_ratio")

CARS_SQL = FRAMES_SQL + """, cars AS (
  SELECT *, sqrt(vx * vx + vy * vy) AS speed, coalesce(sqrt(vx * vx + vy * vy) < 1.0, false) AS stopped
  FROM frames WHERE lower(regexp_replace(agent_type, '^\\s+|\\s+$', '', 'g')) = 'car')"""
KIN_SQL = CARS_SQL + """, lagged AS (
  SELECT *, (timestamp_ms - lag(timestamp_ms) OVER w) / 1000.0 AS dt_s, a_lon - lag(a_lon) OVER w AS da,
    x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, lag(stopped) OVER w AS was
  FROM cars WINDOW w AS (PARTITION BY city, recording_id, track_id ORDER BY timestamp_ms, frame_id)),
kin AS (
  SELECT *, coalesce(sqrt(dx * dx + dy * dy), 0.0) AS step_m, CAST(coalesce(NOT was AND stopped, false) AS INTEGER) AS stop_transition,
    CASE WHEN dt_s > 0 THEN da / dt_s END AS jerk
  FROM lagged)"""
TRAJ_SQL = KIN_SQL + """, traj AS (
  SELECT city || '__' || recording_id || '__' || CAST(track_id AS VARCHAR) AS trajectory_uid, city, recording_id, track_id,
    min(timestamp_ms) AS start_timestamp_ms, max(timestamp_ms) AS end_timestamp_ms, (max(timestamp_ms) - min(timestamp_ms)) / 1000.0 AS trajectory_duration_s,
    count(*) AS frame_count, avg(speed) AS mean_speed_mps, max(speed) AS max_speed_mps, coalesce(stddev_pop(speed), 0.0) AS speed_std_mps,
    avg(a_lon) AS mean_long_acc_mps2, greatest(max(a_lon), 0.0) AS max_acceleration_mps2, 0.0 - least(min(a_lon), 0.0) AS max_deceleration_mps2,
    coalesce(stddev_pop(a_lon), 0.0) AS acceleration_std_mps2, coalesce(avg(abs(jerk)), 0.0) AS mean_abs_jerk_mps3,
    CAST(sum(stop_transition) AS BIGINT) AS observed_stop_transition_count, avg(CASE WHEN stopped THEN 1.0 ELSE 0.0 END) AS stopped_time_ratio,
    sum(step_m) AS travel_distance_m, sqrt((max(x) - min(x)) * (max(x) - min(x)) + (max(y) - min(y)) * (max(y) - min(y))) AS position_span_m
  FROM kin GROUP BY city, recording_id, track_id)"""
FLAG_SQL = TRAJ_SQL + """, flagged0 AS (
  SELECT *, trajectory_duration_s < 6.7 AS is_short, travel_distance_m <= 2700.0 AND max_speed_mps <= 18.0 AS is_stationary FROM traj),
flagged AS (
  SELECT *, concat_ws('; ', CASE WHEN is_short THEN 'duration_below_6.7s' END, CASE WHEN is_stationary THEN 'stationary_full_trajectory' END) AS exclusion_reason,
    NOT is_short AND NOT is_stationary AS is_eligible
  FROM flagged0)"""
FEAT_SQL = FLAG_SQL + ", feats AS (SELECT * FROM flagged WHERE is_eligible)"
META_SQL = FEAT_SQL + ", " + METADATA_SQL + """, meta AS (
  SELECT f.*, m.class, m.CrossType, m.Signal_Violation_Behavior, trim(m.CrossType) AS crossing_clean,
    CASE trim(m.Signal_Violation_Behavior) WHEN 'No violation of traffic lights' THEN 'No violation' WHEN 'yellow-light running' THEN 'Yellow-light running' WHEN 'red-light running' THEN 'Red-light running' END AS violation_clean
  FROM feats f LEFT JOIN metadata m USING (city, recording_id, track_id))"""


def cars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kinematics.car_frames(frames(spark, sf_dir), QUALITY.stop_speed_mps)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kinematics.trajectories(kinematics.frame_kinematics(cars(spark, sf_dir)))


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.add_quality_flags(tracks(spark, sf_dir), QUALITY)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.model_features(flagged(spark, sf_dir))


def with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.attach_metadata(features(spark, sf_dir), adapters.metadata(spark, sf_dir), "row")


#: File names of the kinds that archives have, two that no rule fits among them, around the keys of a table.
NAME_KINDS = (("changchun_", ".zip"), ("site_NR_", ".zip"), ("Xian_", ".v2.zip"), ("", "_2_1.zip"), ("", "_2_1(1).zip"), ("unrelated_report_", ".zip"), ("", "_2.zip"))


@query(
    f"""WITH names AS (SELECT CASE s_suppkey % {len(NAME_KINDS)} {' '.join(f"WHEN {k} THEN '{a}' || s_suppkey || '{z}'" for k, (a, z) in enumerate(NAME_KINDS))} END AS name FROM supplier), stems AS (SELECT name, replace(regexp_replace(name, '\\.[^.]*$', ''), '(1)', '') AS stem FROM names)
    SELECT name, CASE WHEN lower(stem) LIKE 'changchun\\_%' ESCAPE '\\' THEN 'Changchun' WHEN lower(stem) LIKE '%\\_nr\\_%' ESCAPE '\\' THEN 'Chongqing' WHEN lower(stem) LIKE 'xian\\_%' ESCAPE '\\' THEN 'Xi''an' WHEN regexp_full_match(stem, '[0-9]+_[0-9]+_[0-9]+') THEN 'Tianjin' END AS city,
      CASE WHEN lower(stem) LIKE 'changchun\\_%' ESCAPE '\\' OR lower(stem) LIKE '%\\_nr\\_%' ESCAPE '\\' OR lower(stem) LIKE 'xian\\_%' ESCAPE '\\' OR regexp_full_match(stem, '[0-9]+_[0-9]+_[0-9]+') THEN stem END AS recording_id FROM stems"""
)
def archive_name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name rules over file names made from the supplier keys."""
    key = F.col("s_suppkey")
    names = F.coalesce(*[F.when(key % len(NAME_KINDS) == k, F.concat(F.lit(a), key.cast("string"), F.lit(z))) for k, (a, z) in enumerate(NAME_KINDS)])
    return name_rules(table(spark, sf_dir, "supplier").select(names.alias("name")), "name")


@query("WITH " + CARS_SQL + (f" SELECT city, recording_id, track_id, frame_id, stopped, {r('speed', 'speed_sq=speed * speed', 'a_lon_sq=a_lon * a_lon')} FROM cars"))
def car_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cars(spark, sf_dir).select("city", "recording_id", "track_id", "frame_id", "stopped", "speed", "speed_sq", "a_lon_sq"))


@query(f"WITH {KIN_SQL} SELECT city, recording_id, track_id, frame_id, stop_transition, {r('dt_s', 'step_m')}, {r('jerk', digits=3)} FROM kin")
def frame_kinematics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = kinematics.frame_kinematics(cars(spark, sf_dir))
    return rounded(k.select("city", "recording_id", "track_id", "frame_id", "stop_transition", "dt_s", "step_m", F.round("jerk", 3).alias("jerk")))


UID = "trajectory_uid, city, recording_id, track_id"


@query(f"WITH {TRAJ_SQL} SELECT {UID}, frame_count, observed_stop_transition_count, {r(*NUMERIC)} FROM traj")
def trajectory_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tracks(spark, sf_dir).select(*UID.split(", "), "frame_count", "observed_stop_transition_count", *NUMERIC))


@query(f"WITH {FLAG_SQL} SELECT trajectory_uid, is_short, is_stationary, exclusion_reason, is_eligible FROM flagged")
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).select("trajectory_uid", "is_short", "is_stationary", "exclusion_reason", "is_eligible")


@query(f"WITH {FLAG_SQL} SELECT {UID}, {r('trajectory_duration_s')}, frame_count, {r('travel_distance_m', 'max_speed_mps')}, is_short, is_stationary, exclusion_reason FROM flagged WHERE NOT is_eligible")
def exclusion_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.exclusion_log(flagged(spark, sf_dir)))


@query(f"WITH {FEAT_SQL} SELECT {UID}, frame_count, observed_stop_transition_count, {r(*NUMERIC)} FROM feats")
def model_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features(spark, sf_dir))


@query(f"WITH {FLAG_SQL} SELECT exclusion_reason, count(*) AS count FROM flagged GROUP BY exclusion_reason")
def exclusion_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).groupBy("exclusion_reason").count()


INV_SQL = f"""{FRAMES_SQL}, inv AS (SELECT city, recording_id, count(*) AS vehicle_rows, count(DISTINCT track_id) AS vehicle_tracks,
  count(DISTINCT CASE WHEN lower(trim(agent_type)) = 'car' THEN track_id END) AS car_tracks,
  CAST(sum(CAST(track_id IS NULL AS INTEGER) + CAST(frame_id IS NULL AS INTEGER) + CAST(timestamp_ms IS NULL AS INTEGER) + CAST(agent_type IS NULL AS INTEGER)) AS BIGINT) AS missing_cells
  FROM frames GROUP BY city, recording_id)"""


@query(f"WITH {INV_SQL} SELECT * FROM inv")
def recording_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.recording_inventory(frames(spark, sf_dir))


@query(f"WITH {INV_SQL} SELECT city, count(*) AS recordings, {c('vehicle_rows=sum(vehicle_rows)', 'vehicle_tracks=sum(vehicle_tracks)', 'car_tracks=sum(car_tracks)', 'missing_cells=sum(missing_cells)')} FROM inv GROUP BY city")
def city_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.city_inventory(quality.recording_inventory(frames(spark, sf_dir)))


PROC_SQL = f"""{FLAG_SQL}, raw AS (SELECT city, recording_id, count(*) AS raw_rows, count(DISTINCT track_id) AS raw_tracks,
  count(CASE WHEN lower(trim(agent_type)) = 'car' THEN 1 END) AS car_rows FROM frames GROUP BY city, recording_id),
carsum AS (SELECT city, recording_id, count(*) AS car_tracks, count(CASE WHEN is_short THEN 1 END) AS short_tracks, count(CASE WHEN is_stationary THEN 1 END) AS stationary_tracks,
  count(CASE WHEN is_short AND is_stationary THEN 1 END) AS short_and_stationary, count(CASE WHEN NOT is_eligible THEN 1 END) AS excluded_tracks, count(CASE WHEN is_eligible THEN 1 END) AS eligible_tracks
  FROM flagged GROUP BY city, recording_id),
proc AS (SELECT city, recording_id, raw_rows, raw_tracks, car_rows, coalesce(car_tracks, 0) AS car_tracks, coalesce(short_tracks, 0) AS short_tracks, coalesce(stationary_tracks, 0) AS stationary_tracks,
  coalesce(short_and_stationary, 0) AS short_and_stationary, coalesce(excluded_tracks, 0) AS excluded_tracks, coalesce(eligible_tracks, 0) AS eligible_tracks FROM raw LEFT JOIN carsum USING (city, recording_id))"""


@query(f"WITH {PROC_SQL} SELECT * FROM proc")
def recording_processing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.processing_summary(frames(spark, sf_dir), flagged(spark, sf_dir))


@query(f"WITH {PROC_SQL} SELECT city, count(*) AS recordings, {c(*[f'{n}=sum({n})' for n in quality.SUMMED])} FROM proc GROUP BY city")
def city_processing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.city_processing_summary(recording_processing_summary(spark, sf_dir))


@query(
    f"""WITH {FRAMES_SQL}, d AS (SELECT *, timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY city, recording_id, track_id ORDER BY timestamp_ms, frame_id) AS dt FROM frames),
    s AS (SELECT city, recording_id, count(CASE WHEN dt <= 0 THEN 1 END) AS non_positive_steps, round(median(CASE WHEN dt > 0 THEN dt END), 6) AS median_step_ms, count(*) AS rows FROM d GROUP BY ALL),
    f AS (SELECT city, recording_id, CAST(sum(n - 1) AS BIGINT) AS repeated_frames FROM (SELECT city, recording_id, track_id, frame_id, count(*) AS n FROM frames GROUP BY ALL) GROUP BY ALL),
    t AS (SELECT city, recording_id, CAST(sum(n - 1) AS BIGINT) AS repeated_times FROM (SELECT city, recording_id, track_id, timestamp_ms, count(*) AS n FROM frames GROUP BY ALL) GROUP BY ALL),
    m AS (SELECT city, recording_id, count(CASE WHEN n > 1 THEN 1 END) AS mixed_type_tracks FROM (SELECT city, recording_id, track_id, count(DISTINCT agent_type) AS n FROM frames GROUP BY ALL) GROUP BY ALL)
    SELECT city, recording_id, non_positive_steps, median_step_ms, rows, repeated_frames, repeated_times, mixed_type_tracks FROM s JOIN f USING (city, recording_id) JOIN t USING (city, recording_id) JOIN m USING (city, recording_id)"""
)
def frame_quality_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.frame_quality_audit(frames(spark, sf_dir)))


@query(f"WITH {FEAT_SQL} SELECT count(*) AS rows, count(DISTINCT trajectory_uid) AS distinct_keys, {c('null_cells=' + ' + '.join(f'count(CASE WHEN {f} IS NULL THEN 1 END)' for f in ('trajectory_uid', *CORE_FEATURES)), 'infinite_cells=' + ' + '.join(f'count(CASE WHEN isnan(CAST({f} AS DOUBLE)) OR isinf(CAST({f} AS DOUBLE)) THEN 1 END)' for f in CORE_FEATURES))} FROM feats")
def feature_table_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.validation_counts(features(spark, sf_dir), "trajectory_uid", CORE_FEATURES)


@query(f"WITH {META_SQL} SELECT trajectory_uid, class, CrossType, Signal_Violation_Behavior FROM meta")
def metadata_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_metadata(spark, sf_dir).select("trajectory_uid", *metadata.COLUMNS)


@query(f"WITH {META_SQL} SELECT city, count(*) AS rows, count(class) AS with_class, count(CrossType) AS with_crosstype, count(Signal_Violation_Behavior) AS with_signal_violation_behavior FROM meta GROUP BY city")
def metadata_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.availability(with_metadata(spark, sf_dir))


@query(f"WITH {META_SQL} SELECT trajectory_uid, crossing_clean, violation_clean, violation_clean <> 'No violation' AS any_violation FROM meta")
def metadata_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.clean_metadata(with_metadata(spark, sf_dir)).select("trajectory_uid", "crossing_clean", "violation_clean", "any_violation")


@query(f"WITH {FEAT_SQL} SELECT trajectory_uid, CASE WHEN city = 'Tianjin' THEN 'test' ELSE 'train' END AS side FROM feats")
def hold_out_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = sampling.hold_out(features(spark, sf_dir), "city", "Tianjin")
    return train.select("trajectory_uid", F.lit("train").alias("side")).unionByName(test.select("trajectory_uid", F.lit("test").alias("side")))


@query(f"WITH {FEAT_SQL}, g AS (SELECT city, recording_id, row_number() OVER (ORDER BY city, recording_id) - 1 AS n FROM (SELECT DISTINCT city, recording_id FROM feats)) SELECT trajectory_uid FROM feats JOIN g USING (city, recording_id) WHERE n >= 2 AND n < 5")
def recording_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.group_slice(features(spark, sf_dir), ["city", "recording_id"], 2, 5).select("trajectory_uid")


def _describe_sql(base: str, src: str, cols) -> str:
    parts = []
    for f in cols:
        q = ", ".join(r(f"p{int(p * 100):02d}=quantile_cont(v, {p})") for p in eda.PERCENTS)
        parts.append(f"SELECT '{f}' AS feature, count(v) AS count, {r('mean=avg(v)', 'std=stddev_samp(v)', 'min=min(v)')}, {q}, {r('max=max(v)')} FROM (SELECT CAST({f} AS DOUBLE) AS v FROM {src})")
    return (f"WITH {base} " if base else "") + " UNION ALL ".join(parts)


@query(_describe_sql(FEAT_SQL, "feats", CORE_FEATURES))
def feature_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(eda.describe(features(spark, sf_dir), CORE_FEATURES))


ITEM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(_describe_sql("", "lineitem", ITEM))
def lineitem_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(eda.describe(table(spark, sf_dir, "lineitem"), ITEM))


@query(f"WITH {FEAT_SQL} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, CASE WHEN stddev_pop({f}) > 0 THEN round(skewness({f}), 6) + 0.0 END AS skewness FROM feats" for f in CORE_FEATURES))
def feature_skewness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(eda.skewness(features(spark, sf_dir), CORE_FEATURES))


@query(f"WITH {FEAT_SQL} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(100.0 * avg(CASE WHEN {f} = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_pct FROM feats" for f in CORE_FEATURES))
def zero_percentage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(eda.zero_percentage(features(spark, sf_dir), CORE_FEATURES))


def _iqr_sql(base: str, src: str, cols) -> str:
    one = "SELECT '{f}' AS feature, " + r("q1=any_value(q1)", "q3=any_value(q3)", "iqr=any_value(q3 - q1)", "lower_bound=any_value(q1 - 1.5 * (q3 - q1))", "upper_bound=any_value(q3 + 1.5 * (q3 - q1))") + ", count(CASE WHEN v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) THEN 1 END) AS outlier_count, " + r("outlier_pct=100.0 * avg(CASE WHEN v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) THEN 1.0 ELSE 0.0 END)") + " FROM (SELECT CAST({f} AS DOUBLE) AS v FROM {src}), (SELECT quantile_cont(CAST({f} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({f} AS DOUBLE), 0.75) AS q3 FROM {src})"
    return (f"WITH {base} " if base else "") + " UNION ALL ".join(one.format(f=f, src=src) for f in cols)


@query(_iqr_sql(FEAT_SQL, "feats", CORE_FEATURES))
def iqr_outlier_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(eda.iqr_outliers(features(spark, sf_dir), CORE_FEATURES))


@query(_iqr_sql("", "lineitem", ITEM))
def lineitem_iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(eda.iqr_outliers(table(spark, sf_dir, "lineitem"), ITEM))


def _ranks_sql(src: str, cols) -> str:
    return "SELECT *, " + ", ".join(f"rank() OVER (ORDER BY {f}) + (count(*) OVER (PARTITION BY {f}) - 1) / 2.0 AS {f}_rank" for f in cols) + f" FROM {src}"


@query(f"WITH {FEAT_SQL}, k AS ({_ranks_sql('feats', CORE_FEATURES)}) " + " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}_rank, {b}_rank), 6) + 0.0 AS rho FROM k" for a in CORE_FEATURES for b in CORE_FEATURES))
def spearman_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(eda.spearman(features(spark, sf_dir), CORE_FEATURES))


@query(f"WITH k AS ({_ranks_sql('lineitem', ITEM)}) " + " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}_rank, {b}_rank), 6) + 0.0 AS rho FROM k" for a in ITEM for b in ITEM))
def lineitem_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(eda.spearman(table(spark, sf_dir, "lineitem"), ITEM))


@query(f"WITH {FEAT_SQL} SELECT city, {r(*[f'{f}=median({f})' for f in CORE_FEATURES])} FROM feats GROUP BY city")
def city_feature_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(eda.group_statistic(features(spark, sf_dir), ["city"], CORE_FEATURES, "median"))


def eta_sql(src: str, group: str, pairs) -> str:
    one = "SELECT '{name}' AS feature, CASE WHEN max(sst) > 1e-12 THEN round(sum(n * (m - g) * (m - g)) / max(sst), 6) + 0.0 ELSE 0.0 END AS eta_squared FROM (SELECT {group}, count(*) AS n, avg({f}) AS m FROM {src} GROUP BY {group}), (SELECT avg({f}) AS g, var_pop({f}) * count(*) AS sst FROM {src})"
    return " UNION ALL ".join(one.format(name=name, f=f, src=src, group=group) for name, f in pairs)


@query(f"WITH {FEAT_SQL}, k AS ({_ranks_sql('feats', CORE_FEATURES)}) " + eta_sql("k", "city", [(f, f + "_rank") for f in CORE_FEATURES]))
def rank_eta_squared_by_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinetra.functions.stats import ranked

    t = ranked(features(spark, sf_dir).select("city", *CORE_FEATURES), CORE_FEATURES)
    renamed = t.select("city", *[F.col(f"{f}_rank").alias(f) for f in CORE_FEATURES])
    return rounded(eda.eta_squared(renamed, "city", CORE_FEATURES))


@query(f"WITH {FEAT_SQL} SELECT city, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percentage FROM feats GROUP BY city")
def city_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(eda.group_counts(features(spark, sf_dir), ["city"]))


@query(f"WITH {FEAT_SQL} SELECT city, recording_id, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY city), 6) AS percentage FROM feats GROUP BY city, recording_id")
def recording_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(eda.group_counts(features(spark, sf_dir), ["city", "recording_id"], ["city"]))


@query(f"WITH {FEAT_SQL} SELECT city, recording_id, count(*) AS count FROM feats GROUP BY city, recording_id ORDER BY count, city, recording_id LIMIT 10")
def smallest_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-10 report."""
    return features(spark, sf_dir).groupBy("city", "recording_id").count().orderBy("count", "city", "recording_id").limit(10)
