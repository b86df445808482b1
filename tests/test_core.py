"""Edge tracks, published figures and invariants of the movement-record engine."""

import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetra.config import CORE_FEATURES, SPECS, PreprocessingSpec, QualityConfig
from kinetra.functions.stats import chi_square_tail, ranked
from kinetra.operators import density, eda, interpret, kinematics, metadata, partition, quality, sampling, selection, validation
from kinetra.operators.cluster import kmeans, lloyd
from kinetra.operators.neighbours import hopkins, nearest
from kinetra.operators.preprocess import Preprocessor
from kinetra.sources import archives

COLS = "city string, recording_id string, track_id long, frame_id long, timestamp_ms double, agent_type string, x double, y double, vx double, vy double, a_lon double"


#: Published medians of the four profiles and their violation counts.
MEDIANS = (
    (1, "Smooth and Steady", 9.368795226521748, 1.19574491654536, 0.993201178794218, 0.7994816796120692, 0.4894741734914121, 0.436294856536635, 0.0, 0.0),
    (2, "Stop-and-Go", 9.88294642337032, 2.9281152072196, 1.7898308201423896, 1.7215077675652835, 0.6491265716549842, 0.36063476630204805, 1.0, 0.5908743927827897),
    (3, "Dynamic Speed Adjustment", 10.863837045178915, 2.097874415447933, 1.9552101084808835, 1.9265019839956028, 0.9677535129264199, 0.7804290222704376, 0.0, 0.0),
    (4, "Acceleration-Intensive", 10.70490250106372, 1.910058945888431, 6.843118200006463, 2.1842736689257145, 1.5290667540682843, 1.1111709449200204, 0.0, 0.0),
)
MEDIAN_COLS = "profile_id int, profile_name string, max_speed_mps double, speed_std_mps double, max_acceleration_mps2 double, max_deceleration_mps2 double, acceleration_std_mps2 double, mean_abs_jerk_mps3 double, observed_stop_transition_count double, stopped_time_ratio double"
VIOLATIONS = ((1, 2527, 91), (2, 1127, 11), (3, 633, 26), (4, 246, 10))


def frames(spark, rows):
    return spark.createDataFrame([("c", rec, t, f, ts, a, x, 0.0, v, 0.0, acc) for rec, t, f, ts, a, x, v, acc in rows], COLS)


def tracks_of(spark, rows, stop=0.5):
    return {(r.recording_id, r.track_id): r for r in kinematics.trajectories(kinematics.frame_kinematics(kinematics.car_frames(frames(spark, rows), stop))).collect()}


def test_edge_tracks(spark):
    rows = [
        ("one", 1, 0, 0.0, "car", 0.0, 1.0, 0.5),
        ("dup", 1, 0, 0.0, "car", 0.0, 1.0, 0.0), ("dup", 1, 1, 0.0, "car", 1.0, 1.0, 5.0), ("dup", 1, 2, 1000.0, "car", 2.0, 1.0, 6.0),
        ("stop", 2, 3, 3000.0, "CAR", 2.0, 0.0, 1.0), ("stop", 2, 1, 1000.0, " Car\t", 1.0, 0.1, 1.0), ("stop", 2, 2, 2000.0, "car", 2.0, 3.0, 1.0), ("stop", 2, 0, 0.0, "car", 0.0, 2.0, 1.0),
        ("first", 3, 0, 0.0, "car", 0.0, 0.1, 1.0), ("first", 3, 1, 1000.0, "car", 0.0, 2.0, 1.0),
        ("none", 4, 0, 0.0, "truck", 0.0, 1.0, 1.0), ("none", 5, 0, 0.0, None, 0.0, 1.0, 1.0),
    ]
    got = tracks_of(spark, rows)
    assert set(got) == {("one", 1), ("dup", 1), ("stop", 2), ("first", 3)}
    one = got["one", 1]
    assert (one.frame_count, one.trajectory_duration_s, one.mean_abs_jerk_mps3, one.travel_distance_m, one.speed_std_mps) == (1, 0.0, 0.0, 0.0, 0.0)
    assert got["dup", 1].mean_abs_jerk_mps3 == pytest.approx(1.0)  # the step without time does not count
    assert got["stop", 2].observed_stop_transition_count == 2 and got["stop", 2].stopped_time_ratio == 0.5
    assert got["first", 3].observed_stop_transition_count == 0 and got["first", 3].stopped_time_ratio == 0.5
    assert str(got["stop", 2].max_deceleration_mps2) == "0.0"


def test_thresholds_and_reasons(spark):
    t = spark.createDataFrame([("a", 5.0, 0.5, 0.1), ("b", 4.9, 9.0, 9.0), ("c", 1.0, 0.0, 0.0), ("d", 6.0, 0.5, 0.2)], "trajectory_uid string, trajectory_duration_s double, travel_distance_m double, max_speed_mps double")
    got = {r.trajectory_uid: (r.exclusion_reason, r.is_eligible) for r in quality.add_quality_flags(t, QualityConfig()).collect()}
    assert got == {"a": ("stationary_full_trajectory", False), "b": ("duration_below_5s", False), "c": ("duration_below_5s; stationary_full_trajectory", False), "d": ("", True)}


def test_feature_table_checks(spark):
    bad = spark.createDataFrame([("a", 1.0), ("a", float("inf")), ("b", None)], "trajectory_uid string, v double")
    with pytest.raises(ValueError, match="1 repeated keys; 1 null cells; 1 infinite cells"):
        quality.validate_feature_table(bad, numeric=["v"])
    with pytest.raises(ValueError, match="repeated keys on the right"):
        quality.one_to_one(bad.limit(0), bad, ["trajectory_uid"])


def test_metadata_duplicates_and_missing_columns(spark):
    t = spark.createDataFrame([("c", "r", 1), ("c", "r", 2)], "city string, recording_id string, track_id long")
    m = spark.createDataFrame([("c", "r", 1, 0, "car", " red-light running "), ("c", "r", 1, 1, "bus", "x")], "city string, recording_id string, trackId long, row int, class string, Signal_Violation_Behavior string")
    got = {r.track_id: r for r in metadata.clean_metadata(metadata.attach_metadata(t, m, "row")).collect()}
    assert got[1]["class"] == "car" and got[1].violation_clean == "Red-light running" and got[1].any_violation and got[1].CrossType is None
    assert got[2].any_violation is None


def test_archives(spark, tmp_path):
    head = "Unnamed: 0, track_id ," + "frame_id,timestamp_ms,agent_type,x,y,vx,vy,yaw_rad,heading_rad,length,width,ax,ay,v_lon,v_lat,a_lon,a_lat\n"
    row = "0,7,1,100.1,car," + ",".join(["1.5"] * 14) + "\n"

    def make(path, members):
        path.parent.mkdir(parents=True, exist_ok=True)
        with zipfile.ZipFile(path, "w") as z:
            for n, text in members.items():
                z.writestr(n, text)

    make(tmp_path / "a" / "8_2_1(1).zip", {"deep/" + archives.VEHICLE_MEMBER: head + row, archives.METADATA_MEMBER: "trackId,class\n7,car\n", "Traffic_lights.csv": "x\n"})
    make(tmp_path / "xian_1.zip", {archives.VEHICLE_MEMBER: "a,b\n1,2\n"})
    make(tmp_path / "unrelated_report.zip", {"x.csv": ""})
    (tmp_path / "xian_2.zip").write_bytes(b"no zip")
    found = archives.discover_archives(spark, str(tmp_path)).cache()
    assert sorted((r.city, r.recording_id) for r in found.collect()) == [("Tianjin", "8_2_1"), ("Xi'an", "xian_1"), ("Xi'an", "xian_2")]
    ok, failed = archives.read_frames(found)
    rows = ok.collect()
    assert [(r.track_id, r.timestamp_ms, r.a_lat) for r in rows] == [(7, 100.1, 1.5)]
    assert sorted(r.recording_id for r in failed.collect()) == ["xian_1", "xian_2"]
    with pytest.raises(RuntimeError, match="2 recordings failed"):
        archives.raise_failures(failed, str(tmp_path / "failures"))
    meta = archives.read_metadata(found.where("city = 'Tianjin'")).collect()
    assert [(r.trackId, r["class"], r.CrossType) for r in meta] == [(7, "car", None)]
    audit = {r.recording_id: r for r in archives.audit(found).collect()}
    assert audit["8_2_1"].zip_ok and audit["8_2_1"].traffic_members == 1 and not audit["xian_2"].zip_ok


def test_normalize_columns(spark):
    df = spark.createDataFrame([(0, 1, 2)], "`Unnamed: 0` int, ` a ` int, b int")
    assert archives.normalize_columns(df, ["a", "b"]).columns == ["a", "b"]
    with pytest.raises(ValueError, match="missing columns: z"):
        archives.normalize_columns(df, ["z"])


def counts(spark, rows):
    return spark.createDataFrame(rows, "a int, b string, count long")


def test_published_contingency_figures(spark):
    v = [(k, n, x) for k, n, x in VIOLATIONS]
    cells = counts(spark, [(k, side, c) for k, n, x in v for side, c in (("yes", x), ("no", n - x))])
    row = interpret.chi_square(cells, "a", "b").first()
    assert row.chi_square == pytest.approx(22.279530381696514, rel=1e-9) and row.dof == 3 and row.cramers_v == pytest.approx(0.06522225793762113, rel=1e-9)
    assert chi_square_tail(row.chi_square, 3) == pytest.approx(5.7052927343104517e-05, rel=1e-9)
    crossing = {1: (550, 20, 913, 1044), 2: (289, 33, 56, 749), 3: (172, 4, 221, 236), 4: (36, 2, 74, 134)}
    names = ("Left", "Others", "Right", "Straight")
    cells = counts(spark, [(k, n, c) for k, cs in crossing.items() for n, c in zip(names, cs, strict=True)])
    assert interpret.chi_square(cells, "a", "b").first().chi_square == pytest.approx(454.8431009607324, rel=1e-9)
    row = interpret.chi_square(cells.where("b <> 'Others'"), "a", "b").first()
    assert row.chi_square == pytest.approx(428.14871299636627, rel=1e-9) and row.cramers_v == pytest.approx(0.21725319459460726, rel=1e-9)
    assert chi_square_tail(row.chi_square, 6) == pytest.approx(2.4708416482624245e-89, rel=1e-9)


def test_published_rates_and_attention(spark):
    v = interpret.rates(spark.createDataFrame(VIOLATIONS, "profile_id int, trajectories long, violations long"), ["profile_id"])
    got = {r.profile_id: r for r in v.collect()}
    assert (got[1].wilson_lower, got[1].wilson_upper, got[1].relative_to_overall) == pytest.approx((0.02942238340405992, 0.04400831616543875, 1.1828857039624234))
    a = {r.profile_id: r for r in interpret.attention_matrix(spark.createDataFrame(MEDIANS, MEDIAN_COLS), v).collect()}
    assert [a[k].dynamic_maneuver_priority for k in (1, 2, 3, 4)] == [31.25, 43.75, 75.0, 100.0]
    assert [a[k].signal_queue_priority for k in (1, 2, 3, 4)] == [50.0, 100.0, 50.0, 50.0]
    assert [a[k].speed_adjustment_priority for k in (1, 2, 3, 4)] == pytest.approx([25.0, 66.6666667, 83.3333333, 75.0])
    assert [a[k].attention_tier for k in (1, 2, 3, 4)] == [interpret.TIERS[2], interpret.TIERS[1], interpret.TIERS[0], interpret.TIERS[0]]


def test_published_gate(spark):
    names = "pipeline string, k int, silhouette double, davies_bouldin double, minimum_cluster_share double, balanced_accuracy_mean double"
    rows = [("C_winsor_robust", 2, 0.49, 0.98, 0.099, 0.43), ("A_winsor_standard", 3, 0.34, 1.19, 0.156, 0.44), ("B_raw_robust", 2, 0.54, 0.97, 0.091, 0.43)]
    runs = [(p, k, a, s) for p, k, aris, s in (("C_winsor_robust", 2, (0.957, 0.984, 0.99), 0.093), ("A_winsor_standard", 3, (0.966, 0.989, 0.99), 0.144), ("B_raw_robust", 2, (0.0009, 0.79, 0.99), 5e-05)) for a in aris]
    boot = selection.bootstrap_summary(spark.createDataFrame(runs, "pipeline string, k int, ari double, min_cluster_share double"))
    got = {r.pipeline: (r.passes_gate, r.gated_score) for r in selection.gated_selection(spark.createDataFrame(rows, names).join(boot, ["pipeline", "k"], "left")).collect()}
    passed, score = got["C_winsor_robust"]
    assert passed and 0 < score <= 1
    assert got["B_raw_robust"] == (False, -1.0)


def test_iqr_bounds(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 3, 100)], "v double")
    r = eda.iqr_outliers(df, ["v"]).first()
    assert (r.q1, r.q3, r.lower_bound, r.upper_bound, r.outlier_count, r.outlier_pct) == (1.0, 3.0, -2.0, 6.0, 1, 20.0)


def test_ranks_without_one_task(spark):
    df = spark.createDataFrame([(v,) for v in (3.0, 1.0, 3.0, None, 2.0)], "v double")
    assert sorted((r.v, r.v_rank) for r in ranked(df, ["v"]).collect() if r.v is not None) == [(1.0, 1.0), (2.0, 2.0), (3.0, 3.5), (3.0, 3.5)]


def test_degenerate_partitions(spark):
    df = spark.createDataFrame([(i, -1, float(i)) for i in range(4)], "vec_id long, label int, d double")
    assert partition.cluster_sizes(df).first().n_clusters == 0
    assert partition.davies_bouldin_calinski(df, ["d"]).first().davies_bouldin is None
    assert partition.silhouette(df, "vec_id", ["d"]).first().silhouette is None
    assert partition.normalized_entropy(df).first().entropy == 0.0
    one = df.withColumn("label", F.lit(0))
    assert partition.adjusted_rand(one.withColumn("other", F.lit(1)), "label", "other").first().ari == 1.0
    assert eda.eta_squared(one.withColumn("k", F.lit(2.0)), "label", ["k"]).first().eta_squared == 0.0


def feature_rows(spark, n=120):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 6, (4, 10))
    x = centres[np.arange(n) % 4] + rng.normal(0, 0.5, (n, 10))
    rows = [(f"t{i:03d}", f"c{i % 3}", int(i % 4) + 1, *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "trajectory_uid string, city string, profile_id int, " + ", ".join(f"{f} double" for f in CORE_FEATURES)), x


def test_preprocessing_against_numpy(spark):
    df, x = feature_rows(spark)
    p = Preprocessor(SPECS[2]).fit(df)
    z = x.copy()
    lo, hi = np.quantile(x[:, :8], [0.01, 0.99], axis=0)
    z[:, :8] = np.clip(x[:, :8], lo, hi)
    q1, med, q3 = np.quantile(z, [0.25, 0.5, 0.75], axis=0)
    z = (z - med) / (q3 - q1)
    values = np.linalg.eigvalsh(np.cov(z.T))[::-1]
    assert p.eigenvalues == pytest.approx(values.tolist(), rel=1e-6)
    share = np.cumsum(values) / values.sum()
    assert p.n_components == int(np.searchsorted(share, 0.90, side="right") + 1)
    scores = np.array([[r[c] for c in p.score_columns] for r in p.transform(df).orderBy("trajectory_uid").collect()])
    assert scores.mean(axis=0) == pytest.approx(np.zeros(p.n_components), abs=1e-9)
    assert np.cov(scores.T).diagonal() == pytest.approx(values[: p.n_components], rel=1e-6)
    assert Preprocessor.from_json(p.to_json()).components == p.components
    with pytest.raises(RuntimeError):
        Preprocessor(SPECS[0]).scaled(df)
    with pytest.raises(ValueError):
        Preprocessor(PreprocessingSpec("x", False, "other")).fit(df)


def test_split_validation_finds_clear_profiles(spark):
    df, _ = feature_rows(spark)
    train, test = sampling.hold_out(df, "city", "c1")
    _, _, mapping, out = validation.fit_split(train, test, SPECS[2], "profile_id", 4, 3, 42)
    m = validation.held_out_metrics(out, "profile_id", "predicted").first()
    assert sorted(mapping.values()) == [1, 2, 3, 4] and m.ari == 1.0 and m.all_recovered


def test_assignment_is_best():
    from itertools import permutations

    rng = np.random.default_rng(0)
    for _ in range(20):
        c = rng.integers(0, 9, (4, 4))
        got = validation.best_assignment({(i, j): int(c[i, j]) for i in range(4) for j in range(4)}, range(4), range(4))
        assert sum(c[i, j] for i, j in got.items()) == max(sum(c[i, p[i]] for i in range(4)) for p in permutations(range(4)))


def test_samples_are_exact(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") < 70, "a").otherwise("b").alias("g"))
    assert sampling.uniform_sample(df, "k", 37, 1).count() == 37
    assert sampling.bootstrap_sample(df, "k", 80, 1).count() == 80
    assert {r.g: r["count"] for r in sampling.stratified_sample(df, "g", "k", 11, 1).groupBy("g").count().collect()} == {"a": 8, "b": 3}
    assert sampling.quotas({"a": 1, "b": 1, "c": 1}, 2) == {"a": 1, "b": 1, "c": 0}
    assert sampling.group_subsample(df, ["g"], 0.5, 1).select("g").distinct().count() == 1


def test_density_methods(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 0.1, (40, 2)), rng.normal(5, 0.1, (40, 2)), [[20.0, 20.0]]])
    assert len(set(density.ward_labels(x, 3))) == 3
    assert density.ward_labels(x, 3)[80] not in density.ward_labels(x, 3)[:80]
    h = density.hdbscan_labels(x, 10, 5)
    assert len(set(h[:40]) - {-1}) == 1 and len(set(h[40:80]) - {-1}) == 1 and h[80] == -1 and h[0] != h[45]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "i long, a double, b double")
    got = {r.i: r.label for r in density.dbscan(df, "i", ["a", "b"], 0.5, 4).collect()}
    assert {got[i] for i in range(40)} == {0} and {got[i] for i in range(40, 80)} == {1} and got[80] == -1


def test_kmeans_and_neighbours(spark):
    df = spark.createDataFrame([(i, float(i % 2 * 10 + i * 0.01)) for i in range(20)], "i long, a double")
    m = kmeans(df, ["a"], 2, restarts=2)
    assert m.inertia == pytest.approx(lloyd(df, ["a"], [[0.0], [10.0]], 5).inertia)
    near = nearest(df.select("i", F.array("a").alias("v")), df.limit(1).select("i", F.array("a").alias("v")), "i", "v", 2).orderBy("rank").collect()
    assert [(r.neighbour, r.rank) for r in near] == [(0, 1), (2, 2)]
    assert 0.5 < hopkins(df, "i", ["a"], 10) <= 1
    with pytest.raises(ValueError):
        hopkins(df.limit(2), "i", ["a"])


def test_selection_scores(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0)], "k string, v double")
    got = {r.k: (r.up, r.down) for r in df.select("k", selection.percentile_score("v", False).alias("up"), selection.percentile_score("v", True).alias("down")).collect()}
    assert got["a"] == pytest.approx((1 / 3, 1.0)) and got["b"] == pytest.approx((2.5 / 3, 1 - 2.5 / 3 + 1 / 3))


def test_every_registered_sql_has_a_query():
    from kinetra import catalogue

    assert set(catalogue.oracle_sql()) <= set(catalogue.queries()) and len(catalogue.queries()) > 90




def test_speed_at_the_stop_threshold_is_that_of_sql(spark):
    """2.8 / 10 (a bit below 0.28) and 0.96 give a speed of exactly 1.0 by sqrt(vx * vx + vy * vy): not below the threshold of 1.0."""
    moves = [(2.8 / 10, 0.96), (0.6, 0.8), (0.28, 0.95)]
    rows = [("c", "r", 1, k, float(k), "car", 0.0, 0.0, vx, vy, 0.0) for k, (vx, vy) in enumerate(moves)]
    got = [(r.speed, r.stopped) for r in kinematics.car_frames(spark.createDataFrame(rows, COLS), 1.0).orderBy("frame_id").collect()]
    assert got == [(s, s < 1.0) for s in (float(np.sqrt(vx * vx + vy * vy)) for vx, vy in moves)] and [s for _, s in got] == [False, False, True]
