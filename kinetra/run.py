"""The run as a whole: archives to trajectories, features, preprocessing, models, named profiles, validation and interpretation.

Each stage reads tables of the stages before it from the run's folder and stores its own there (Parquet; report tables as CSV
too; choices and models as JSON). A stage that is done is skipped, so a run that was broken off goes on where it stopped.

    run(spark, "hdfs://.../archives", "hdfs://.../run1")
"""

from __future__ import annotations

import functools
import json
import logging
import time
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.config import CORE_FEATURES, SPECS, EvaluationConfig, QualityConfig, ValidationConfig
from kinetra.functions.quantiles import medians
from kinetra.functions.text import slug
from kinetra.operators import cluster, density, eda, interpret, kinematics, metadata, neighbours, partition, predictability, quality, sampling, selection, validation
from kinetra.operators.mixture import gaussian_mixtures
from kinetra.operators.preprocess import Preprocessor
from kinetra.sources import archives

log = logging.getLogger("kinetra.run")
KEY = "trajectory_uid"
PROFILE = ("profile_id", "profile_name")


@dataclass(frozen=True)
class RunConfig:
    """Sizes of the grids and samples of a run."""

    quality: QualityConfig = field(default_factory=QualityConfig)
    validation: ValidationConfig = field(default_factory=ValidationConfig)
    evaluation: EvaluationConfig = field(default_factory=EvaluationConfig)
    ks: tuple[int, ...] = (2, 3, 4, 5, 6, 7, 8)
    restarts: int = 8
    final_restarts: int = 50
    seeds: tuple[int, ...] = (42, 43, 44)
    bootstraps: int = 20
    hopkins_repeats: int = 10
    hopkins_points: int = 1_000
    mixture_ks: tuple[int, ...] = (2, 3, 4, 5, 6)
    ward_ks: tuple[int, ...] = (2, 3, 4, 5, 6)
    ward_sample: int = 4_000
    density_sample: int = 7_000
    benchmark_silhouette: int = 1_500
    eps_quantiles: tuple[float, ...] = (0.80, 0.90, 0.95)
    min_samples: tuple[int, ...] = (5, 15)
    hdbscan: tuple[tuple[int, int], ...] = ((50, 5), (50, 15), (100, 10), (100, 15), (150, 10), (150, 15))
    representatives: int = 5


class Store:
    """Tables, report files and settings of one run in a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def has(self, name: str) -> bool:
        return self._exists(f"{self.root}/tables/{name}/_SUCCESS")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/tables/{name}")

    def put(self, name: str, df: DataFrame, report: bool = False) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/tables/{name}")
        out = self.table(name)
        if report:
            out.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{self.root}/reports/{name}")
        return out

    def put_json(self, name: str, text: str) -> None:
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/config/{name}")

    def json(self, name: str) -> str:
        return self.spark.read.text(f"{self.root}/config/{name}", wholetext=True).first().value.rstrip("\n")

    def has_json(self, name: str) -> bool:
        return self._exists(f"{self.root}/config/{name}/_SUCCESS")


def _read_whole(store: Store, name: str) -> DataFrame:
    return store.table(name).where("status = 'ok'").drop("status", "error")


def read_recordings(store: Store, config: RunConfig, source: str) -> None:
    """Frames and metadata of all archives, each parsed once; members that fail are listed together and end the run."""
    store.put("archive_audit", archives.audit_members(store.spark, source), report=True)
    frames = store.put("frames", archives.read_rows(store.spark, source, archives.VEHICLE_MEMBER, archives.FRAME_SCHEMA))
    metadata_rows = store.put("metadata", archives.read_rows(store.spark, source, archives.METADATA_MEMBER, archives.METADATA_SCHEMA, required=False))
    failed = [t.where("status = 'failed'").select(F.lit(m).alias("member"), "city", "recording_id", "source_archive", "error") for t, m in ((frames, archives.VEHICLE_MEMBER), (metadata_rows, archives.METADATA_MEMBER))]
    archives.raise_failures(failed[0].unionByName(failed[1]), f"{store.root}/reports/failed_recordings")


def build_features(store: Store, config: RunConfig, source: str) -> None:
    frames = _read_whole(store, "frames")
    recordings = store.put("recording_inventory", quality.recording_inventory(frames), report=True)
    store.put("city_inventory", quality.city_inventory(recordings), report=True)
    tracks = kinematics.trajectories(kinematics.frame_kinematics(kinematics.car_frames(frames, config.quality.stop_speed_mps)))
    flagged = store.put("trajectories", quality.add_quality_flags(tracks, config.quality))
    store.put("exclusions", quality.exclusion_log(flagged), report=True)
    by_recording = store.put("processing_by_recording", quality.processing_summary(frames, flagged), report=True)
    store.put("processing_by_city", quality.city_processing_summary(by_recording), report=True)
    features = store.put("features", quality.model_features(flagged))
    quality.validate_feature_table(features)
    validation.require_subset(features, flagged, [KEY])
    store.put("frame_audit", quality.frame_quality_audit(frames), report=True)


def explore(store: Store, config: RunConfig, source: str) -> None:
    t = store.table("features")
    for name, df in (("describe", eda.describe(t, CORE_FEATURES)), ("skewness", eda.skewness(t, CORE_FEATURES)), ("zero_share", eda.zero_percentage(t, CORE_FEATURES)), ("outliers", eda.iqr_outliers(t, CORE_FEATURES)), ("spearman", eda.spearman(t, CORE_FEATURES)), ("city_medians", eda.group_statistic(t, ["city"], CORE_FEATURES, "median")), ("city_eta_squared", eda.eta_squared(t, "city", CORE_FEATURES)), ("city_counts", eda.group_counts(t, ["city"])), ("recording_counts", eda.group_counts(t, ["city", "recording_id"], ["city"]))):
        store.put(name, df, report=True)


def _rows(store: Store, rows: Sequence[tuple], schema: str) -> DataFrame:
    return store.spark.createDataFrame(rows, schema)


def _scores(store: Store, spec: str) -> tuple[Preprocessor, DataFrame]:
    return Preprocessor.from_json(store.json(f"preprocessor_{spec}")), store.table(f"scores_{spec}")


def _quality(df: DataFrame, columns: Sequence[str], sample: int) -> dict:
    """Sizes, silhouette and indices of a labelled table, as one row on the driver."""
    one = partition.cluster_sizes(df).crossJoin(partition.davies_bouldin_calinski(df, columns)).crossJoin(partition.normalized_entropy(df)).first().asDict()  # a row each
    return one | {"silhouette": partition.silhouette(df, KEY, columns, sample=sample).first()[0], "minimum_cluster_share": (one["min_pct"] or 0.0) / 100.0}


def choose_preprocessing(store: Store, config: RunConfig, source: str) -> None:
    """Each specification: components, clustering tendency, how well the city can be told, k-means over k with seed and bootstrap stability; the best by gate and score is kept."""
    t = store.table("features")
    sweep, hopkins, cities, boots, loadings, variances = [], [], [], [], [], []
    for spec in SPECS:
        pre = Preprocessor(spec).fit(t)
        store.put_json(f"preprocessor_{spec.name}", pre.to_json())
        columns, scores = pre.score_columns, store.put(f"scores_{spec.name}", pre.transform(t))
        variances += [(spec.name, k + 1, v, sum(pre.explained[: k + 1])) for k, v in enumerate(pre.explained)]
        loadings += [(spec.name, *x) for x in pre.loadings()]
        hopkins += [(spec.name, float(neighbours.hopkins(scores.withColumn("_i", F.xxhash64(KEY)), "_i", columns, config.hopkins_points, 100 + s))) for s in range(config.hopkins_repeats)]
        told = predictability.city_balanced_accuracy(scores, columns, "city", KEY).first()
        cities.append((spec.name, told.balanced_accuracy_mean, told.balanced_accuracy_std, told.chance))
        found = cluster.kmeans_runs(scores, columns, config.ks, config.restarts, config.seeds)
        for k in config.ks:
            labelled = [found[k, s].predict(scores).select(F.col(KEY).alias("id"), F.lit(s).alias("run"), "label") for s in config.seeds]
            stable = partition.pairwise_stability(functools.reduce(DataFrame.unionByName, labelled)).first()
            best = min((found[k, s] for s in config.seeds), key=lambda m: m.inertia)
            q = _quality(best.predict(scores), columns, config.evaluation.silhouette_sample)
            sweep.append((spec.name, k, best.inertia, q["silhouette"], q["davies_bouldin"], q["calinski_harabasz"], q["minimum_cluster_share"], stable.mean_ari, stable.min_ari))
    table = store.put("preprocessing_sweep", _rows(store, sweep, "pipeline string, k int, inertia double, silhouette double, davies_bouldin double, calinski_harabasz double, minimum_cluster_share double, seed_stability_ari_mean double, seed_stability_ari_min double"), report=True)
    store.put("explained_variance", _rows(store, variances, "pipeline string, component int, explained double, cumulative double"), report=True)
    store.put("loadings", _rows(store, loadings, "pipeline string, component string, feature string, loading double"), report=True)
    repeats = store.put("hopkins_repeats", _rows(store, hopkins, "pipeline string, hopkins_statistic double"), report=True)
    risk = store.put("city_predictability", _rows(store, cities, "pipeline string, balanced_accuracy_mean double, balanced_accuracy_std double, chance double"), report=True)
    best = store.put("best_k", selection.best_per_pipeline(table), report=True)
    for row in best.select("pipeline", "k").collect():
        pre, scores = _scores(store, row.pipeline)
        n = scores.count()
        reference = cluster.kmeans(scores, pre.score_columns, row.k, config.restarts).predict(scores, "a")
        for s in range(config.bootstraps):
            model = cluster.kmeans(sampling.bootstrap_sample(scores, KEY, round(0.8 * n), s), pre.score_columns, row.k, 1, 100 + s)
            both = model.predict(reference, "b")
            boots.append((row.pipeline, row.k, float(partition.adjusted_rand(both, "a", "b").first()[0]), (partition.cluster_sizes(both, "b").first().min_pct or 0.0) / 100.0))
    runs = store.put("bootstrap_repeats", _rows(store, boots, "pipeline string, k int, ari double, min_cluster_share double"), report=True)
    full = best.join(selection.hopkins_summary(repeats), "pipeline", "left").join(risk, "pipeline", "left").join(selection.bootstrap_summary(runs), ["pipeline", "k"], "left")
    scored = store.put("preprocessing_choice", selection.gated_selection(selection.composite(full, selection.OVERALL, "overall_selection_score")), report=True)
    chosen = scored.orderBy(F.desc("passes_gate"), F.desc("gated_score"), F.desc("overall_selection_score"), "pipeline").first()
    store.put_json("preprocessing", json.dumps({"pipeline": chosen.pipeline, "k": chosen.k, "passes_gate": chosen.passes_gate}))


def compare_models(store: Store, config: RunConfig, source: str) -> None:
    """Model families over their grids on the chosen scores, in one table."""
    pre, scores = _scores(store, json.loads(store.json("preprocessing"))["pipeline"])
    columns, rows = pre.score_columns, []

    def add(family: str, name: str, df: DataFrame, **more) -> None:
        df = store.put("labels_now", df)
        q = _quality(df, columns, config.benchmark_silhouette)
        eta = eda.eta_squared(df.where("label >= 0").select(KEY, "label").join(store.table("features").select(KEY, *CORE_FEATURES), KEY), "label", CORE_FEATURES).agg(F.avg("eta_squared"), F.max("eta_squared"), F.count_if(F.col("eta_squared") >= 0.10)).first() if q["n_clusters"] else (None, None, 0)
        rows.append((family, name, q["n_clusters"], q["silhouette"], q["davies_bouldin"], q["calinski_harabasz"], q["entropy"], q["coverage_pct"], q["noise_pct"], q["minimum_cluster_share"], *eta, more.get("inertia"), more.get("bic"), more.get("aic"), more.get("converged")))

    for (k, _), model in cluster.kmeans_runs(scores, columns, config.ks, config.restarts, [42]).items():
        add("KMeans", f"kmeans_k{k}", model.predict(scores), inertia=model.inertia)
    for k in config.ks:
        model = cluster.minibatch_kmeans(scores, columns, k)
        add("MiniBatchKMeans", f"minibatch_k{k}", model.predict(scores), inertia=model.inertia)
    for k, model in gaussian_mixtures(scores, columns, config.mixture_ks, restarts=2).items():
        add("GaussianMixture", f"gmm_k{k}", model.predict(scores), bic=model.bic, aic=model.aic, converged=model.converged)
    numbered = scores.withColumn("_i", F.xxhash64(KEY))
    few = store.put("ward_sample", sampling.stratified_sample(numbered, "city", KEY, config.ward_sample, 42))
    for k in config.ward_ks:
        add("Ward", f"ward_k{k}", few.join(density.sampled_labels(few, "_i", columns, "ward", k=k), "_i"))
    some = store.put("density_sample", sampling.stratified_sample(numbered, "city", KEY, config.density_sample, 42))
    vectors = some.select("_i", F.array(*columns).alias("v"))
    for least in config.min_samples:
        reach = neighbours.kth_distance(vectors, vectors, "_i", "v", least)
        for q in config.eps_quantiles:
            eps = float(reach.agg(F.percentile("distance", F.lit(q))).first()[0])  # of a bounded sample
            if eps > 0:
                add("DBSCAN", f"dbscan_m{least}_q{q:.2f}", some.join(density.dbscan(some, "_i", columns, eps, least), "_i"))
    for size, least in config.hdbscan:
        add("HDBSCAN", f"hdbscan_{size}_{least}", some.join(density.sampled_labels(some, "_i", columns, "hdbscan", min_cluster_size=size, min_samples=least), "_i"))
    benchmark = store.put("model_benchmark", _rows(store, rows, "model_family string, config_name string, n_clusters long, silhouette double, davies_bouldin double, calinski_harabasz double, entropy double, coverage_pct double, noise_pct double, minimum_cluster_share double, mean_feature_eta_squared double, max_feature_eta_squared double, separated_features long, inertia double, bic double, aic double, converged boolean"), report=True)
    store.put("family_leaderboard", selection.family_leaderboard(benchmark), report=True)


def name_profiles(store: Store, config: RunConfig, source: str) -> None:
    """The final k-means, its named profiles, assignments, sizes and centres."""
    chosen = json.loads(store.json("preprocessing"))["pipeline"]
    pre, scores = _scores(store, chosen)
    model = cluster.kmeans(scores, pre.score_columns, config.validation.k, config.final_restarts)
    store.put_json("model", model.to_json())
    raw = store.put("raw_labels", model.predict(scores, "raw").select(KEY, "raw"))
    t = quality.one_to_one(store.table("features"), raw, [KEY])
    names = store.put("profile_names", interpret.name_profiles(medians(t, ["raw"], CORE_FEATURES), "raw").withColumn("slug", slug(F.col("profile_name"))), report=True)
    assigned = store.put("assignments", t.join(F.broadcast(names.drop("slug")), "raw").drop("raw"))  # a row for each cluster
    centres = _rows(store, [(k, f"PC{j + 1}", float(v)) for k, c in enumerate(model.centres) for j, v in enumerate(c)], "raw int, component string, value double")
    store.put("centres", centres.join(names, "raw").select(*PROFILE, "component", "value"), report=True)
    labelled = scores.join(raw.withColumnRenamed("raw", "label"), KEY)
    q = _quality(labelled, pre.score_columns, config.evaluation.silhouette_sample)
    store.put("partition_quality", _rows(store, [(chosen, model.inertia, q["silhouette"], q["davies_bouldin"], q["calinski_harabasz"], q["coverage_pct"])], "pipeline string, inertia double, silhouette double, davies_bouldin double, calinski_harabasz double, coverage_pct double"), report=True)
    store.put("profile_scores", partition.robust_profile_scores(assigned, list(PROFILE), CORE_FEATURES), report=True)


def validate(store: Store, config: RunConfig, source: str) -> None:
    """Leave-one-city-out and leave-one-recording-out with the outputs of each split, their summary and the verdict."""
    assigned = store.table("assignments").withColumn("recording", F.concat_ws("__", "city", "recording_id"))
    spec = next(s for s in SPECS if s.name == json.loads(store.json("preprocessing"))["pipeline"])
    all_splits = []
    for kind, group, restarts in (("city", "city", config.validation.city_restarts), ("recording", "recording", config.validation.recording_restarts)):
        metrics, rows = validation.leave_one_out_outputs(assigned, spec, "profile_id", group, config.validation, restarts)
        rows = store.put(f"{kind}_predictions", rows)
        store.put(f"{kind}_confusion", validation.confusion(rows, ["held_out"]), report=True)
        judged = rows.join(assigned.select(KEY, *CORE_FEATURES), KEY).withColumn("profile_id", F.col("predicted"))
        semantic = store.put(f"{kind}_semantics", validation.semantic_consistency(assigned, judged, "profile_id", by=["held_out"]), report=True)
        mean = semantic.groupBy("held_out").agg(F.avg("correlation").alias("correlation"))
        splits = store.put(f"{kind}_splits", metrics.join(mean, "held_out", "left"), report=True)
        all_splits.append(splits.select(F.lit(kind).alias("split_type"), "held_out", "ari", "accuracy", "correlation", F.col("all_recovered").alias("recovered")))
    summary = store.put("validation_summary", validation.summary(all_splits[0].unionByName(all_splits[1])), report=True)
    store.put("validation_decision", validation.decision(summary), report=True)
    store.put("profiles_by_city", eda.group_counts(assigned, ["city", *PROFILE], ["city"]), report=True)
    store.put("recording_coverage", interpret.recording_coverage(assigned), report=True)


def _association(store: Store, t: DataFrame, column: str, name: str) -> None:
    """Dense counts with row percentages and residuals, and the chi-square figures; nothing where fewer than two values occur."""
    kinds = [r[0] for r in t.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(1_001).collect()]
    profiles = [r[0] for r in t.select("profile_id").distinct().orderBy("profile_id").limit(1_001).collect()]
    if max(len(kinds), len(profiles)) > 1_000:
        raise ValueError(f"over 1,000 values of {column}")
    if len(kinds) < 2 or len(profiles) < 2:
        log.info("%s: fewer than two values", name)
        return
    cells = interpret.dense_counts(t.where(F.col(column).isNotNull()), "profile_id", column, profiles, kinds)
    store.put(f"{name}_cells", interpret.pearson_residuals(interpret.with_row_percentage(cells, "profile_id"), "profile_id", column), report=True)
    found = interpret.chi_square(cells, "profile_id", column)
    store.put(f"{name}_association", found.withColumn("p_value", F.lit(interpret.p_value(found))), report=True)


def interpret_profiles(store: Store, config: RunConfig, source: str) -> None:
    assigned = store.table("assignments")
    meta = _read_whole(store, "metadata")
    t = store.put("interpretation", metadata.clean_metadata(metadata.attach_metadata(assigned, meta.withColumn("_row", F.monotonically_increasing_id()), "_row")))
    store.put("metadata_availability", metadata.availability(t), report=True)
    summary = store.put("profile_summary", interpret.profile_summary(assigned, list(PROFILE)), report=True)
    _association(store, t, "city", "city")
    _association(store, t, "crossing_clean", "crossing")
    _association(store, t.where("crossing_clean <> 'Others'"), "crossing_clean", "crossing_without_others")
    _association(store, t.withColumn("violated", F.col("any_violation").cast("string")), "violated", "violation")
    rates = store.put("violations", interpret.violation_summary(t, ["profile_id"], "any_violation"), report=True)
    store.put("attention", interpret.attention_matrix(summary, rates), report=True)
    pre, scores = _scores(store, json.loads(store.json("preprocessing"))["pipeline"])
    labelled = scores.select(KEY, *pre.score_columns).join(assigned.select(KEY, "profile_id"), KEY)
    best = store.put("representatives", interpret.representatives(labelled, "profile_id", KEY, pre.score_columns, config.representatives), report=True)
    wanted = best.where("representative_rank = 1").join(assigned.select(KEY, "city", "recording_id", "track_id"), KEY)
    series = [kinematics.track_series(_read_whole(store, "frames"), r.city, r.recording_id, r.track_id).withColumn("profile_id", F.lit(r.profile_id)) for r in wanted.orderBy("profile_id").limit(1_000).collect()]  # one for each profile
    store.put("representative_series", functools.reduce(DataFrame.unionByName, series), report=True)


def gather_evidence(store: Store, config: RunConfig, source: str) -> None:
    """The evidence table, computed from the tables of the run."""
    rows: list[tuple[str, str, float]] = []
    quality_ = store.table("partition_quality").first()
    rows += [("Coverage", "Trajectory coverage %", quality_.coverage_pct), ("Internal structure", "Silhouette", quality_.silhouette), ("Internal structure", "Davies-Bouldin", quality_.davies_bouldin), ("Internal structure", "Calinski-Harabasz", quality_.calinski_harabasz)]
    chosen = store.table("preprocessing_choice").where(F.col("pipeline") == quality_.pipeline).first()
    rows += [("Seed stability", "Mean pairwise ARI", chosen.seed_stability_ari_mean), ("Bootstrap stability", "Mean ARI", chosen.bootstrap_ari_mean), ("Bootstrap stability", "Minimum ARI", chosen.bootstrap_ari_min)]
    for r in store.table("validation_summary").orderBy("split_type").collect():
        rows += [(f"Leave-one-{r.split_type}-out", name, value) for name, value in (("Mean ARI", r.mean_ari), ("Minimum ARI", r.min_ari), ("Mean accuracy", r.mean_accuracy), ("Mean correlation", r.mean_correlation))]
    for name in ("city", "crossing", "crossing_without_others", "violation"):
        if store.has(f"{name}_association"):
            r = store.table(f"{name}_association").first()
            rows += [(f"Association with {name}", "Chi-square", r.chi_square), (f"Association with {name}", "Cramer's V", r.cramers_v), (f"Association with {name}", "p", r.p_value)]
    store.put("evidence", _rows(store, [(a, b, None if v is None else float(v)) for a, b, v in rows], "evidence_category string, metric string, value double"), report=True)


STAGES: tuple[tuple[str, Callable[[Store, RunConfig, str], None]], ...] = (
    ("recordings", read_recordings),
    ("features", build_features),
    ("exploration", explore),
    ("preprocessing", choose_preprocessing),
    ("models", compare_models),
    ("profiles", name_profiles),
    ("validation", validate),
    ("interpretation", interpret_profiles),
    ("evidence", gather_evidence),
)


def run(spark: SparkSession, source: str, root: str, config: RunConfig = RunConfig(), only: Sequence[str] | None = None, again: bool = False) -> Store:
    """Runs the stages in order (or those named), skipping the ones that are done unless `again`; a stage that fails leaves the tables before it."""
    store = Store(spark, root)
    store.put_json("run", json.dumps(asdict(config)))
    for name, stage in STAGES:
        if only is not None and name not in only:
            continue
        if store.has_json(f"done-{name}") and not again:
            log.info("%s: done before", name)
            continue
        began = time.monotonic()
        log.info("%s: begins", name)
        stage(store, config, source)
        store.put_json(f"done-{name}", json.dumps({"seconds": round(time.monotonic() - began, 1)}))
        log.info("%s: %.1f s", name, time.monotonic() - began)
    return store
