"""Queries of preprocessing, PCA, neighbours, partition quality, clustering and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.config import CONTINUOUS_FEATURES, CORE_FEATURES, SPECS
from kinetra.functions.quantiles import checkpointed, quantiles
from kinetra.operators import cluster, density, eda, neighbours, partition, preprocess, sampling
from kinetra.operators.hdbscan import hdbscan
from kinetra.operators.mixture import gaussian_mixtures
from kinetra.plans.registry import query, r, rounded
from kinetra.plans.trajectory import FEAT_SQL, eta_sql, features
from kinetra.sources.adapters import table, vectors, vectors_sql

D10 = tuple(f"d{k}" for k in range(10))
D4 = D10[:4]


def _bounds_sql(tail: str) -> str:
    lo = ", ".join(f"quantile_cont({f}, 0.01) AS {f}_lo, quantile_cont({f}, 0.99) AS {f}_hi" for f in CONTINUOUS_FEATURES)
    return f"WITH {FEAT_SQL}, b AS (SELECT {lo} FROM feats) {tail}"


@query(_bounds_sql(" UNION ALL ".join(f"SELECT '{f}' AS feature, {r(f'lower=any_value({f}_lo)', f'upper=any_value({f}_hi)')}, count(CASE WHEN {f} < {f}_lo THEN 1 END) AS n_below, count(CASE WHEN {f} > {f}_hi THEN 1 END) AS n_above FROM feats, b" for f in CONTINUOUS_FEATURES)))
def winsor_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(preprocess.winsor_bounds(features(spark, sf_dir), CONTINUOUS_FEATURES))


@query(_bounds_sql("SELECT trajectory_uid, " + r(*[f"{f}=least(greatest({f}, {f}_lo), {f}_hi)" for f in CONTINUOUS_FEATURES]) + " FROM feats, b"))
def winsorized_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = checkpointed(features(spark, sf_dir))
    p = preprocess.Preprocessor(SPECS[0]).fit(t)
    return rounded(t.select("trajectory_uid", *[p._clipped(f).alias(f) for f in CONTINUOUS_FEATURES]))


@query(f"WITH {FEAT_SQL} SELECT trajectory_uid, " + r(*[f"{f}=({f} - (SELECT median({f}) FROM feats)) / (SELECT CASE WHEN quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25) = 0 THEN 1.0 ELSE quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25) END FROM feats)" for f in CORE_FEATURES]) + " FROM feats")
def robust_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = checkpointed(features(spark, sf_dir))
    return rounded(preprocess.Preprocessor(SPECS[1]).fit(t).scaled(t).select("trajectory_uid", *CORE_FEATURES))


STANDARD_SQL = f"WITH {FEAT_SQL}, b AS (SELECT " + ", ".join(f"quantile_cont({f}, 0.01) AS {f}_lo, quantile_cont({f}, 0.99) AS {f}_hi" for f in CONTINUOUS_FEATURES) + " FROM feats), w AS (SELECT trajectory_uid, " + ", ".join(f"least(greatest({f}, {f}_lo), {f}_hi) AS {f}" for f in CONTINUOUS_FEATURES) + ", CAST(observed_stop_transition_count AS DOUBLE) AS observed_stop_transition_count, stopped_time_ratio FROM feats, b)"


@query(STANDARD_SQL + " SELECT trajectory_uid, " + r(*[f"{f}=({f} - (SELECT avg({f}) FROM w)) / (SELECT CASE WHEN stddev_pop({f}) = 0 THEN 1.0 ELSE stddev_pop({f}) END FROM w)" for f in CORE_FEATURES]) + " FROM w")
def standard_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = checkpointed(features(spark, sf_dir))
    return rounded(preprocess.Preprocessor(SPECS[0]).fit(t).scaled(t).select("trajectory_uid", *CORE_FEATURES))


@query(f"WITH {vectors_sql()} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_pop({a}, {b}), 6) + 0.0 AS covariance FROM vectors" for i, a in enumerate(D10) for b in D10[i:]))
def pca_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    cov, _, _ = preprocess.covariance(vectors(spark, sf_dir), D10)
    return rounded(spark.createDataFrame([(D10[i], D10[j], float(cov[i, j])) for i in range(10) for j in range(i, 10)], "a string, b string, covariance double"))


def _fitted(spark: SparkSession, sf_dir: str) -> tuple[preprocess.Preprocessor, DataFrame]:
    t = checkpointed(features(spark, sf_dir))  # one row for each trajectory, read by every pass of the fit
    return preprocess.Preprocessor(SPECS[2]).fit(t), t


@query()
def pca_explained_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    p, _ = _fitted(spark, sf_dir)
    rows = spark.createDataFrame([(k + 1, f"PC{k + 1}", float(v)) for k, v in enumerate(p.explained)], "k int, component string, explained double")
    w = W.partitionBy(F.lit(0)).orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rounded(rows.withColumn("cumulative", F.sum("explained").over(w)).drop("k"))


@query()
def pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, t = _fitted(spark, sf_dir)
    return rounded(p.transform(t).select("trajectory_uid", *p.score_columns))


@query()
def pca_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _ = _fitted(spark, sf_dir)
    return rounded(spark.createDataFrame(p.loadings(), "component string, feature string, loading double"))


V64 = "SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings"


@query(f"WITH e AS ({V64}) SELECT query, round(distance, 6) AS distance FROM (SELECT a.vec_id AS query, list_distance(a.v, b.v) AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS n FROM e a, e b WHERE a.vec_id % 100 = 0) WHERE n = 5")
def knn_kth_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 100, against all rows."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return rounded(neighbours.kth_distance(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 5))


@query(
    f"WITH e AS ({V64}), k AS (SELECT distance FROM (SELECT list_distance(a.v, b.v) AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS n FROM e a, e b WHERE a.vec_id % 100 = 0) WHERE n = 5) "
    + " UNION ALL ".join(f"SELECT {q}::DOUBLE AS quantile, round(quantile_cont(distance, {q}), 6) AS eps FROM k" for q in (0.8, 0.9, 0.95))
)
def eps_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radii for DBSCAN: quantiles of the distances to the fifth neighbour, from the rows whose id is divisible by 100 to all rows."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = quantiles(neighbours.kth_distance(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 5), ["distance"], (0.8, 0.9, 0.95))
    return rounded(found.select(F.explode(F.arrays_zip(F.array(F.lit(0.8), F.lit(0.9), F.lit(0.95)).alias("quantile"), F.col("q").alias("eps"))).alias("x")).select("x.*"))


@query()
def hopkins_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).persist()
    rows = [(seed, float(neighbours.hopkins(v, "vec_id", D10, 1_000, seed))) for seed in range(100, 110)]
    v.unpersist()
    return rounded(spark.createDataFrame(rows, "seed int, hopkins_statistic double"))


@query()
def city_predictability(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinetra.operators.predictability import city_balanced_accuracy

    p, t = _fitted(spark, sf_dir)
    return rounded(city_balanced_accuracy(p.transform(t), p.score_columns, "city", "trajectory_uid"))


CENT = "c AS (SELECT label, count(*) AS n, " + ", ".join(f"avg({d}) AS {d}" for d in D4) + " FROM vectors GROUP BY label)"


def _sq(a: str, b: str, cols=D4) -> str:
    return " + ".join(f"({a}.{d} - {b}.{d}) * ({a}.{d} - {b}.{d})" for d in cols)


@query(
    f"""WITH {vectors_sql(4)}, {CENT}, s AS (SELECT c.label, any_value(c.n) AS n, avg(sqrt({_sq('v', 'c')})) AS s, sum({_sq('v', 'c')}) AS w FROM vectors v JOIN c USING (label) GROUP BY c.label),
    db AS (SELECT avg(m) AS v FROM (SELECT a.label, max((sa.s + sb.s) / sqrt({_sq('a', 'b')})) AS m FROM c a, c b, s sa, s sb WHERE a.label <> b.label AND sa.label = a.label AND sb.label = b.label GROUP BY a.label)),
    g AS (SELECT {', '.join(f'avg({d}) AS {d}' for d in D4)} FROM vectors),
    ch AS (SELECT (sum(c.n * ({_sq('c', 'g')})) / (count(*) - 1)) / ((SELECT sum(w) FROM s) / (sum(c.n) - count(*))) AS v FROM c, g)
    SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(CASE WHEN label >= 0 THEN n ELSE 0 END) AS BIGINT) AS n_clustered, round(100.0 * sum(CASE WHEN label >= 0 THEN n ELSE 0 END) / sum(n), 6) AS coverage_pct, round(100.0 * sum(CASE WHEN label < 0 THEN n ELSE 0 END) / sum(n), 6) + 0.0 AS noise_pct, count(CASE WHEN label >= 0 THEN 1 END) AS n_clusters, min(n) AS min_size, max(n) AS max_size, round(100.0 * min(n) / sum(n), 6) AS min_pct, round(100.0 * max(n) / sum(n), 6) AS max_pct,
      (SELECT round(v, 6) FROM db) AS davies_bouldin, (SELECT round(v, 6) FROM ch) AS calinski_harabasz FROM c"""
)
def partition_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir, 4)
    return rounded(partition.cluster_sizes(v).join(F.broadcast(partition.davies_bouldin_calinski(v, D4))))


@query(
    f"""WITH {vectors_sql(4)}, d AS (SELECT a.vec_id, a.label AS la, b.label AS lb, sum(sqrt({_sq('a', 'b')})) AS s, count(*) AS n FROM vectors a, vectors b GROUP BY ALL),
    p AS (SELECT vec_id, max(CASE WHEN la = lb THEN n END) AS own, max(CASE WHEN la = lb AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN la <> lb THEN s / n END) AS b FROM d GROUP BY vec_id)
    SELECT round(avg(CASE WHEN own = 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) + 0.0 AS silhouette FROM p"""
)
def silhouette_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(partition.silhouette_all(vectors(spark, sf_dir, 4), "vec_id", D4))


@query("SELECT round(-sum(p * ln(p)) / ln(count(*)), 6) + 0.0 AS entropy FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM embeddings GROUP BY label)")
def cluster_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(partition.normalized_entropy(vectors(spark, sf_dir, 1)))


@query(f"WITH {vectors_sql()} " + eta_sql("vectors", "label", [(d, d) for d in D10]))
def eta_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(eda.eta_squared(vectors(spark, sf_dir), "label", D10))


def _ari_sql(src: str, a: str, b: str) -> str:
    return f"""(SELECT s, sa, sb, t FROM (SELECT sum(n * (n - 1) / 2.0) AS s, sum(n) * (sum(n) - 1) / 2.0 AS t FROM (SELECT count(*) AS n FROM {src} GROUP BY {a}, {b})),
      (SELECT sum(n * (n - 1) / 2.0) AS sa FROM (SELECT count(*) AS n FROM {src} GROUP BY {a})), (SELECT sum(n * (n - 1) / 2.0) AS sb FROM (SELECT count(*) AS n FROM {src} GROUP BY {b})))"""


@query("SELECT round((s - sa * sb / t) / ((sa + sb) / 2.0 - sa * sb / t), 6) + 0.0 AS ari FROM " + _ari_sql("(SELECT c_nationkey % 5 AS a, c_mktsegment AS b FROM customer)", "a", "b"))
def adjusted_rand_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 5).alias("a"), F.col("c_mktsegment").alias("b"))
    return rounded(partition.adjusted_rand(t, "a", "b"))


_RUNS = "(SELECT label AS l0, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l1, CASE WHEN vec_id % 3 = 0 THEN label % 5 ELSE label END AS l2 FROM embeddings)"


@query("SELECT round(avg(a), 6) + 0.0 AS mean_ari, round(min(a), 6) + 0.0 AS min_ari, round(stddev_pop(a), 6) + 0.0 AS std_ari FROM (" + " UNION ALL ".join(f"SELECT (s - sa * sb / t) / ((sa + sb) / 2.0 - sa * sb / t) AS a FROM {_ari_sql(_RUNS, x, y)}" for x, y in (("l0", "l1"), ("l0", "l2"), ("l1", "l2"))) + ")")
def pairwise_label_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    l1 = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    l2 = F.when(F.col("id") % 3 == 0, F.col("label") % 5).otherwise(F.col("label"))
    runs = [e.select("id", F.lit(k).alias("run"), x.cast("int").alias("label")) for k, x in enumerate((F.col("label"), l1, l2))]
    return rounded(partition.pairwise_stability(runs[0].unionByName(runs[1]).unionByName(runs[2])))


def _first_centres(spark: SparkSession, sf_dir: str, k: int) -> list[list[float]]:
    return [[float(x) for x in row[1:]] for row in vectors(spark, sf_dir, 4).orderBy("vec_id").limit(k).select("vec_id", *D4).collect()]


_C0 = f"c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, {', '.join(D4)} FROM vectors ORDER BY vec_id LIMIT 4)"


def _lloyd_sql(steps: int) -> str:
    out = [f"WITH {vectors_sql(4)}", _C0]
    for t in range(steps + 1):
        out.append(f"q{t} AS (SELECT v.vec_id, {', '.join(f'v.{d}' for d in D4)}, c.k, {_sq('v', 'c')} AS q, row_number() OVER (PARTITION BY v.vec_id ORDER BY {_sq('v', 'c')}, c.k) AS n FROM vectors v, c{t} c)")
        if t < steps:
            out.append(f"c{t + 1} AS (SELECT c{t}.k, {', '.join(f'coalesce(m.{d}, c{t}.{d}) AS {d}' for d in D4)} FROM c{t} LEFT JOIN (SELECT k, {', '.join(f'avg({d}) AS {d}' for d in D4)} FROM q{t} WHERE n = 1 GROUP BY k) m ON m.k = c{t}.k)")
    return ", ".join(out)


@query(_lloyd_sql(0) + " SELECT vec_id, CAST(k AS INTEGER) AS label, round(sqrt(q), 6) AS distance FROM q0 WHERE n = 1")
def nearest_centroid_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, sq = cluster.nearest_centre(D4, _first_centres(spark, sf_dir, 4))
    return rounded(vectors(spark, sf_dir, 4).select("vec_id", label.alias("label"), F.sqrt(sq).alias("distance")))


@query(_lloyd_sql(3) + " SELECT CAST(k AS INTEGER) AS label, count(*) AS size, round(sum(q), 6) AS inertia FROM q3 WHERE n = 1 GROUP BY k")
def lloyd_fixed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir, 4)
    model = cluster.lloyd(v, D4, _first_centres(spark, sf_dir, 4), 3)
    label, sq = cluster.nearest_centre(D4, model.centres)
    return rounded(v.select(label.alias("label"), sq.alias("q")).groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.sum("q").alias("inertia")))


def _model_row(spark: SparkSession, df: DataFrame, columns, family: str, name: str, **extra) -> DataFrame:
    """A benchmark row: sizes, silhouette, Davies-Bouldin, Calinski-Harabasz, entropy and feature separation of a labelled table."""
    df = df.persist()
    one = partition.cluster_sizes(df).join(F.broadcast(partition.davies_bouldin_calinski(df, columns))).join(F.broadcast(partition.silhouette(df, "vec_id", columns, sample=1_500))).join(F.broadcast(partition.normalized_entropy(df)))
    eta = eda.eta_squared(df.where("label >= 0"), "label", columns).agg(F.avg("eta_squared").alias("mean_eta_squared"), F.max("eta_squared").alias("max_eta_squared"), F.count_if(F.col("eta_squared") >= 0.10).alias("separated_features"))
    full = one.join(F.broadcast(eta)).select(F.lit(family).alias("model_family"), F.lit(name).alias("config_name"), "*", *[F.lit(v).alias(k) for k, v in extra.items()])
    out = spark.createDataFrame(full.collect(), full.schema)  # one row
    df.unpersist()
    return out


@query()
def kmeans_multistart(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir, 4)
    model = cluster.kmeans(v, D4, 4, restarts=50)
    return rounded(_model_row(spark, model.predict(v.drop("label")), D4, "KMeans", "kmeans_k4", inertia=model.inertia))


@query()
def kmeans_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir, 4).persist()
    out = []
    found = cluster.kmeans_runs(v, D4, range(2, 9), 8, (42, 43, 44))
    for k in range(2, 9):
        runs = [found[k, s] for s in (42, 43, 44)]
        labelled = [m.predict(v.drop("label")).select(F.col("vec_id").alias("id"), F.lit(s).alias("run"), "label") for s, m in enumerate(runs)]
        stab = partition.pairwise_stability(labelled[0].unionByName(labelled[1]).unionByName(labelled[2])).first()
        best = min(runs, key=lambda m: m.inertia)
        out.append((k, best.inertia, stab.mean_ari, stab.min_ari))
    v.unpersist()
    return rounded(spark.createDataFrame(out, "k int, inertia double, seed_stability_ari_mean double, seed_stability_ari_min double"))


@query()
def minibatch_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir, 4)
    model = cluster.minibatch_kmeans(v, D4, 4)
    return rounded(_model_row(spark, model.predict(v.drop("label")), D4, "MiniBatchKMeans", "minibatch_k4", inertia=model.inertia))


@query()
def gaussian_mixture_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir, 4)
    rows = [(k, m.log_likelihood, m.aic, m.bic, m.converged) for k, m in gaussian_mixtures(v, D4, range(2, 7), restarts=2).items()]
    return spark.createDataFrame(rows, "k int, log_likelihood double, aic double, bic double, converged boolean").select("k", *[F.round(x, 2).alias(x) for x in ("log_likelihood", "aic", "bic")], "converged")


EPS, MIN_SAMPLES = 0.12, 5


@query(
    f"""WITH RECURSIVE {vectors_sql(4)}, n AS (SELECT a.vec_id AS i, b.vec_id AS j FROM vectors a, vectors b WHERE sqrt({_sq('a', 'b')}) <= {EPS}),
    core AS (SELECT i FROM n GROUP BY i HAVING count(*) >= {MIN_SAMPLES}),
    l AS (SELECT n.i, n.j FROM n JOIN core ON n.i = core.i JOIN core c2 ON n.j = c2.i),
    reach AS (SELECT i AS a, i AS b FROM core UNION SELECT r.a, l.j FROM reach r JOIN l ON r.b = l.i),
    roots AS (SELECT a AS i, min(b) AS root FROM reach GROUP BY a),
    names AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS label FROM (SELECT DISTINCT root FROM roots)),
    border AS (SELECT n.i, min(r.root) AS root FROM n JOIN roots r ON n.j = r.i GROUP BY n.i)
    SELECT v.vec_id, CAST(coalesce(nr.label, nb.label, -1) AS INTEGER) AS label FROM vectors v LEFT JOIN roots r ON v.vec_id = r.i LEFT JOIN names nr ON nr.root = r.root LEFT JOIN border b ON b.i = v.vec_id LEFT JOIN names nb ON nb.root = b.root"""
)
def dbscan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.dbscan(vectors(spark, sf_dir, 4), "vec_id", D4, EPS, MIN_SAMPLES)


@query()
def ward_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows, whatever their number."""
    return density.ward(vectors(spark, sf_dir, 4), "vec_id", D4, 4)


@query()
def hdbscan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows, whatever their number; up to density.MAX_SAMPLE of them in one task."""
    v = vectors(spark, sf_dir, 4)
    if v.limit(density.MAX_SAMPLE + 1).count() > density.MAX_SAMPLE:
        return hdbscan(v, "vec_id", D4, min_cluster_size=15, min_samples=5)
    return density.sampled_labels(v, "vec_id", D4, "hdbscan", min_cluster_size=15, min_samples=5)


@query(
    f"""WITH {FEAT_SQL}, g AS (SELECT city, count(*) AS s FROM feats GROUP BY city), e AS (SELECT city, least(60, sum(s) OVER ()) AS n, least(60, sum(s) OVER ()) * s / sum(s) OVER () AS x FROM g),
    p AS (SELECT city, CAST(floor(x) AS BIGINT) AS base, n - sum(floor(x)) OVER () AS spare, row_number() OVER (ORDER BY floor(x) - x, city) AS turn FROM e)
    SELECT city, base + CASE WHEN turn <= spare THEN 1 ELSE 0 END AS sampled FROM p WHERE base + CASE WHEN turn <= spare THEN 1 ELSE 0 END > 0"""
)
def stratified_sample_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: exactly 60 rows, each city in proportion."""
    return sampling.stratified_sample(features(spark, sf_dir), "city", "trajectory_uid", 60, 42).groupBy("city").agg(F.count(F.lit(1)).alias("sampled"))


def _stability(spark: SparkSession, sf_dir: str, train_of, repeats: int, restarts: int) -> DataFrame:
    """Fits on train_of(scores, repeat), predicts all rows, ARI against the reference partition."""
    p, t = _fitted(spark, sf_dir)
    scores = p.transform(t).persist()
    reference = cluster.kmeans(scores, p.score_columns, 4, restarts=50)
    rows = []
    for k, train in train_of(scores, repeats):
        model = cluster.kmeans(train, p.score_columns, 4, restarts=restarts, seed=100)
        both = model.predict(reference.predict(scores, "a"), "b").select("a", "b")
        shares = both.groupBy("b").count().agg(F.min("count")).first()[0]
        rows.append((str(k), float(partition.adjusted_rand(both, "a", "b").first()[0]), int(shares)))
    scores.unpersist()
    return rounded(spark.createDataFrame(rows, "repeat string, ari double, smallest_cluster int"))


@query()
def bootstrap_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stability(spark, sf_dir, lambda df, n: ((s, sampling.bootstrap_sample(df, "trajectory_uid", round(0.8 * df.count()), s)) for s in range(n)), 3, 1)


@query()
def leave_city_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stability(spark, sf_dir, lambda df, n: ((r_[0], sampling.hold_out(df, "city", r_[0])[0]) for r_ in df.select("city").distinct().orderBy("city").collect()), 4, 3)


@query()
def recording_subsample_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stability(spark, sf_dir, lambda df, n: ((s, sampling.group_subsample(df, ["city", "recording_id"], 0.8, s)) for s in range(n)), 3, 3)


@query()
def density_subsample_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DBSCAN on 80 % subsamples against the full labels, on the common rows."""
    v = vectors(spark, sf_dir, 4).persist()
    full = density.dbscan(v, "vec_id", D4, EPS, MIN_SAMPLES).persist()
    n = v.count()
    rows = []
    for s in range(2):
        part = density.dbscan(sampling.uniform_sample(v, "vec_id", round(0.8 * n), s), "vec_id", D4, EPS, MIN_SAMPLES)
        both = full.select("vec_id", F.col("label").alias("a")).join(part.select("vec_id", F.col("label").alias("b")), "vec_id").persist()
        sizes = partition.cluster_sizes(both, "b").first()
        rows.append((s, float(partition.adjusted_rand(both, "a", "b").first()[0]), float(sizes.coverage_pct), int(sizes.n_clusters)))
    return rounded(spark.createDataFrame(rows, "repeat int, ari double, coverage_pct double, n_clusters int"))
