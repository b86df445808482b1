"""Contingency statistics, profile tables, attention tiers and representatives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetra.config import CORE_FEATURES
from kinetra.functions.quantiles import medians as exact_medians
from kinetra.functions.stats import chi_square_tail, wilson_interval
from kinetra.operators.selection import percentile_score

#: Profile names, tiers and report texts.
PROFILES = {1: "Smooth and Steady", 2: "Stop-and-Go", 3: "Dynamic Speed Adjustment", 4: "Acceleration-Intensive"}
TIERS = ("High review priority", "Operational priority", "Baseline reference")
FOCUS = {
    1: "Use as the baseline flow profile; monitor prevalence and large context shifts rather than intervene by default.",
    2: "Review signal timing, queue formation, stop frequency, and possible spillback conditions.",
    3: "Review approach-speed consistency, braking zones, and locations where repeated speed adjustment occurs.",
    4: "Prioritize trajectory-quality verification and review high-acceleration/high-jerk maneuvers.",
}
WARNING = "Descriptive attention priority only; not a crash probability or causal safety-risk estimate."
DIMENSIONS = {
    "dynamic_maneuver_priority": ("max_acceleration_mps2", "max_deceleration_mps2", "acceleration_std_mps2", "mean_abs_jerk_mps3"),
    "signal_queue_priority": ("observed_stop_transition_count", "stopped_time_ratio"),
    "speed_adjustment_priority": ("speed_std_mps", "max_speed_mps", "max_deceleration_mps2"),
}


def lookup(column: str, table: dict):
    """A small mapping as an expression."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col(column)]


def dense_counts(df: DataFrame, row: str, col: str, rows: Sequence, cols: Sequence) -> DataFrame:
    """(row, col, count) for every cell of the given values, zero where none occurs."""
    spark = df.sparkSession
    kinds = dict(df.dtypes)
    grid = spark.createDataFrame([(r, c) for r in rows for c in cols], f"{row} {kinds[row]}, {col} {kinds[col]}")
    found = df.groupBy(row, col).agg(F.count(F.lit(1)).alias("count"))
    return F.broadcast(grid).join(found, [row, col], "left").na.fill(0, ["count"])


def with_row_percentage(cells: DataFrame, row: str) -> DataFrame:
    total = F.sum("count").over(W.partitionBy(row))
    return cells.withColumn("percentage", F.when(total > 0, 100.0 * F.col("count") / total))


def expected_cells(cells: DataFrame, row: str, col: str) -> DataFrame:
    n = F.sum("count").over(W.partitionBy(F.lit(0)))
    r, c = F.sum("count").over(W.partitionBy(row)), F.sum("count").over(W.partitionBy(col))
    return cells.withColumn("expected", F.try_divide(r * c, n.cast("double")))


def pearson_residuals(cells: DataFrame, row: str, col: str) -> DataFrame:
    e = expected_cells(cells, row, col)
    return e.withColumn("residual", F.try_divide(F.col("count") - F.col("expected"), F.sqrt("expected")))


def chi_square(cells: DataFrame, row: str, col: str) -> DataFrame:
    """One row: chi_square, dof, cramers_v (bias-corrected), n, rows, columns of a table of counts."""
    e = expected_cells(cells.where("count IS NOT NULL"), row, col)
    gap = F.col("count") - F.col("expected")
    s = e.agg(F.sum(F.try_divide(gap * gap, F.col("expected"))).alias("x"), F.sum("count").alias("n"), F.countDistinct(row).alias("r"), F.countDistinct(col).alias("c"))
    less = F.greatest(F.col("n") - 1, F.lit(1))
    phi = F.greatest(F.lit(0.0), F.col("x") / F.col("n") - (F.col("c") - 1) * (F.col("r") - 1) / less)
    rc, cc = F.col("r") - (F.col("r") - 1) * (F.col("r") - 1) / less, F.col("c") - (F.col("c") - 1) * (F.col("c") - 1) / less
    den = F.least(rc, cc) - 1
    return s.select(F.col("x").alias("chi_square"), ((F.col("r") - 1) * (F.col("c") - 1)).alias("dof"), F.when(den > 0, F.sqrt(F.try_divide(phi, den))).otherwise(0.0).alias("cramers_v"), F.col("n").alias("n"), F.col("r").alias("rows"), F.col("c").alias("columns"))


def p_value(association: DataFrame) -> float:
    row = association.first()
    return chi_square_tail(float(row.chi_square), int(row.dof))


def violation_summary(table: DataFrame, profile: Sequence[str], violated: str) -> DataFrame:
    """Totals, violations, rate, Wilson bounds and rate relative to all rows, for each profile; unknown rows are left out."""
    known = table.where(F.col(violated).isNotNull())
    t = known.groupBy(*profile).agg(F.count(F.lit(1)).alias("trajectories"), F.count_if(violated).alias("violations"))
    return rates(t, profile)


def rates(counts: DataFrame, profile: Sequence[str]) -> DataFrame:
    all_of = W.partitionBy(F.lit(0))
    overall = F.try_divide(F.sum("violations").over(all_of), F.sum("trajectories").over(all_of))
    rate = F.try_divide(F.col("violations"), F.col("trajectories"))
    lo, hi = wilson_interval(F.col("violations"), F.col("trajectories"))
    return counts.select(*profile, "trajectories", "violations", rate.alias("violation_rate"), (100.0 * rate).alias("violation_rate_pct"), lo.alias("wilson_lower"), hi.alias("wilson_upper"), F.try_divide(rate, overall).alias("relative_to_overall"))


def profile_summary(table: DataFrame, profile: Sequence[str], features: Sequence[str] = CORE_FEATURES) -> DataFrame:
    """Count, percentage and exact medians of each profile."""
    total = F.sum("trajectory_count").over(W.partitionBy(F.lit(0)))
    t = table.groupBy(*profile).agg(F.count(F.lit(1)).alias("trajectory_count")).join(exact_medians(table, profile, features), list(profile), "left")
    return t.select(*profile, "trajectory_count", (100.0 * F.col("trajectory_count") / total).alias("percentage"), *features)


def attention_matrix(medians: DataFrame, violations: DataFrame) -> DataFrame:
    """Mean percentile ranks of three groups of features, violation rate and enrichment, tier, focus and warning."""
    used = sorted({f for fs in DIMENSIONS.values() for f in fs})
    ranks = medians.withColumns({f"{f}__r": 100.0 * percentile_score(f, False) for f in used})
    for name, fs in DIMENSIONS.items():
        ranks = ranks.withColumn(name, sum((F.col(f"{f}__r") for f in fs), F.lit(0.0)) / len(fs))
    v = violations.select("profile_id", "violation_rate_pct", F.col("relative_to_overall").alias("violation_enrichment"))
    joined = ranks.join(F.broadcast(v), "profile_id", "left")
    high = (F.col("dynamic_maneuver_priority") >= 75) | F.coalesce(F.col("violation_enrichment") >= 1.25, F.lit(False))
    operational = (F.col("signal_queue_priority") >= 75) | (F.col("speed_adjustment_priority") >= 70)
    return joined.select("profile_id", "profile_name", *DIMENSIONS, "violation_rate_pct", "violation_enrichment", F.when(high, TIERS[0]).when(operational, TIERS[1]).otherwise(TIERS[2]).alias("attention_tier"), lookup("profile_id", FOCUS).alias("focus"), F.lit(WARNING).alias("warning"))


def name_profiles(medians: DataFrame, label: str) -> DataFrame:
    """(label, profile_id, profile_name) by rule on the medians: highest stopped ratio, then highest top acceleration, then higher acceleration spread; the rest is the smooth profile. Small table."""
    left = [r.asDict() for r in medians.orderBy(label).collect()]
    out = []
    for profile, feature in ((2, "stopped_time_ratio"), (4, "max_acceleration_mps2"), (3, "acceleration_std_mps2")):
        if len(left) > 1:
            pick = max(left, key=lambda r: (r[feature], -r[label]))
            left.remove(pick)
            out.append((pick[label], profile, PROFILES[profile]))
    out += [(r[label], 1, PROFILES[1]) for r in left]
    return medians.sparkSession.createDataFrame(out, f"{label} int, profile_id int, profile_name string")


def representatives(df: DataFrame, profile: str, key: str, columns: Sequence[str], n: int) -> DataFrame:
    """The n rows nearest to their profile's centroid, ties by key. Ranks run over one profile's rows, pre-cut by partition."""
    cent = df.groupBy(profile).agg(*[F.avg(F.col(c).cast("double")).alias(f"{c}__c") for c in columns])
    d = F.sqrt(sum(((F.col(c) - F.col(f"{c}__c")) * (F.col(c) - F.col(f"{c}__c")) for c in columns), F.lit(0.0)))
    dist = df.join(F.broadcast(cent), profile).select(profile, key, d.alias("distance"))
    w = W.partitionBy(profile).orderBy("distance", key)
    return dist.withColumn("representative_rank", F.row_number().over(w)).where(F.col("representative_rank") <= n)


def recording_coverage(table: DataFrame, profile: str = "profile_id", expected: int = 4) -> DataFrame:
    sizes = table.groupBy("city", "recording_id", profile).agg(F.count(F.lit(1)).alias("c"))
    return sizes.groupBy("city", "recording_id").agg(F.sum("c").alias("trajectory_count"), F.count(F.lit(1)).alias("profiles_present"), F.min("c").alias("smallest_profile_count"), (100.0 * F.max("c") / F.sum("c")).alias("largest_profile_percentage")).withColumn("all_profiles_present", F.col("profiles_present") == expected)
