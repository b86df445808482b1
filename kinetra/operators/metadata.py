"""Optional trajectory metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetra.functions.text import strip

COLUMNS = ("class", "CrossType", "Signal_Violation_Behavior")
#: Raw violation labels and their canonical names.
VIOLATIONS = {
    "No violation of traffic lights": "No violation",
    "yellow-light running": "Yellow-light running",
    "red-light running": "Red-light running",
}


def deduplicated(metadata: DataFrame, order: str) -> DataFrame:
    """The first row of each (city, recording_id, trackId) by `order`; absent optional columns become null."""
    for c in COLUMNS:
        if c not in metadata.columns:
            metadata = metadata.withColumn(c, F.lit(None).cast("string"))
    w = W.partitionBy("city", "recording_id", "trackId").orderBy(order)
    return metadata.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("city", "recording_id", F.col("trackId").alias("track_id"), *COLUMNS)


def attach_metadata(tracks: DataFrame, metadata: DataFrame, order: str) -> DataFrame:
    return tracks.join(deduplicated(metadata, order), ["city", "recording_id", "track_id"], "left")


def clean_violation(c: Column) -> Column:
    s = strip(c)
    out = s
    for raw, name in VIOLATIONS.items():
        out = F.when(s == raw, name).otherwise(out)
    return out


def clean_metadata(table: DataFrame) -> DataFrame:
    """Stripped crossing type, canonical violation and any_violation (null stays null)."""
    return table.withColumn("crossing_clean", strip(F.col("CrossType"))).withColumn("violation_clean", clean_violation(F.col("Signal_Violation_Behavior"))).withColumn("any_violation", F.col("violation_clean") != "No violation")


def availability(table: DataFrame) -> DataFrame:
    return table.groupBy("city").agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"with_{c.lower()}") for c in COLUMNS])
