"""Recording archives: name rules, CSV members of ZIP files, header checks and the archive audit.

`read_rows` and `audit_members` go through the data sources of `zip_source`. The functions over `discover_archives` are for stores that only
Spark reaches: there a whole archive, of 2 GB at most, comes as one row.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.functions.quantiles import checkpointed
from kinetra.sources.zip_source import HEAD, NAME_RULES, check_columns, decode_csv, is_reachable, member_of, register

#: Names of archive members.
VEHICLE_MEMBER, METADATA_MEMBER, PEDESTRIAN_MEMBER = "Veh_smoothed_tracks.csv", "Veh_tracks_meta.csv", "Ped_smoothed_tracks.csv"
#: The required columns of vehicle frames and their types.
FRAME_SCHEMA = "track_id long, frame_id long, timestamp_ms double, agent_type string, x double, y double, vx double, vy double, yaw_rad double, heading_rad double, length double, width double, ax double, ay double, v_lon double, v_lat double, a_lon double, a_lat double"
METADATA_SCHEMA = "trackId long, class string, CrossType string, Signal_Violation_Behavior string"


def archive_name_rules(df: DataFrame, name_col: str) -> DataFrame:
    """df with city and recording_id from file names; both null where no rule fits. The rules are tried in order."""
    stem = F.replace(F.regexp_replace(F.col(name_col), r"\.[^.]*$", ""), F.lit("(1)"), F.lit(""))
    city = F.coalesce(*[F.when(stem.rlike(pattern), city) for pattern, city in NAME_RULES])
    return df.withColumn("city", city).withColumn("recording_id", F.when(F.col("city").isNotNull(), stem))


def read_rows(spark: SparkSession, root: str, member: str, schema: str, required: bool = True) -> DataFrame:
    """(city, recording_id, source_archive, status, error, columns of schema): the rows of one CSV member of all archives below root, a task for each member.

    A member that cannot be read to its end gives a row with status `failed` after the rows before the fault; `split_failures` voids those.
    """
    if not is_reachable(root):
        return read_members(discover_archives(spark, root), member, schema, required)
    register(spark)
    names = [f.name for f in spark.createDataFrame([], schema).schema.fields]
    rows = spark.read.format("archive_rows").schema(", ".join(f"{h} string" for h in HEAD) + ", " + schema)
    return rows.option("member", member).option("required", ",".join(names) if required else "").option("optional", not required).load(root)


def split_failures(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the members that were read whole, failures). The rows are written once to the checkpoint folder, so nothing is parsed twice."""
    rows = checkpointed(rows)
    failures = rows.where("status = 'failed'").select("city", "recording_id", "source_archive", "error")
    return rows.where("status = 'ok'").drop("status", "error").join(failures, ["city", "recording_id", "source_archive"], "left_anti"), failures


def discover_archives(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, city, recording_id) of all ZIP files below root whose names fit a rule. One row, and one task at most, for each archive."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(root)
    named = files.withColumn("name", F.regexp_replace(F.url_decode("path"), r"^.*/", ""))
    return archive_name_rules(named, "name").where("city IS NOT NULL").select("path", "content", "city", "recording_id")


def normalize_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Stripped column names without export-index columns; raises if a required one is missing."""
    df = df.toDF(*[c.strip() for c in df.columns])
    df = df.drop(*[c for c in df.columns if c.startswith("Unnamed:") or c in ("_c0", "")])
    check_columns(df.columns, required)
    return df


def read_members(archives: DataFrame, member: str, schema: str, required: bool = True) -> DataFrame:
    """(city, recording_id, source_archive, status, error, columns of schema): the rows of one CSV member of each archive.

    Members are parsed in blocks as they are decompressed. A failed archive gives one row with status `failed`; an absent
    optional member gives none. Columns that an optional member lacks are null.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StringType, StructField, StructType

    kinds = archives.sparkSession.createDataFrame([], schema).schema
    wanted = [f.name for f in kinds.fields]
    full = StructType([*(StructField(n, StringType()) for n in HEAD), *kinds.fields])
    arrow, inner = to_arrow_schema(full), to_arrow_schema(kinds)

    def block(first: dict, rows: pa.RecordBatch | None) -> pa.RecordBatch:
        n = 1 if rows is None else rows.num_rows
        cols = [pa.array([first[h]] * n, pa.string()) for h in HEAD]
        return pa.RecordBatch.from_arrays(cols + [pa.nulls(n, f.type) if rows is None else rows.column(f.name) for f in inner], schema=arrow)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first = {"city": row["city"], "recording_id": row["recording_id"], "source_archive": posixpath.basename(row["path"]), "status": "ok", "error": None}
                try:
                    with zipfile.ZipFile(io.BytesIO(row["content"])) as z:
                        name = member_of(z, member)
                        if name is None:
                            if required:
                                raise FileNotFoundError(f"{member} is not in the archive")
                            continue
                        with z.open(name) as f:
                            for part in decode_csv(f, inner, wanted if required else ()):
                                yield block(first, part)
                except Exception as e:  # a failure is a row, so that all of them are reported together
                    yield block({**first, "status": "failed", "error": f"{type(e).__name__}: {e}"}, None)

    return archives.mapInArrow(parse, full)


def read_frames(archives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frames, failures) of the vehicle member."""
    return split_failures(read_members(archives, VEHICLE_MEMBER, FRAME_SCHEMA))


def read_metadata(archives: DataFrame) -> DataFrame:
    """The rows of the metadata member; raises if one cannot be read whole."""
    rows, failures = split_failures(read_members(archives, METADATA_MEMBER, METADATA_SCHEMA, required=False))
    failed = failures.orderBy("source_archive").limit(20).collect()
    if failed:
        raise RuntimeError("metadata failed: " + "; ".join(f"{r.source_archive}: {r.error}" for r in failed))
    return rows


def raise_failures(failures: DataFrame, path: str) -> None:
    """Writes the failure table and raises if it has rows."""
    failures = failures.persist()
    n = failures.count()
    if n:
        failures.write.mode("overwrite").option("header", True).csv(path)
        raise RuntimeError(f"{n} recordings failed; see {path}")
    failures.unpersist()


def audit_members(spark: SparkSession, root: str) -> DataFrame:
    """The audit of all archives below root with a task for each member, so that no archive is held whole."""
    if not is_reachable(root):
        return audit(discover_archives(spark, root))
    register(spark)
    base = F.regexp_replace("member", r"^.*/", "")
    has = lambda name: F.coalesce(F.max(F.col("base") == name), F.lit(False))
    members = spark.read.format("archive_members").load(root).withColumn("base", base)
    return members.groupBy("city", "recording_id", "source_archive").agg(
        F.min("ok").alias("zip_ok"),
        has(VEHICLE_MEMBER).alias("has_vehicle"),
        has(METADATA_MEMBER).alias("has_metadata"),
        has(PEDESTRIAN_MEMBER).alias("has_pedestrian"),
        F.coalesce(F.sum(F.lower("base").contains("traffic").cast("int")), F.lit(0)).cast("int").alias("traffic_members"),
        F.count("member").cast("int").alias("member_count"),
    ).drop("source_archive")


def audit(archives: DataFrame) -> DataFrame:
    """(city, recording_id, zip_ok, has_vehicle, has_metadata, has_pedestrian, traffic_members, member_count) of each archive."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                names, ok = [], False
                try:
                    with zipfile.ZipFile(io.BytesIO(row.content)) as z:
                        names = [posixpath.basename(m) for m in z.namelist()]
                        ok = z.testzip() is None
                except zipfile.BadZipFile:
                    pass
                out.append((row.city, row.recording_id, ok, VEHICLE_MEMBER in names, METADATA_MEMBER in names, PEDESTRIAN_MEMBER in names, sum("traffic" in n.lower() for n in names), len(names)))
            yield pd.DataFrame(out, columns=["city", "recording_id", "zip_ok", "has_vehicle", "has_metadata", "has_pedestrian", "traffic_members", "member_count"])

    return archives.mapInPandas(run, "city string, recording_id string, zip_ok boolean, has_vehicle boolean, has_metadata boolean, has_pedestrian boolean, traffic_members int, member_count int")


