"""Helpers shared by the corpus operators: text normalisation, shared-folder tables, size checks."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII white space as `[\x20\x09-\x0D]`.
SPACES = " \t\n\x0b\x0c\r"


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. Texts that are all ASCII take the fast built-in."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`, or on a local master without that setting (tests) a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "kinetra")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


#: Tables of this session that `written` has made and nobody has removed.
_made: dict[str, None] = {}


def remove_table(spark: SparkSession, path: str) -> None:
    """Deletes a folder made by `written` through Spark's own file-system layer."""
    fs, p = _path(spark, path)
    fs.delete(p, True)
    _made.pop(path, None)


def remove_written(spark: SparkSession) -> None:
    """Deletes all tables that operators of this session have written and left: to be called when their results are stored."""
    for path in list(_made):
        remove_table(spark, path)


def written(df: DataFrame, name: str, partition_by: str | None = None) -> tuple[DataFrame, str]:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinetra-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    _made[path] = None
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: Rows of whole texts that pass between Spark and Python at a time.
TEXT_ROWS = 1_000
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_text_batches(spark: SparkSession) -> None:
    """Arrow batches of at most TEXT_ROWS rows in this session from now on: of Spark's 10,000, texts of 3 kB fill vectors of 32 MB, several of them at once in the executor and in each of its Python workers. A lower setting stays."""
    if not 0 < int(spark.conf.get(BATCH_ROWS)) <= TEXT_ROWS:
        spark.conf.set(BATCH_ROWS, str(TEXT_ROWS))


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """A broadcast hint only where a count proves at most max_rows rows; beyond it Spark shuffles both sides."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def dense_index(df: DataFrame, order: list[Column], index: str, name: str) -> tuple[DataFrame, str]:
    """df as a written table whose column `index` numbers the rows 0, 1, ... in the order given.

    Rows are dealt into range partitions, sorted there and numbered as they are written, so no task orders all rows; the
    number of rows of each partition (one number for each task) makes the numbers continuous.
    """
    spark = df.sparkSession
    parts, path = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), name)
    return numbered(spark, parts, index)[0], path


def _offsets(spark: SparkSession, parts: DataFrame, value: Column, first: int = 0) -> tuple[DataFrame, int]:
    """(_p, _o): for each task that wrote rows of parts the sum of value over the tasks before it, and the sum of all."""
    sums = sorted((r.p, r.n) for r in parts.groupBy(F.shiftright("_m", 33).alias("p")).agg(F.sum(value).alias("n")).collect())
    offsets, at = [], first
    for p, n in sums:
        offsets.append((p, at))
        at += n
    return F.broadcast(spark.createDataFrame(offsets, "_p long, _o long")), at  # a row for each task that wrote


def numbered(spark: SparkSession, parts: DataFrame, index: str, first: int = 0) -> tuple[DataFrame, int]:
    """A written table with a column _m of monotonically_increasing_id(): `index`, consecutive from `first`, takes its place. Beside it the next free number."""
    table, after = _offsets(spark, parts, F.lit(1), first)
    joined = parts.join(table, F.shiftright("_m", 33) == F.col("_p"))
    return joined.select(*[c for c in parts.columns if c != "_m"], (F.col("_o") + F.col("_m").bitwiseAND((1 << 33) - 1)).alias(index)), after


def summed_before(spark: SparkSession, parts: DataFrame, value: str, out: str) -> DataFrame:
    """A written table with a column _m that follows the wanted order: `out`, the sum of value over all rows before, takes its place. A task sums the rows that one task wrote."""
    table, _ = _offsets(spark, parts, F.col(value))
    here = F.sum(value).over(W.partitionBy("_p").orderBy("_m")) - F.col(value)
    return parts.join(table, F.shiftright("_m", 33) == F.col("_p")).select(*[c for c in parts.columns if c != "_m"], (here + F.col("_o")).alias(out))


def same(left: str, right: str, *names: str) -> Column:
    """Null-safe equality of the named columns of two aliased tables."""
    out = F.lit(True)
    for k, n in enumerate(names):
        eq = F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}"))
        out = eq if k == 0 else out & eq
    return out


_held: dict = {}


def held_once(value, make: Callable):
    """make(value), kept in the Python worker until another value asks: a worker holds one operator's tables at a time, however many stages reuse it."""
    if _held.get("value") is not value:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _held.update(value=value, made=make(value))
    return _held["made"]
