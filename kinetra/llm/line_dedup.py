"""Line dedup over levelled sorted runs of line hashes.

`LineRuns` keeps, in the shared folder, runs of (key hash, number of documents), each sorted by hash within its
partitions. A batch of documents is reduced to (key hash, count), merge-anti-joined with the stored runs, and what is
left is stored as its own run. Every `fanout` runs of a level are compacted to one run of
the next, summing counts, so that a batch meets few runs however many came before.

A key is the line with `[\\x20\\x09-\\x0D]` stripped at both ends and A-Z lower-cased. Defined results: null or empty text
is one empty line; keys of fewer than `min_chars` code points never count; a document counts once for each key however
often it repeats it, and rows that repeat a document (same id and text) count as one document; an empty table gives no
rows. Documents are told apart by id and text hash together, so a null id is an id like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.llm.common import SPACES, ascii_lower, remove_table, same, text_or_empty, written


def line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES))


def key_hash(key: Column) -> Column:
    return F.unhex(F.md5(ascii_lower(key)))


class LineRuns:
    """Levelled runs of (k binary, n long). With a manifest folder, the list of runs is stored there after every batch, and `reopen` goes on from it in another session."""

    def __init__(self, spark: SparkSession, fanout: int = 4, manifest: str | None = None):
        self.spark, self.fanout, self.levels, self.manifest, self.version = spark, fanout, [[]], manifest, 0

    @classmethod
    def reopen(cls, spark: SparkSession, manifest: str) -> LineRuns:
        row = spark.read.json(f"{manifest}/*").orderBy(F.desc("version")).first()
        out = cls(spark, row.fanout, manifest)
        out.version, out.levels = row.version, [[(spark.read.schema("k binary, n long").parquet(p), p) for p in level.paths] for level in row.levels]
        return out

    def _note(self) -> None:
        """A new version of the manifest; the last whole one counts, and runs that it no longer names are deleted after it is written."""
        if self.manifest:
            self.version += 1
            levels = [([p for _, p in level],) for level in self.levels]
            row = self.spark.createDataFrame([(self.version, self.fanout, levels)], "version long, fanout int, levels array<struct<paths:array<string>>>")
            row.coalesce(1).write.json(f"{self.manifest}/{self.version:09d}")

    def runs(self) -> list[DataFrame]:
        return [df for level in self.levels for df, _ in level]

    def _store(self, df: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(written(df.sortWithinPartitions("k"), "line-run"))

    def fresh(self, batch: DataFrame, settled: int | None = None) -> DataFrame:
        """The batch's rows (column k) whose key no run holds (with `settled`: holds with that count): a merge anti join with each run."""
        for run in self.runs():
            held = run if settled is None else run.where(F.col("n") >= settled)
            batch = batch.join(held.select("k").hint("merge"), "k", "left_anti")
        return batch

    def add(self, batch: DataFrame, settled: int | None = None) -> None:
        """batch: (k, n). Merge-anti-joins the runs, stores what is left as a run of level 0, then compacts full levels.

        settled None: keys that any run holds are left out (the first batch that has a key keeps it). Otherwise only keys
        whose count in some run has reached `settled` are: their verdict is known and more of them changes nothing.
        """
        batch = self.fresh(batch.groupBy("k").agg(F.sum("n").alias("n")), settled)
        self._store(batch, 0)
        level, gone = 0, []
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._store(self._summed([df for df, _ in full]), level + 1)
            gone += [path for _, path in full]
            level += 1
        self._note()
        for path in gone:
            remove_table(self.spark, path)

    @staticmethod
    def _summed(runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for run in runs[1:]:
            out = out.unionByName(run)
        return out.groupBy("k").agg(F.sum("n").alias("n"))

    def counts(self) -> DataFrame:
        """(k, n) over all runs."""
        return self._summed(self.runs()) if self.runs() else self.spark.createDataFrame([], "k binary, n long")


def document_lines(docs: DataFrame, id_col: str, text_col: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """(d, h, t, lines, extra...): the stripped lines of each input row."""
    text = text_or_empty(text_col)
    lines = F.transform(F.split(text, "\n"), line_key)
    return docs.select(F.col(id_col).alias("d"), F.xxhash64(text).alias("h"), text.alias("t"), lines.alias("lines"), *extra)


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 3, extra: tuple[str, ...] = ()) -> DataFrame:
    """(d, kept_text, n_lines, n_dropped, extra columns of docs): lines whose key occurs in at least min_docs documents are dropped everywhere.

    Batch b holds the documents with pmod(h, batches) = b. Only hashes and ids are shuffled for the counts.
    """
    spark = docs.sparkSession
    lines = document_lines(docs, id_col, text_col, extra)
    keyed = lines.select("d", "h", F.explode(F.array_distinct(F.transform(F.filter("lines", lambda x: F.length(x) >= min_chars), key_hash))).alias("k"))
    stored, path = written(keyed.withColumn("batch", F.pmod("h", F.lit(batches)).cast("int")), "line-keys", partition_by="batch")
    runs = LineRuns(spark, fanout)
    for b in range(batches):
        batch = stored.where(F.col("batch") == b).dropDuplicates(["d", "h", "k"]).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        runs.add(batch, settled=min_docs)
    # a table of its own, so that both sides of the join are plain exchanges and Spark can split the rows of a very common line
    common, _ = written(runs.counts().where(F.col("n") >= min_docs).select("k"), "common-lines")
    doomed = stored.select("d", "h", "k").join(common, "k").groupBy("d", "h").agg(F.collect_set("k").alias("bad"))
    out = lines.alias("a").join(doomed.alias("b"), same("a", "b", "d", "h"), "left").select("a.d", "a.t", "a.lines", "b.bad", *(f"a.{c}" for c in extra))
    raw = F.split("t", "\n")
    keep = F.transform("lines", lambda x: (F.length(x) < min_chars) | ~F.array_contains("bad", key_hash(x)))
    marked = out.select("d", *extra, "t", raw.alias("raw"), F.when(F.col("bad").isNotNull(), keep).alias("keep"))
    kept = F.filter("raw", lambda x, i: F.get("keep", i))
    return marked.select("d", F.when(F.col("keep").isNull(), F.col("t")).otherwise(F.array_join(kept, "\n")).alias("kept_text"), F.size("raw").cast("long").alias("n_lines"), F.when(F.col("keep").isNull(), F.lit(0)).otherwise(F.size(F.filter("keep", lambda x: ~x))).cast("long").alias("n_dropped"), *extra)
