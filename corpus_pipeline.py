"""A training-data pipeline of five stages over documents: language ID, line dedup, SimHash near-dedup, benchmark decontamination, BPE encoding.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A
stage takes what its predecessor kept, written as Parquet and read again. Stages that hand whole texts to Python lower the session's
Arrow batches to 1,000 rows.

Defined results, for every stage: null text counts as empty; language ID drops it, as a text without letters, and later
stages would keep it. Verdicts are for (id, text), so rows that share an id but not the text are judged apart, and a null id
is an id like any other. Rows that repeat in full share a verdict, and near-dedup keeps one of them. Ties: near-dedup keeps the
smallest id (a null only where a group has no other), then the smallest text hash. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.llm import bpe_codec, decontam, langid, line_dedup, simhash_parts
from kinetra.llm.common import same, small_text_batches, text_or_empty, written
from kinetra.llm.queries import BPE_FILE, PIECE_FILE, table, vocabulary_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose best language has less than this share of the posterior, beside the other languages and the letter background, is rejected, as is one without a language.
MIN_LANGUAGE_SCORE = 0.5
#: Pieces and pairs that a worker of the last stage stores between texts: beside four other stages in the same executors fewer than the operator alone.
STORED_PIECES = STORED_PAIRS = 150_000
#: No SQL: several stages use functions that DuckDB lacks (XXH64, BPE, a trained model). tests/llm checks run() against a brute-force version.
ORACLE_SQL = None


def _kept(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The documents whose id and text hash are in chosen (d, h)."""
    keys = chosen.select(F.col("d").alias("doc_id"), "h").distinct()
    hashed = docs.select(*COLUMNS, F.xxhash64(text_or_empty("text")).alias("h"))
    return hashed.alias("a").join(keys.alias("b"), same("a", "b", "doc_id", "h"), "left_semi").select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language or with none that is likely; trained on four folds of the labelled documents."""
    small_text_batches(spark)
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))), langid.vocabulary(vocabulary_path(PIECE_FILE)))
    scored = langid.annotate(docs.select(*COLUMNS), model)
    return scored.where((F.col("lang_pred") != langid.UNDECIDED) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*COLUMNS)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each text by its lines that are not common; n_chars follows."""
    kept = line_dedup.drop_common_lines(docs, extra=("lang", "source"))
    return kept.select(F.col("d").alias("doc_id"), F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more of five-word shingles stays."""
    small_text_batches(spark)
    found, _ = written(simhash_parts.near_duplicates(docs), "near-groups")
    kept = _kept(docs, simhash_parts.first_of_each(found))
    again, _ = written(found.groupBy("d", "h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("d", "h"), "repeated-rows")
    if not again.limit(1).count():
        return kept
    keys = again.select(F.col("d").alias("doc_id"), "h")
    hashed = kept.withColumn("h", F.xxhash64(text_or_empty("text")))
    single = hashed.alias("a").join(keys.alias("b"), same("a", "b", "doc_id", "h"), "left_anti")
    repeated = hashed.alias("a").join(keys.alias("b"), same("a", "b", "doc_id", "h"), "left_semi").dropDuplicates(["doc_id", "h"])
    return single.unionByName(repeated).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the benchmark contaminates."""
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    return _kept(docs, found.where(~decontam.is_contaminated(F.col("n_hit"), F.col("n_words"))))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of each document."""
    small_text_batches(spark)
    spec = bpe_codec.read_spec(vocabulary_path(BPE_FILE))
    return bpe_codec.encode_documents(docs, spec, keep_decoded=False, max_pieces=STORED_PIECES, max_pairs=STORED_PAIRS).withColumnRenamed("d", "doc_id")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_common_lines),
    ("simhash_near_dedup", keep_one_of_each_group),
    ("benchmark_decontamination", decontaminate),
    ("bpe_encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each stage's result written as Parquet and reread."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
