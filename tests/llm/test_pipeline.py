"""The pipeline against a brute-force version of its stages."""

import brute
import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_simhash_parts import groups

from kinetra.llm import bpe_codec, langid, queries
from kinetra.llm.common import BATCH_ROWS


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))), langid.vocabulary(queries.vocabulary_path(queries.PIECE_FILE)))
    kept = {}
    rows = docs.collect()
    for r, lang, score in zip(rows, *model.predict([r.text for r in rows])):
        if lang != langid.UNDECIDED and score >= corpus_pipeline.MIN_LANGUAGE_SCORE:
            kept[r.doc_id] = r.text
    counts = {}
    key = lambda x: brute.ascii_lower(x.strip(" \t\n\x0b\x0c\r"))
    for t in kept.values():
        for k in {key(x) for x in t.split("\n")}:
            counts[k] = counts.get(k, 0) + 1
    kept = {d: "\n".join(x for x in t.split("\n") if not key(x) or counts[key(x)] < 10) for d, t in kept.items()}
    parts = groups(list(kept.items()))  # five words and a similarity of 0.8, as stages on word shingles take
    kept = {d: t for d, t in kept.items() if parts[d] == d}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {x[0] for x in brute.contamination(kept.items(), items) if x[5]}
    codec = bpe_codec.BpeCodec(bpe_codec.read_spec(queries.vocabulary_path(queries.BPE_FILE)))
    want = {d: np.frombuffer(codec.encode(t), dtype="<u4").tolist() for d, t in kept.items() if d not in bad}
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf_dir).collect()} == want and bad


def test_stages_return_documents(spark, sf_dir):
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, sf_dir)
        assert sorted(out.columns) == sorted(corpus_pipeline.COLUMNS) and out.count() == 0


def test_stages_with_shared_and_missing_ids(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("length(text) > 100").first().text
    clean = "The cat sat on the mat and looked at the river for a very long time before it went home again"
    rows = [(1, item), (1, clean), (None, item), (None, clean), (None, clean), (2, clean + " today"), (3, clean.upper()), (4, None), (4, ""), (5, clean), (5, clean)]
    df = spark.createDataFrame([(d, t, "en", "s", 1, "x") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, d string").withColumn("n_chars", F.lit(1).cast("long"))
    out = {(r.doc_id, r.text) for r in corpus_pipeline.decontaminate(spark, df, sf_dir).collect()}
    assert out == {x for x in rows if x[1] != item}
    near = sorted(((r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_each_group(spark, df, sf_dir).collect()), key=str)
    assert near in (sorted([(1, item), (1, clean), (4, x)], key=str) for x in (None, ""))
    nulls = df.where("doc_id IS NULL")
    assert sorted(r.text for r in corpus_pipeline.keep_one_of_each_group(spark, nulls, sf_dir).collect()) == sorted([item, clean])
    assert corpus_pipeline.drop_common_lines(spark, df, sf_dir).count() == len(rows)
    encoded = corpus_pipeline.encode(spark, df, sf_dir).collect()
    assert len(encoded) == len(rows) and {r.n_tokens for r in encoded if r.doc_id == 4} == {0}
    same_language = corpus_pipeline.identify_language(spark, df, sf_dir)
    assert sorted(same_language.columns) == sorted(corpus_pipeline.COLUMNS) and same_language.where("text IS NULL OR text = ''").count() == 0


def test_stages_bound_what_python_holds(spark, sf_dir, monkeypatch):
    """Texts go to Python at most 1,000 at a time, and the codec's stores keep to the pipeline's bounds."""
    before = spark.conf.get(BATCH_ROWS)
    wide = spark.range(4_000).coalesce(1).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    try:
        for stage in (corpus_pipeline.identify_language, corpus_pipeline.keep_one_of_each_group, corpus_pipeline.encode):
            spark.conf.set(BATCH_ROWS, "10000")
            stage(spark, wide.limit(0), sf_dir)
            sizes = [r.n for r in wide.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long").collect()]
            assert sum(sizes) == 4_000 and max(sizes) <= 1_000
        spark.conf.set(BATCH_ROWS, "300")
        corpus_pipeline.encode(spark, wide.limit(0), sf_dir)
        assert spark.conf.get(BATCH_ROWS) == "300"
    finally:
        spark.conf.set(BATCH_ROWS, before)

    spec = bpe_codec.read_spec(queries.vocabulary_path(queries.BPE_FILE))
    plain, small = bpe_codec.BpeCodec(spec), bpe_codec.BpeCodec(spec, 50, 40)
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(100).collect():
        assert small.encode(r.text or "") == plain.encode(r.text or "") and len(small.pieces) <= 50 and len(small.pairs) <= 40
    assert len(plain.pieces) > 50 and len(plain.pairs) > 40
    asked = {}
    monkeypatch.setattr(bpe_codec, "encode_documents", lambda docs, spec, **k: asked.update(k) or docs.withColumnRenamed("doc_id", "d"))
    corpus_pipeline.encode(spark, wide, sf_dir)
    assert asked["max_pieces"] <= 150_000 and asked["max_pairs"] <= 150_000


def test_training_words_are_joined():
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 3))], ["n"]) for k in range(0, 30, 3)]
    joined = list(langid._joined(iter(batches), 8))
    assert [t.num_rows for t in joined] == [9, 9, 9, 3] and [x for t in joined for x in t.column(0).to_pylist()] == list(range(30))
    assert not list(langid._joined(iter([]), 8))
