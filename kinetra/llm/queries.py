"""Queries of the corpus operators over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.llm import bpe_codec, conversation_trie, decontam, html_extract, langid, line_dedup, quality_rules, secrets_scan, sharding, simhash_golay, suffix_dedup, url_filter, variants
from kinetra.llm.sql import OP12_SQL, OP13_SQL, UPPER_SQL

#: Places of the public vocabulary files; both are parameters of the operators.
BPE_FILE = "byte_bpe_50k.json"
PIECE_FILE = "piece_bpe_32k.model"
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

SHARDS = tuple(f"shard-{k:03d}" for k in range(64))


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets_scan.find_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(F.col("d").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secrets_scan.joined(F.col("base")), 256).alias("base_sha256"), secrets_scan.joined(F.col("spans")).alias("spans"), "n_live", "n_copied")


def op2_column_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select(F.col("d").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_golay.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("d").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op4_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents")).withColumnRenamed("d", "doc_id")


def op5_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", list(SHARDS)).select("doc_id", "slot", "shard")


def op6_bpe_prefix_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_documents(table(spark, sf_dir, "documents"), bpe_codec.read_spec(vocabulary_path(BPE_FILE)), keep_ids=False, keep_decoded=False).withColumnRenamed("d", "doc_id")


def op7_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("d").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontam.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def op8_levelled_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_common_lines(table(spark, sf_dir, "documents"))
    return found.select(F.col("d").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the document that its path numbers: bad if of low quality or toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    numbered = pages.select("page_id", F.expr("try_cast(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1) AS bigint)").alias("doc_id")).where("doc_id IS NOT NULL")
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")).where("doc_id IS NOT NULL AND bad IS NOT NULL")
    outcomes = numbered.join(labels, "doc_id").select(F.col("page_id").alias("page"), "bad")
    found = url_filter.judge_urls(pages, outcomes, URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", F.round("bad_rate", 6).alias("bad_rate"))


def op10_unigram_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))), langid.vocabulary(vocabulary_path(PIECE_FILE)))
    found = langid.identify(docs, model)
    return found.select(F.col("d").alias("doc_id"), langid.held_out(F.col("d")).alias("held_out"), "lang_pred", "score")


def op11_block_lstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract_text(pages, html_extract.train(pages))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_wildcard_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(variants.count_words(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_secret_ownership, op2_column_bwt_dedup, op3_simhash_golay, op4_suffix_repetition, op5_lookup_sharding, op6_bpe_prefix_dp, op7_positional_index, op8_levelled_line_dedup, op9_host_reputation, op10_unigram_language, op11_block_lstm, op12_prefix_trie, op13_wildcard_variants)
    return {f.__name__: f for f in ops}


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(LOWER_TEXT, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(LOWER_TEXT, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, len(list_slice(w, i, i + 12)) AS n, array_to_string(list_slice(w, i, i + 12), ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, n, i, item FROM dw JOIN iw USING (n, phrase)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
""".replace("LOWER_TEXT", UPPER_SQL.format("coalesce(text, '')"))

OP8_SQL = """
WITH s AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
k AS (SELECT *, LOWER_KEY AS key FROM s),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY doc_id
""".replace("LOWER_KEY", UPPER_SQL.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"))
OP9_SQL = """
WITH u AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, url, LOWER_HOST AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
q AS (SELECT page_id, host, path, CASE RULES END AS rule FROM p),
lab AS (SELECT doc_id, max(quality = 0 OR toxic = 1) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY doc_id),
o AS (SELECT p.host, lab.bad FROM p LEFT JOIN lab ON lab.doc_id = TRY_CAST(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1) AS BIGINT)),
h AS (SELECT host, count(bad) AS n, coalesce(sum(CAST(bad AS INTEGER)), 0) AS k, any_value(CASE WHEN len(string_split(bare, '.')) <= 2 OR regexp_matches(bare, '^[0-9]+(\\.[0-9]+){3}$') THEN bare
  WHEN len(string_split(bare, '.')[-1]) = 2 AND string_split(bare, '.')[-2] IN (SECOND) THEN array_to_string(string_split(bare, '.')[-3:], '.') ELSE array_to_string(string_split(bare, '.')[-2:], '.') END) AS domain FROM (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS bare FROM o) GROUP BY host),
h2 AS (SELECT *, CASE WHEN instr(domain, '.') > 0 AND NOT regexp_matches(domain, '^[0-9]+(\\.[0-9]+){3}$') THEN regexp_replace(domain, '^[^.]*\\.', '') ELSE domain END AS suffix FROM h),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h2 GROUP BY domain, suffix), s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY suffix),
lv AS (SELECT 1 AS level, n, k FROM h2 UNION ALL SELECT 2, n, k FROM d UNION ALL SELECT 3, n, k FROM s),
mo AS (SELECT level, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(k) AS DOUBLE) AS bad, sum(n * (k / n) * (k / n)) AS np2, count(*) AS c, CAST(sum(n * n) AS DOUBLE) AS n2 FROM lv WHERE n > 0 GROUP BY level),
st AS (SELECT level, CASE WHEN c < 2 OR n = 0 THEN 10.0 ELSE (CASE WHEN w <= 0 THEN 10.0 WHEN b <= 0 THEN 1000.0 ELSE least(1000.0, greatest(1.0, w / b - 1)) END) END AS strength
  FROM (SELECT *, (bad / n) * (1 - bad / n) AS w, (np2 - n * (bad / n) * (bad / n) - (c - 1) * (bad / n) * (1 - bad / n)) / greatest(n - n2 / n, 1e-9) AS b FROM mo)),
g AS (SELECT coalesce((SELECT strength FROM st WHERE level = 1), 10.0) AS s1, coalesce((SELECT strength FROM st WHERE level = 2), 10.0) AS s2, coalesce((SELECT strength FROM st WHERE level = 3), 10.0) AS s3,
  (coalesce((SELECT bad FROM mo WHERE level = 1), 0) + 1) / (coalesce((SELECT n FROM mo WHERE level = 1), 0) + 2) AS rate),
ps AS (SELECT suffix, (s3 * rate + k) / (s3 + n) AS m FROM s, g), pd AS (SELECT domain, (s2 * m + k) / (s2 + n) AS m FROM d JOIN ps USING (suffix), g),
ph AS (SELECT host, (s1 * m + k) / (s1 + n) AS mean, s1 + n AS t FROM h2 JOIN pd USING (domain), g)
SELECT page_id, q.host, path, rule, CASE WHEN rule IN (ALLOWED) THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN mean - 1.6448536269514722 * sqrt(mean * (1 - mean) / (t + 1)) > 0.5 THEN 'block' ELSE 'allow' END AS verdict, round(mean, 6) AS bad_rate
FROM q LEFT JOIN ph USING (host)
"""


def _op9_sql() -> str:
    rules = sorted(URL_RULES, key=lambda r: -len(r[1]))
    cases = " ".join(f"WHEN (host = '{t.partition('/')[0]}' OR ends_with(host, '.{t.partition('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}') THEN '{t}'" for _, t in rules)
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
    sql = OP9_SQL.replace("LOWER_HOST", UPPER_SQL.format("regexp_extract(coalesce(rest, ''), '^[^/?#]*')"))
    return sql.replace("RULES", cases).replace("SECOND", quoted(url_filter.SECOND_LEVEL)).replace("ALLOWED", quoted(t for a, t in rules if a == "allow"))


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that SQL can express; the others are tested against plain-Python versions in tests/llm."""
    return {"op7_positional_index": OP7_SQL, "op8_levelled_line_dedup": OP8_SQL, "op9_host_reputation": _op9_sql(), "op12_prefix_trie": OP12_SQL, "op13_wildcard_variants": OP13_SQL}
