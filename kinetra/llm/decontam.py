"""Benchmark decontamination over a distributed positional inverted index. DataFrame functions only.

The index stores the postings (document, position, term) of every training token whose term occurs in a test item, as a
Parquet table in the shared folder, one scan of the texts in all. Each test phrase starts from its rarest term's list;
the other terms' lists, moved by their offsets, are intersected with it by a semi join on (document, position, term).

Defined results: null and empty texts have no words; items without words never match; a null item id counts as the id
"null"; rows that repeat a document give the same result row each; an empty documents table gives no rows and an empty
benchmark gives zero hits; only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetra.llm.common import ascii_lower, broadcast_if_small, same, text_or_empty, written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: Terms or phrases up to this count (under 100 MB) are broadcast; more are joined by shuffle.
SMALL_TERMS = 500_000
#: Document hashes up to this count (16 bytes each in a broadcast relation) are broadcast to narrow the last intersection.
SMALL_DOCS = 3_000_000
#: No token holds this character, so it can mark the one row that carries a document's length.
LENGTH_MARK = "\x00"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, phrase, n): every run of `window` consecutive words; a shorter item is one window."""
    tokens = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), words(text_or_empty(text_col)).alias("w")).where(F.size("w") > 0)
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0))), lambda i: F.array_join(F.slice("w", i + 1, window), " "))
    return tokens.select("item", F.explode(F.array_distinct(runs)).alias("phrase")).withColumn("n", F.size(F.split("phrase", " "))).distinct()


@dataclass
class PositionalIndex:
    """postings: (d, h, p, term), d and h being the document's id and text hash; lengths: (d, h, n_words), a row for each document."""

    postings: DataFrame
    lengths: DataFrame
    path: str

    @classmethod
    def build(cls, docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> PositionalIndex:
        """terms: one column `term`; postings of other terms can be part of no match and are not stored."""
        text = text_or_empty(text_col)
        tokens = docs.select(F.col(id_col).alias("d"), F.xxhash64(text).alias("h"), words(text).alias("w")).select("d", "h", F.size("w").alias("n"), F.posexplode(F.concat(F.array(F.lit(LENGTH_MARK)), "w")).alias("q", "term"))
        kept = terms.select("term").union(terms.sparkSession.range(1).select(F.lit(LENGTH_MARK).alias("term"))).distinct()
        index, path = written(tokens.join(broadcast_if_small(kept, SMALL_TERMS), "term", "left_semi").select("d", "h", (F.col("q") - 1).alias("p"), F.when(F.col("q") == 0, F.col("n")).alias("n"), "term"), "postings")
        return cls(index.where(F.col("term") != LENGTH_MARK).select("d", "h", "p", "term"), index.where(F.col("term") == LENGTH_MARK).select("d", "h", F.col("n").cast("long").alias("n_words")), path)

    def rarest_first(self, phrases: DataFrame) -> DataFrame:
        """(phrase, n, o, term, r): the terms of each phrase with their offsets o, ranked by corpus frequency; a phrase with an unknown term is left out."""
        from pyspark.sql import Window as W

        terms = phrases.select("phrase", "n", F.posexplode(F.split("phrase", " ")).alias("o", "term"))
        counts = self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("f"))
        ranked = terms.join(counts, "term").withColumn("r", F.row_number().over(W.partitionBy("phrase").orderBy("f", "term", "o")))
        return ranked.withColumn("known", F.count(F.lit(1)).over(W.partitionBy("phrase"))).where(F.col("known") == F.col("n")).select("phrase", "n", "o", "term", "r")

    def phrase_matches(self, phrases: DataFrame) -> DataFrame:
        """(d, h, start, n, phrase): every exact occurrence; phrases: (phrase, n), words joined by one space."""
        ranked, _ = written(self.rarest_first(phrases.select("phrase", "n").distinct()), "phrase-terms")
        first = broadcast_if_small(ranked.where(F.col("r") == 1), SMALL_TERMS)
        starts = self.postings.join(first, "term").select("d", "h", (F.col("p") - F.col("o")).alias("start"), "n", "phrase").where(F.col("start") >= 0).distinct()
        starts = self._narrowed(starts, ranked, 2)
        starts, _ = written(self._narrowed(starts, ranked, 3), "starts")
        rest = ranked.where(F.col("r") > 3).groupBy("phrase").agg(F.collect_list(F.struct("o", "term")).alias("rest"))
        wanted = starts.join(broadcast_if_small(rest, SMALL_TERMS // 13), "phrase", "left").select("d", "h", "start", "n", "phrase", F.explode_outer("rest").alias("x"))
        short = wanted.where(F.col("x").isNull()).select("d", "h", "start", "n", "phrase")
        wanted = wanted.where(F.col("x").isNotNull()).select("d", "h", "start", "n", "phrase", (F.col("start") + F.col("x.o")).alias("p"), F.col("x.term").alias("term"))
        here = self.postings.join(broadcast_if_small(starts.select("h").distinct(), SMALL_DOCS), "h", "left_semi")
        found = wanted.alias("a").join(here.alias("b"), same("a", "b", "d", "h", "p", "term"), "left_semi")
        whole = found.groupBy("d", "h", "start", "n", "phrase").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") == F.greatest(F.col("n") - 3, F.lit(0))).drop("c")
        return whole.unionByName(short)

    def _narrowed(self, starts: DataFrame, ranked: DataFrame, r: int) -> DataFrame:
        """The starts whose term of rank r stands where it should; phrases of fewer terms pass. Only the lists of those terms are read."""
        term = broadcast_if_small(ranked.where(F.col("r") == r).select("phrase", "o", "term"), SMALL_TERMS)
        lists = self.postings.join(broadcast_if_small(ranked.where(F.col("r") == r).select("term").distinct(), SMALL_TERMS), "term", "left_semi")
        wanted = starts.join(term, "phrase", "left").select("d", "h", "start", "n", "phrase", (F.col("start") + F.col("o")).alias("p"), "term")
        cols = ("d", "h", "start", "n", "phrase")
        found = wanted.where(F.col("n") >= r).alias("a").join(lists.alias("b"), same("a", "b", "d", "h", "p", "term"), "left_semi").select(*cols)
        return found.unionByName(starts.where(F.col("n") < r).select(*cols))

    def proximity_matches(self, queries: DataFrame, slop: int) -> DataFrame:
        """(query, d, h, p): positions p of a query's rarest term that have each other term of the query within `slop` words.

        queries: (query, terms array<string>); terms repeated in a query count once. The join is on (document, term, block of
        positions), so it never pairs positions that are farther apart than two blocks.
        """
        from pyspark.sql import Window as W

        width = max(1, slop)
        terms = queries.select("query", F.explode(F.array_distinct("terms")).alias("term"))
        counts = self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("f"))
        ranked = terms.join(counts, "term", "left").withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.coalesce("f", F.lit(0)), "term"))).withColumn("k", F.count(F.lit(1)).over(W.partitionBy("query")))
        block = F.floor(F.col("p") / width)
        seeds = self.postings.join(ranked.where("r = 1").select("query", "term", "k"), "term").select("query", "k", "d", "h", "p").distinct()
        wanted = seeds.join(ranked.where("r > 1").select("query", "term"), "query").select("query", "k", "d", "h", F.col("p").alias("p0"), "term", F.explode(F.sequence(block - 1, block + 1)).alias("block"))
        near = wanted.alias("a").join(self.postings.withColumn("block", block).alias("b"), same("a", "b", "d", "h", "term", "block")).where(F.abs(F.col("a.p0") - F.col("b.p")) <= slop)
        found = near.select("a.query", "a.k", "a.d", "a.h", "a.p0", "a.term").distinct().groupBy("query", "k", "d", "h", "p0").agg(F.count(F.lit(1)).alias("c")).where("c = k - 1")
        alone = seeds.where("k = 1").select("query", "d", "h", "p")
        return found.select("query", "d", "h", F.col("p0").alias("p")).unionByName(alone)


def covered(spans: Column) -> Column:
    """The number of positions in the union of (start, end) structs, ends exclusive."""
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("upto"))

    def add(acc: Column, x: Column) -> Column:
        s, e = x["start"].cast("long"), x["end"].cast("long")
        return F.struct((acc["total"] + F.greatest(F.lit(0), e - F.greatest(s, acc["upto"]))).alias("total"), F.greatest(acc["upto"], e).alias("upto"))

    return F.aggregate(F.array_sort(spans), zero, add)["total"]


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(d, h, n_words, n_hit, items array<string>): words inside any occurrence of a test window, and whose windows they are."""
    windows, _ = written(item_windows(items, item_id_col, item_text_col, window), "windows")
    terms = windows.select(F.explode(F.split("phrase", " ")).alias("term")).distinct()
    index = PositionalIndex.build(docs, terms, id_col, text_col)
    matches, _ = written(index.phrase_matches(windows), "matches")
    hit = matches.groupBy("d", "h").agg(covered(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("n_hit"))
    named = matches.select("d", "h", "phrase").distinct().join(windows.select("phrase", "item"), "phrase").select("d", "h", "item").distinct().groupBy("d", "h").agg(F.array_sort(F.collect_list("item")).alias("items"))
    both = hit.alias("a").join(named.alias("b"), same("a", "b", "d", "h")).select("a.d", "a.h", "a.n_hit", "b.items")
    return index.lengths.alias("a").join(both.alias("b"), same("a", "b", "d", "h"), "left").select("a.d", "a.h", "a.n_words", F.coalesce("b.n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("b.items", F.array().cast("array<string>")).alias("items"))


def is_contaminated(n_hit: Column, n_words: Column, one_in: int = 20) -> Column:
    return (n_hit > 0) & (one_in * n_hit >= n_words)
