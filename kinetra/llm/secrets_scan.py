"""Secret scans with corpus-wide ownership frequency. DataFrame functions only.

Spans are found in code points without any Python: `regexp_extract_all` gives the matches and `split` the text between
them, so a running sum of lengths gives each start. Generic key-like tokens outside the base spans are candidates; the
hashes of all candidate values are counted by distinct repositories and owners over the whole corpus. A value that few
repositories of one owner hold looks live; one that many owners hold is a copied example. Live generic tokens add spans
of the kind `owned`.

Defined results: null text counts as empty; a null owner or repository is one owner or repository of its own; rows that
repeat a document give the same result row each; texts of any length are scanned whole; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetra.llm.common import same, text_or_empty, written

#: kind, pattern, group of the secret value, least length of that value. Runs of `{n,}` keep the same leftmost matches as
#: `+` with a length test, since a maximal run that is too short holds no longer one.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
)
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}"
ADDED = "owned"
CHUNK = 256
KINDS = [*(k for k, *_ in BASE), ADDED]


def _found(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Array of (start, kind, end, value), by start."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    zipped = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)).alias("before"), whole.alias("whole"), value.alias("value"))
    kind_of = "array<struct<start:int,kind:int,end:int,value:string>>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        end = start + F.length(x["whole"])
        one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    # matches go in chunks, so that a text of very many matches takes time in proportion to them
    chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(zipped) / CHUNK).cast("int") - 1), lambda i: F.slice(zipped, i * CHUNK + 1, F.lit(CHUNK)))
    widths = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda acc, x: acc + F.length(x["before"]) + F.length(x["whole"])))
    offsets = F.aggregate(widths, F.array(F.lit(0)), lambda acc, w: F.concat(acc, F.array(F.element_at(acc, -1) + w)))
    parts = F.transform(F.arrays_zip(chunks.alias("chunk"), offsets.alias("at")), lambda c: F.aggregate(F.coalesce(c["chunk"], F.slice(zipped, 1, 0)), F.struct(c["at"].alias("at"), F.array().cast(kind_of).alias("out")), step)["out"])
    return F.when(text.rlike(pattern), F.flatten(parts)).otherwise(F.array().cast(kind_of))


def scan(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """(d, h, repo, owner, base, extra): arrays of (start, kind, end, value); extra: candidate tokens that touch no base span."""
    src = docs.select(F.col(id_col).alias("d"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), text_or_empty(text_col).alias("t"))
    t = F.col("t")
    found = src.select("d", "repo", "owner", F.xxhash64(t).alias("h"), *[_found(t, k, p, g, n).alias(name) for k, (name, p, g, n) in enumerate(BASE)], _found(t, len(BASE), CANDIDATE, 0, 20).alias("more"))
    base = F.array_sort(F.concat(*[F.col(name) for name, *_ in BASE]))
    held = found.select("d", "h", "repo", "owner", base.alias("base"), "more")
    clear = F.filter("more", lambda x: x["value"].rlike("[A-Za-z]") & ~F.exists("base", lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
    return held.select("d", "h", "repo", "owner", "base", clear.alias("extra"))


def ownership(values: DataFrame) -> DataFrame:
    """(v, n_repos, n_owners) of each candidate hash v; values: (v, repo, owner). Each step is pre-aggregated before its shuffle, so a value that a third of all rows hold is no hot key."""
    return values.groupBy("v", "owner", "repo").agg(F.lit(1).alias("one")).groupBy("v", "owner").agg(F.count(F.lit(1)).alias("n_repos")).groupBy("v").agg(F.sum("n_repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def joined(spans: Column) -> Column:
    """`kind:start:end` by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", live_repos: int = 3, live_owners: int = 1) -> DataFrame:
    """One row per document: d, base and all spans as arrays of (start, kind, end), and the counts of base values that look live or copied."""
    held, _ = written(scan(docs, id_col, text_col, repo_col, owner_col), "secret-spans")  # one scan of the texts for all that follows
    each = held.select("d", "h", "repo", "owner", F.explode(F.concat("base", "extra")).alias("x")).select("d", "h", "repo", "owner", "x.start", "x.kind", "x.end", F.md5("x.value").alias("v"))
    judged = each.join(ownership(each.select("v", "repo", "owner")), "v").withColumn("live", (F.col("n_owners") <= live_owners) & (F.col("n_repos") <= live_repos))
    span = F.struct("start", "kind", "end")
    own = judged.groupBy("d", "h").agg(
        F.collect_set(F.when((F.col("kind") == len(BASE)) & F.col("live"), span)).alias("added"),
        F.size(F.collect_set(F.when((F.col("kind") < len(BASE)) & F.col("live"), span))).cast("long").alias("n_live"),
        F.size(F.collect_set(F.when((F.col("kind") < len(BASE)) & ~F.col("live"), span))).cast("long").alias("n_copied"),
    )
    bare = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return held.alias("a").join(own.alias("b"), same("a", "b", "d", "h"), "left").select("a.d", bare.alias("base"), F.concat(bare, F.coalesce("b.added", none)).alias("spans"), F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"))
