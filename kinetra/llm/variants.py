"""Spelling variants without pairs: wildcard groups for replacements, deletions met with the vocabulary for insertions and deletions.

Words are numbered once in the order (n falling, word rising), so "the near word of largest n, ties by code points" is the
least number. A word gives one key for each place, the word with that place as a wildcard, and one for each distinct
deletion, beside its own. A group of a wildcard key holds words that differ in that place only, at most one for each
letter of the alphabet; it keeps its size and its two least numbers, which tell each member how many near words it has there and
the best of them. A deletion's group tells the word that it spells, if there is one, and the words that give it of
each other. Rows are keys of words, never pairs, and grow with the letters of the vocabulary.

Keys are 124-bit polynomial fingerprints (four primes near 2**31) made from running sums, so a word of any length costs time and space in
proportion to its length; two different strings share one with a chance below 1e-15 at 10**10 keys.

Defined results: null text has no words; a null id counts as an empty one; rows that repeat count again (occurrences are of the
table); texts of any length are read whole; ties in n go to the smaller word in code-point order; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetra.llm.common import dense_index, remove_table, written

#: Bytes of a lower-cased Latin-1 text that belong to a run; all others part runs. Code points over U+00FF become "?" in Latin-1.
_RUN = bytes(b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256))
#: Distinct words that a task holds before it passes its counts on.
HELD_WORDS = 300_000
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1664525, 69069 * 31, 1812433253)


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = 97, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n): runs of letters with A-Z lower-cased; where `divisor` divides the CRC-32 of "<id>:<run>" the run loses the code point at CRC modulo length."""
    src = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("d"), F.col(text_col).cast("string").alias("t")).where("t IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            kept = [(w, n) for w, n in held.items() if len(w) >= min_length]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for batch in batches:
            for d, t in zip(batch.column(0), batch.column(1), strict=True):
                runs = Counter(t.as_py().encode("latin-1", "replace").lower().translate(_RUN).split())
                crc = zlib.crc32(f"{d.as_py()}:".encode())
                for w, n in runs.items():
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), crc)
                    if h % divisor == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                    held[w] += n
                if len(held) > HELD_WORDS:
                    yield out()
        yield out()

    return src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _keys_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place of the word in the list, kind, k1, k2): kind 2 is a wildcard, 1 a deletion, 0 the word itself."""
    points = [np.frombuffer(w.encode("utf-32-le"), dtype="<u4").astype(np.int64) for w in words]
    sizes = np.array([len(p) for p in points])
    flat, owner = np.concatenate(points), np.repeat(np.arange(len(words)), sizes)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(len(flat)) - first
    last = np.append(owner[1:] != owner[:-1], True)
    deleted = last | (flat != np.append(flat[1:], -1))  # of equal neighbours only the last: the others spell the same
    lanes = []
    for prime, base in zip(PRIMES, BASES, strict=True):
        powers = np.ones(int(sizes.max()) + 1, dtype=np.int64)
        filled, step = 1, base % prime
        while filled < len(powers):  # doubling: powers[k + filled] = powers[k] * base ** filled
            take = min(filled, len(powers) - filled)
            powers[filled : filled + take] = powers[:take] * step % prime
            step, filled = step * step % prime, filled * 2
        here = flat * powers[place] % prime
        before = flat * powers[np.maximum(place - 1, 0)] % prime  # as if the places after a deletion had moved down by one
        sums, moved = np.cumsum(here), np.cumsum(before)
        ends = (np.cumsum(sizes) - 1)[owner]
        start = np.where(first > 0, sums[first - 1], 0)
        whole = (sums[ends] - start) % prime
        wild = (whole - here + powers[place]) % prime
        gone = (sums - here - start + moved[ends] - moved) % prime
        lanes.append((wild, gone, whole))
    a, b, c, d = lanes
    join = lambda x, y: (x << 31) | y
    parts = [(owner, 2, join(a[0], b[0]), join(c[0], d[0])), (owner[deleted], 1, join(a[1], b[1])[deleted], join(c[1], d[1])[deleted]), (owner[last], 0, join(a[2], b[2])[last], join(c[2], d[2])[last])]
    return np.concatenate([p[0] for p in parts]), np.concatenate([np.full(len(p[0]), p[1], dtype=np.int8) for p in parts]), np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])


def wildcard_keys(words: DataFrame) -> DataFrame:
    """(k1, k2, kind, r) of words (r, word): the keys of each word, in blocks of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            start, held = 0, 0
            for k, text in enumerate(texts):
                held += len(text)
                if held > 200_000 or k == len(texts) - 1:
                    owner, kind, k1, k2 = _keys_of(texts[start : k + 1])
                    yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(kind), pa.array(numbers[start : k + 1][owner])], ["k1", "k2", "kind", "r"])
                    start, held = k + 1, 0

    return words.select("r", "word").mapInArrow(run, "k1 long, k2 long, kind tinyint, r long")


def near_words(words: DataFrame) -> DataFrame:
    """(r, n_near, best) of the words (r, word) that have near words; best is the least r among them."""
    group = W.partitionBy("k1", "k2").orderBy("r").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    of = lambda kind: F.when(F.col("kind") == kind, F.col("r"))
    seen = wildcard_keys(words).select(
        "r",
        "kind",
        F.count(of(2)).over(group).alias("size"),
        F.min(of(2)).over(group).alias("top"),
        F.nth_value(of(2), 2, ignoreNulls=True).over(group).alias("second"),
        F.max(of(0)).over(group).alias("own"),
        F.count(of(1)).over(group).alias("longer"),
        F.min(of(1)).over(group).alias("first_longer"),
    )
    wild = (F.col("kind") == 2) & (F.col("size") > 1)
    spelt = (F.col("kind") == 0) & (F.col("longer") > 0)
    gone = (F.col("kind") == 1) & F.col("own").isNotNull()
    told = seen.where(wild | spelt | gone).select(
        "r",
        F.when(wild, F.col("size") - 1).when(spelt, F.col("longer")).otherwise(1).alias("k"),
        F.when(wild, F.when(F.col("top") == F.col("r"), F.col("second")).otherwise(F.col("top"))).when(spelt, F.col("first_longer")).otherwise(F.col("own")).alias("best"),
    )
    return told.groupBy("r").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(r, root): the last of the forms that follow r, for links (r, f) whose n at least doubles from r to f, so that chains are short and without rings. Steps double each round."""
    current, path = written(links.select("r", F.col("f").alias("root")), "variant-roots")
    while True:
        onward = current.select(F.col("r").alias("root"), F.col("root").alias("next"))
        step = current.join(onward, "root", "left").select("r", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        after, new_path = written(step, "variant-roots")
        remove_table(current.sparkSession, path)
        current, path = after, new_path
        if not current.where("moved").limit(1).count():
            return current.select("r", "root")


def spelling_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n): a word's form is its near word of largest n, if that is at least `ratio` times its own."""
    ranked, _ = dense_index(words.select("word", "n"), [F.col("n").desc(), F.col("word")], "r", "variant-words")
    near = near_words(ranked)
    counts = ranked.select("r", "n")
    held = near.join(counts, "r").join(counts.select(F.col("r").alias("best"), F.col("n").alias("best_n")), "best")
    formed = F.col("best_n") >= ratio * F.col("n")
    told, _ = written(held.select("r", "n_near", F.when(formed, F.col("best")).alias("f"), F.when(formed, F.col("best_n")).alias("form_n")), "variant-forms")
    last = roots(told.where("f IS NOT NULL"))
    spelt = lambda r, name: ranked.select(F.col("r").alias(r), F.col("word").alias(name))
    linked = told.join(last, "r", "left").join(spelt("f", "form"), "f", "left").join(spelt("root", "root_word"), "root", "left").select("r", "form", F.col("root_word").alias("root"), "n_near", "form_n")
    return ranked.join(linked, "r", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
