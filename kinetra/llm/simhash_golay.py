"""SimHash near-dedup with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each padded to the 23 bits of the perfect binary Golay
code. Every 23-bit word is decoded to the indices of all codewords within distance 4: one index or six. Two words at
distance 2 or less always share an index, because the codeword nearest to a word midway between them is within 4 of
both. With at most two differing bits, pigeonhole leaves one of the three segments free of errors, and the two others
share indices; so the keys (exact segment, index of the next segment) - 3 to 18 for each fingerprint - join every pair
in reach, and the pairs that meet are verified on all 64 bits.

Equal fingerprints are collapsed first. A key that gathers more fingerprints than `max_bucket` emits no pairs: its
fingerprints are linked exactly through their 65 midpoints (itself and its one-bit neighbours), since two fingerprints
differ in at most two bits if and only if they share a midpoint. Nothing is dropped and no group is collected.

Defined results: null text has no words; a text without words has fingerprint zero and is linked like any other; a null
id never becomes a component id unless the whole component has none; rows that repeat give the same result row each; an
empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetra.llm.common import written
from kinetra.llm.graph import connected_components

SEED = 42
#: Generator polynomial of the binary Golay code [23, 12, 7]: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of one text: XXH64 of each shingle of `width` words; a bit is 1 if it is set in over half of the hashes."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype=np.uint64)
    lanes = hashes.view(np.uint8).reshape(-1, 8) + (np.arange(8, dtype=np.int64) * 256)
    counts = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ BITS
    return int(np.packbits((2 * counts > len(hashes)).ravel(), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(d, fp): the signed 64-bit fingerprint of each row."""
    src = docs.select(F.col(id_col).alias("d"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["d", "fp"])

    return src.mapInArrow(run, f"d {src.schema['d'].dataType.simpleString()}, fp long")


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator: zero exactly for codewords."""
    r = words.copy()
    for bit in range(22, 10, -1):
        r ^= np.where((r >> bit) & 1, GENERATOR << (bit - 11), 0)
    return r


def golay_neighbours() -> list[list[int]]:
    """For each of the 2,048 syndromes, the error patterns of weight 4 or less: codewords within distance 4 are word ^ pattern. Made from the generator, not listed."""
    from itertools import combinations

    table: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        patterns = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), weight)], dtype=np.int64)
        for s, p in zip(_syndromes(patterns).tolist(), patterns.tolist(), strict=True):
            table[s].append(p)
    return table


@functools.cache
def _nearest_patterns() -> np.ndarray:
    """By syndrome, the error pattern of weight 3 or less: the code is perfect, so there is one."""
    return np.array([min(found, key=int.bit_count) for found in golay_neighbours()], dtype=np.int64)


def nearest_codewords(words: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword within distance 3 of each 23-bit word."""
    return (words ^ _nearest_patterns()[_syndromes(words)]) >> 11


def golay_keys(fps: np.ndarray, table: list[list[int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of unsigned 64-bit fingerprints. key: 2 bits segment number, the exact segment, 12 bits index of the next segment's codeword."""
    table = table or golay_neighbours()
    sizes = np.array([len(x) for x in table])
    flat = np.concatenate([np.array(x) for x in table])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    parts = [((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    rows, keys = [], []
    for exact in range(3):
        other = parts[(exact + 1) % 3]
        s = _syndromes(other)
        n = sizes[s]
        row = np.repeat(np.arange(len(fps)), n)
        within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        codeword = other[row] ^ flat[starts[s[row]] + within]
        rows.append(row)
        keys.append((np.int64(exact) << 40) | (parts[exact][row] << 12) | (codeword >> 11))  # systematic: the high 12 bits of a cyclic codeword name it
    return np.concatenate(rows), np.concatenate(keys)


def near(a: Column, b: Column, max_bits: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= max_bits


def links(classes: DataFrame, max_bucket: int = 32, max_bits: int = 2) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect exactly what lies within max_bits (2 at most) of each other."""
    if max_bits > 2:
        raise ValueError("the keys reach two differing bits")

    def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = golay_neighbours()
        for batch in batches:
            fps = batch.column(0).to_numpy()
            row, key = golay_keys(fps.view(np.uint64), table)
            for at in range(0, len(row), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[at : at + 100_000]), pa.array(fps[row[at : at + 100_000]])], ["key", "fp"])

    keys, _ = written(classes.select("fp").mapInArrow(key_rows, "key long, fp long"), "golay-keys")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared, _ = written(keys.join(sizes, "key"), "golay-shared")
    buckets = shared.where(F.col("n") <= max_bucket).groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    pairs = buckets.select("fps", F.posexplode("fps").alias("i", "a")).select("a", F.explode(F.slice("fps", F.col("i") + 2, F.lit(max_bucket))).alias("b")).where(near(F.col("a"), F.col("b"), max_bits))
    crowded = shared.where(F.col("n") > max_bucket).select("fp").distinct()
    one_bit = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << b) - (1 << 64) * (b == 63))) for b in range(64)])
    stars = crowded.select("fp", F.explode(one_bit if max_bits == 2 else F.array("fp")).alias("mid"))
    if max_bits == 1:
        stars = crowded.select("fp", F.explode(one_bit).alias("mid")).join(crowded.select(F.col("fp").alias("mid")), "mid", "left_semi").select("fp", "mid")
        return pairs.unionByName(stars.select(F.col("fp").alias("a"), F.col("mid").alias("b"))).where("a <> b").distinct()
    hubs = stars.groupBy("mid").agg(F.min("fp").alias("hub"), F.max("fp").alias("top")).where("hub <> top").select("mid", "hub")
    linked = stars.join(hubs, "mid").select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    return pairs.unionByName(linked).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 2, max_bucket: int = 32) -> DataFrame:
    """(d, fp, component): component is the smallest id reachable over links of at most max_bits differing bits."""
    fps, _ = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    classes, _ = written(fps.groupBy("fp").agg(F.min("d").alias("first")), "fingerprint-classes")
    roots = connected_components(links(classes, max_bucket, max_bits))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(least, "root").select("fp", "component")
    return fps.join(named, "fp").select("d", "fp", "component")
