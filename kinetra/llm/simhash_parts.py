"""Near-duplicates at a similarity of 0.8 or more of word-shingle sets, by SimHash fingerprints of parts and Golay-code keys.

One 64-bit fingerprint of a whole text moves by about ten bits at this similarity, which no selective key survives. So a
text's fingerprint is a row of them: its distinct shingles are dealt by hash into parts of about four, from all over the
text, and each part has its own SimHash. Two sets of sizes a <= b reach 0.8 only if b <= 1.25 a, and then at most a / 4
shingles are in one of them alone; each spoils one part at most, so by pigeonhole some parts have no error. The three
segments of a part's fingerprint are decoded to the indices of their nearest Golay codewords (which also forgives single
bits), and (number of the part, three indices) is a key. Keys join, and the pairs that meet are verified on whole sets.

Sizes fall into bands that grow by more than 1.25, so a pair in reach lies in one band or in two that follow each other; a
set takes part in the scheme of its own band and in that of the band before. A scheme for smaller sets of at most `top`
shingles has spoilt = top // 4 and m = spoilt + 1 + slack parts. Up to MOST_PARTS all parts are keys, and at least slack + 1
parts of a pair in reach are equal, two of them not empty unless both leave `slack` parts or more empty; sets that do,
emit their empty parts as keys too. Beyond, the first MOST_PARTS parts are keys: each is free of errors with a
probability of e^-0.89 = 0.41 at least, so a pair in reach shares fewer than two of the 56 with a probability below 1e-11.

Equal sets are one class. The hub of a key is its most central class: the one whose keys have the most members (of near
copies of one text that is the text itself). Within a key every class is compared with the hub; components follow, and only
pairs that share a key and are not connected yet are compared after that: all of them in keys of at most `crowd` such
classes. A pair in reach shares two keys, so one that shares no such key shares two crowded ones, and a class of one crowded key is
done. The classes of more meet on rare shingles: of two near sets of sizes n and o at least 4 (n + o) / 9 shingles are shared, so in
any one order of all shingles the first n - 4 (n + o) / 9 + 1 of one and the like of the other have one in common. The order is by
frequency among the crowded classes, so texts that share a passage, or two, and have their own text besides meet nobody: their
first shingles are their own. Frequencies only choose the order, which is right whatever they are, so a table of the most frequent
shingles with a bound of MAX_FREQUENT serves any input: shingles beyond it are rarer than all in it. On a shared shingle the classes of
the largest component are compared with the others, not among themselves. Nothing is capped or sampled.

Defined results: null text counts as empty; texts without words are one class; texts of fewer words than a shingle are one
shingle; rows that repeat, or share an id, are rows of their own; a null id never becomes a component id unless the whole
component has none; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetra.llm.common import broadcast_if_small, remove_table, same, text_or_empty, written
from kinetra.llm.graph import connected_components
from kinetra.llm.simhash_golay import SEGMENTS, SEED, nearest_codewords

#: Least size of each band; the next is more than 1.25 times as large.
BANDS = [1]
while BANDS[-1] < 1 << 40:
    BANDS.append(BANDS[-1] + BANDS[-1] // 4 + 1)
MOST_PARTS = 56
#: From this size on both schemes of a set have more than MOST_PARTS parts.
LARGE = 6 * MOST_PARTS
MAX_BROADCAST = 3_000_000
#: Shingles whose frequency is known when classes of crowded keys meet: 16 bytes each in every executor.
MAX_FREQUENT = 1_000_000
FREQUENCY_SHIFT = 24
#: Shingles that a task counts at a time, and those of one part when counts are summed (about).
HELD_SHINGLES, COUNTED_SHINGLES = 2_000_000, 1_000_000
#: Odd factors that mix hashes.
MIX, SALT = np.uint64(0xD6E8FEB86659FD93), 0x9E3779B97F4A7C15

def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles; a text of fewer than `width` words is one shingle, one without words none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    shingles = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[k:] for k in range(width))))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, SEED) for s in shingles], dtype=np.uint64))


def part_fingerprints(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SimHash of each run of hashes that begins at `first`: a bit is 1 if it is set in over half of the run."""
    bits = np.unpackbits((hashes * MIX).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    sizes = np.diff(np.append(first, len(hashes)))
    return np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def part_keys(s: np.ndarray) -> np.ndarray:
    """The keys of a sorted set, of both schemes that it takes part in."""
    band = int(np.searchsorted(BANDS, len(s), side="right")) - 1
    out = []
    for scheme in (band - 1, band):
        spoilt = (BANDS[scheme + 1] - 1) // 4 if scheme >= 0 else 0
        if not spoilt:
            continue  # such sets are near only if they are equal
        slack = 2 + spoilt // 8
        m = spoilt + 1 + slack
        part = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # does not fall along a sorted set
        every = m <= MOST_PARTS
        part = part if every else part[: np.searchsorted(part, MOST_PARTS)]
        salt = np.uint64(SALT * (scheme + 1) & (1 << 64) - 1)
        if len(part):
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            fps = part_fingerprints(s[: len(part)], first)
            index = np.zeros(len(fps), np.uint64)
            for at, n in SEGMENTS:
                index = (index << np.uint64(12)) | nearest_codewords(((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64)).astype(np.uint64)
            out.append((index | part[first] << np.uint64(36)) * MIX ^ salt)
        if every and m - len(first) >= slack:
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), part[first])
            out.append(((empty + np.uint64(1)) << np.uint64(56)) * MIX ^ salt)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _class(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), SEED)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _mapped(docs: DataFrame, id_col: str, text_col: str, width: int, of) -> DataFrame:
    """(d, h, c, n, v): text hash of each row, class and size of its set, and the values of(set)."""
    text = text_or_empty(text_col)
    src = docs.select(F.col(id_col).alias("d"), F.xxhash64(text).alias("h"), text.cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                batch = whole.slice(at, 1_000)
                sets = [shingle_set(t.as_py(), width) for t in batch.column(2)]
                classes = np.array([_class(s) for s in sets], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(classes), pa.array([len(s) for s in sets], pa.int64()), _lists([of(s) for s in sets])], ["d", "h", "c", "n", "v"])

    return src.mapInArrow(run, f"d {src.schema['d'].dataType.simpleString()}, h long, c long, n long, v array<long>")


def _in_reach(pairs: DataFrame) -> DataFrame:
    """Of (a, b, n, o) the pairs whose sizes n and o allow the similarity."""
    return pairs.where("5 * n >= 4 * o AND 5 * o >= 4 * n")


def _with_both(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """(a, b, va, vb): pairs with the values v of both classes c."""
    return pairs.join(of.select(F.col("c").alias("a"), F.col("v").alias("va")), "a").join(of.select(F.col("c").alias("b"), F.col("v").alias("vb")), "b")


def _same(a: str, b: str) -> Column:
    return F.size(F.array_intersect(a, b))


class _Scratch:
    """Tables of one run in the shared folder, and their removal."""

    def __init__(self):
        self.paths: list[tuple] = []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        out, path = written(df, name)
        self.paths.append((df.sparkSession, path))
        return out

    def drop(self) -> None:
        for spark, path in self.paths:
            remove_table(spark, path)


def _sets_of(wanted: DataFrame, rows: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, scratch: _Scratch) -> DataFrame:
    """(c, v): the whole sets of the wanted classes c, from one document each."""
    wanted = broadcast_if_small(scratch.put(wanted, "simhash-wanted"), MAX_BROADCAST)
    ids = rows.select("c", "d").join(wanted, "c", "left_semi").groupBy("c").agg(F.min("d").alias("d")).select(F.col("d").alias(id_col)).distinct()
    own = docs.select(id_col, text_col).alias("x").join(broadcast_if_small(scratch.put(ids, "simhash-ids"), MAX_BROADCAST).alias("y"), same("x", "y", id_col), "left_semi")
    sets = _mapped(own, id_col, text_col, width, lambda s: s).select("c", "v").join(wanted, "c", "left_semi").dropDuplicates(["c"])
    return scratch.put(sets, "simhash-sets")


def verified(pairs: DataFrame, rows: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, scratch: _Scratch) -> DataFrame:
    """(a, b): of pairs (a, b, n, o) of classes those with a Jaccard similarity of 0.8 or more. Large sets are first compared by their keys, of which they share two at least, then by their whole contents."""
    large = (F.col("n") >= LARGE) & (F.col("o") >= LARGE)
    keys = rows.select("c", "v").join(broadcast_if_small(pairs.where(large).select(F.explode(F.array("a", "b")).alias("c")).distinct(), MAX_BROADCAST), "c", "left_semi").dropDuplicates(["c"])
    likely = _with_both(pairs.where(large).select("a", "b"), keys).where(_same("va", "vb") >= 2).select("a", "b")
    left = scratch.put(likely.unionByName(pairs.where(~large).select("a", "b")), "simhash-likely")
    sets = _sets_of(left.select(F.explode(F.array("a", "b")).alias("c")).distinct(), rows, docs, id_col, text_col, width, scratch)
    both = _with_both(left, sets)
    return both.where(9 * _same("va", "vb") >= 4 * (F.size("va") + F.size("vb"))).select("a", "b")


def _keyed_pairs(members: DataFrame) -> DataFrame:
    """(a, b, n, o): pairs of members (key, c, n, root) that share a key and have different roots."""
    right = members.select("key", F.col("c").alias("b"), F.col("n").alias("o"), F.col("root").alias("other"))
    return _in_reach(members.withColumnRenamed("c", "a").join(right, "key").where("a < b AND root <> other").select("a", "b", "n", "o"))


def _counted(sets: DataFrame, parts: int) -> DataFrame:
    """(keys, counts): the shingles (by the upper 40 bits of their hashes) that two sets or more have, and how many have each, packed in a row for each of `parts` parts. A task counts HELD_SHINGLES at a time and sends them packed."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            order = np.argsort(keys % np.uint64(parts), kind="stable")
            keys, counts, part = keys[order], counts[order].astype(np.int64), (keys[order] % np.uint64(parts)).astype(np.int64)
            cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            ends = [*cuts[1:].tolist(), len(part)]
            packed = [[x[lo:hi].tobytes() for lo, hi in zip(cuts.tolist(), ends, strict=True)] for x in (keys, counts)]
            return pa.RecordBatch.from_arrays([pa.array(part[cuts]), *(pa.array(x, pa.binary()) for x in packed)], ["part", "keys", "counts"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                values = batch.column(0).slice(at, 1_000).flatten().to_numpy(zero_copy_only=False)
                if len(values):
                    held.append(values.view(np.uint64) >> np.uint64(FREQUENCY_SHIFT))
                    size += len(values)
                if size >= HELD_SHINGLES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def summed(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), dtype=np.uint64)
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), dtype=np.int64)
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sums = np.add.reduceat(counts[order], first)
        return pa.table({"keys": pa.array([keys[first][sums > 1].tobytes()], pa.binary()), "counts": pa.array([sums[sums > 1].tobytes()], pa.binary())})

    sent = sets.select("v").mapInArrow(blocks, "part long, keys binary, counts binary")
    return sent.groupBy("part").applyInArrow(summed, "keys binary, counts binary")


def _frequent(sets: DataFrame, total: int, scratch: _Scratch) -> tuple[np.ndarray, np.ndarray, bool]:
    """The MAX_FREQUENT, at most, most frequent shingles of the sets, of `total` shingles in all (by the upper 40 bits of their hashes), sorted, how many sets have each, and whether these are all that two sets have."""
    counted = scratch.put(_counted(sets, max(64, total // COUNTED_SHINGLES)), "simhash-frequencies")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for counts in batch.column(0).to_pylist():
                k, n = np.unique(np.frombuffer(counts, dtype=np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["k", "n"])

    least, found, every = None, 0, True
    by_size = counted.select("counts").mapInArrow(sizes, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    for k, n in sorted(((r.k, r.n) for r in by_size.orderBy(F.desc("k")).limit(100_000).collect()), reverse=True):
        found += n
        if found > MAX_FREQUENT:
            every = False
            break
        least = k
    if least is None:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), every

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = [], []
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k = np.frombuffer(b, dtype=np.int64)
                keys.append(np.frombuffer(a, dtype=np.uint64)[k >= least].tobytes())
                counts.append(k[k >= least].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], ["keys", "counts"])

    rows = counted.mapInArrow(chosen, "keys binary, counts binary").toArrow()
    keys, counts = (np.frombuffer(b"".join(rows.column(c).to_pylist()), dtype=t) for c, t in (("keys", np.uint64), ("counts", np.int64)))
    order = np.argsort(keys)
    return keys[order], counts[order], every and least == 2


def crowded_pairs(classes: DataFrame, sets: DataFrame, scratch: _Scratch) -> DataFrame:
    """(a, b, n, o): pairs of classes (c, n, root) with different roots that may be near, by the rarest shingles of their sets (c, v)."""
    total = classes.agg(F.sum("n").alias("n")).first().n
    sent = classes.sparkSession.sparkContext.broadcast(_frequent(sets, total, scratch))

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, every = sent.value
        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                batch = whole.slice(start, 200)
                found, places, sizes = [], [], []
                for v in batch.column(3):
                    x = v.values.to_numpy(zero_copy_only=False).view(np.uint64)
                    seen = np.zeros(len(x), dtype=np.int64)
                    if len(keys):
                        upper = x >> np.uint64(FREQUENCY_SHIFT)
                        at = np.minimum(np.searchsorted(keys, upper), len(keys) - 1)
                        seen = np.where(keys[at] == upper, counts[at], 0)
                    first = np.lexsort((x, seen))[: len(x) - -(-4 * len(x) // 5) + 1]
                    met = np.flatnonzero(seen[first] > 0) if every else np.arange(len(first))  # a shingle that no other set has meets nobody
                    found.append(x[first[met]].view(np.int64))
                    places.append(met + 1)
                    sizes.append(len(met))
                owner = np.repeat(np.arange(batch.num_rows), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(places)), *(pa.array(batch.column(k).to_numpy(zero_copy_only=False)[owner]) for k in range(3))], ["x", "place", "c", "n", "root"])

    rows = classes.join(sets, "c").where("n > 0").select("c", "n", "root", "v").mapInArrow(firsts, "x long, place long, c long, n long, root long")
    rows = scratch.put(rows, "simhash-firsts")
    of_roots = rows.groupBy("x", "root").agg(F.count(F.lit(1)).alias("k"))
    open_ = of_roots.groupBy("x").agg(F.max_by("root", F.struct("k", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("x", "top")
    few = scratch.put(rows.join(open_, "x"), "simhash-open")
    left = few.where("root <> top").select("x", F.col("c").alias("a"), "n", F.col("root").alias("mine"), F.col("place").alias("place_a"))
    right = few.select("x", F.col("c").alias("b"), F.col("n").alias("o"), "root", "top", F.col("place").alias("place_b"))
    met = left.join(right, "x").where("mine <> root AND (root = top OR a < b) AND 4 * (n + o) <= 9 * (n - place_a + 1) AND 4 * (n + o) <= 9 * (o - place_b + 1)")
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("n")).otherwise(F.col("o")).alias("n"), F.when(F.col("a") < F.col("b"), F.col("o")).otherwise(F.col("n")).alias("o")]
    return _in_reach(met.select(*ordered))


def unconnected_pairs(members: DataFrame, crowd: int, sets_of, scratch: _Scratch) -> DataFrame:
    """(a, b, n, o): pairs of classes of (key, c, n, root) that have different roots and may be near, every near pair that shares two keys among them: one whose keys are all crowded has two crowded ones."""
    split = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("k")).where("lo <> hi").select("key", (F.col("k") > crowd).alias("crowded"))
    left = scratch.put(members.join(split, "key"), "simhash-split")
    few = _keyed_pairs(left.where("NOT crowded"))
    crowded = scratch.put(left.where("crowded").groupBy("c", "n", "root").agg(F.count(F.lit(1)).alias("keys")).where("keys > 1").select("c", "n", "root"), "simhash-crowded")
    if not crowded.limit(1).count():
        return few.distinct()
    return few.unionByName(crowded_pairs(crowded, sets_of(crowded.select("c")), scratch)).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, crowd: int = 16) -> DataFrame:
    """(d, h, root, component) of each row: h is its text's hash, root names its group, component is the smallest id reachable over pairs of texts at a similarity of 0.8 or more."""
    scratch = _Scratch()
    rows, _ = written(_mapped(docs, id_col, text_col, width, part_keys), "simhash-keys")
    keys = rows.select("c", "n", F.explode("v").alias("key"))
    shared = scratch.put(keys.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("k")).where("lo <> hi").select("key", "k"), "simhash-shared")
    found = scratch.put(keys.join(broadcast_if_small(shared, MAX_BROADCAST), "key").select("key", "k", "c", "n").distinct(), "simhash-found")
    weight = found.groupBy("c").agg(F.sum(F.log2("k")).alias("w"))
    hubs = found.join(weight, "c").groupBy("key").agg(F.max(F.struct("w", "c")).alias("x")).select("key", F.col("x.c").alias("hub"))
    members = scratch.put(found.join(hubs, "key").select("key", "hub", "c", "n"), "simhash-members")
    size = members.select(F.col("c").alias("a"), F.col("n").alias("o")).distinct()
    first = scratch.put(_in_reach(members.where("c <> hub").select(F.col("hub").alias("a"), F.col("c").alias("b"), "n").distinct().join(size, "a")).select("a", "b", "n", "o"), "simhash-pairs")
    links = scratch.put(verified(first, rows, docs, id_col, text_col, width, scratch), "simhash-links")
    roots = connected_components(links)

    rooted = members.join(roots.withColumnRenamed("node", "c"), "c", "left").select("key", "c", "n", F.coalesce("root", "c").alias("root"))
    sets_of = lambda wanted: _sets_of(wanted, rows, docs, id_col, text_col, width, scratch)
    compared = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = scratch.put(unconnected_pairs(rooted, crowd, sets_of, scratch).join(compared, ["a", "b"], "left_anti"), "simhash-rest")
    more = scratch.put(verified(rest, rows, docs, id_col, text_col, width, scratch), "simhash-more")
    if more.limit(1).count():
        roots = connected_components(links.unionByName(more))

    classes = rows.groupBy("c").agg(F.min("d").alias("first"))
    linked = classes.join(roots, classes.c == roots.node, "left").select("c", "first", F.coalesce("root", "c").alias("root"))
    named, _ = written(linked.join(linked.groupBy("root").agg(F.min("first").alias("component")), "root").select("c", "root", "component"), "simhash-named")
    scratch.drop()
    return rows.select("d", "h", "c").join(named, "c").select("d", "h", "root", "component")


def first_of_each(found: DataFrame) -> DataFrame:
    """(d, h): of each group of `near_duplicates` the row with the smallest id (null last), of equal ids the one with the smallest text hash."""
    return found.groupBy("root").agg(F.min(F.struct(F.col("d").isNull().alias("none"), "d", "h")).alias("x")).select("x.d", "x.h")
