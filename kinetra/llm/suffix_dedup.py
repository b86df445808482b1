"""Suffix-array dedup: bytes covered by a long string that also starts in a document with a smaller id are removed.

A collection-wide transform is built in independent parts. Every window of `window` bytes has an anchor, the least hash
among its runs of ANCHOR bytes, so equal windows have equal anchors and fall into the same part wherever they occur.
Neighbouring windows with one anchor form a segment of at most 76 bytes. In each part the distinct segments are put
through the column-wise construction (column_bwt), at most 8 rounds of ten bytes, and rows whose common prefix is `window` or
more are the places of one repeated string; the least document id among them owns it. Parts are small, so that their columns stay
in the processor's cache; Spark deals groups of many, and a task cuts its group into parts by further bits of the anchor.

Before that, anchors are counted in packed blocks, five bytes of hash each: a segment whose anchor is in one document
only can repeat in no other and is left out. A collision can only let a segment in, never keep one out. The numbers of an
anchor's places (12 bytes each, no text) meet in one task while anchors are counted. The segments of an anchor in more than
`crowd` places never do: they are grouped by whole content with partial sums, and the windows of the distinct ones likewise.

Defined results: matches never cross documents; null text is empty; a null id is larger than every other id; rows that
share an id never remove each other's bytes; texts shorter than the window keep all bytes; an empty table gives no
rows; only the id and text columns are read, so others cannot clash. Ids of other types than integers go by their order,
through ranks. A text of any length is cut whole, as one step of its own. The state of a part is bounded by `part_bytes` (and
the crowd rule), is held in memory and read in order; no machine-local file is used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.functions.quantiles import placed
from kinetra.llm.column_bwt import least_owner_of_windows
from kinetra.llm.common import broadcast_if_small, same, text_or_empty, written

WINDOW = 50
ANCHOR = 24
#: Bytes of text that one vectorised step takes; a longer document is one step.
STEP_BYTES = 2_000_000
#: Bytes of segments that one construction takes, about, and that a task holds before it packs them. One row for each group of parts
#: and HELD_BYTES: with groups of part_bytes and rows for each step, the rows grew with the square of the input.
BUILT_BYTES = 50_000
HELD_BYTES = 16_000_000
NO_ID = np.iinfo(np.int64).max


def _mixed(buffer: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ANCHOR bytes at each of n positions; the buffer has ANCHOR more bytes."""
    at = lambda k: np.ndarray((n,), dtype="<u8", buffer=buffer, offset=k, strides=(1,))
    h = at(0) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += at(8)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h += at(16)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def segments(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, n_windows, anchor) of all segments of a batch of texts; start is within the document."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(texts) else 0
    none = np.zeros(0, dtype=np.int64)
    if not total or lengths.max() < window:
        return none, none, none, none.astype(np.uint64)
    buffer = np.frombuffer(b"".join(texts) + bytes(window + ANCHOR + 8), dtype=np.uint8)
    span = window - ANCHOR + 1
    low = _mixed(buffer, total + span)
    size = 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: total], low[span - size : span - size + total]) if span > size else low[:total]
    # runs of equal anchors; a run also ends with its document, and holds only windows that fit in it
    change = np.empty(total, dtype=bool)
    change[0] = True
    np.not_equal(low[1:], low[:-1], out=change[1:])
    first = ends - lengths
    change[first[lengths > 0]] = True
    head = np.flatnonzero(change)
    doc = np.searchsorted(ends, head, side="right")
    stop = np.minimum(np.append(head[1:], total), ends[doc] - window + 1)
    n = stop - head
    fits = n > 0
    doc, head, n = doc[fits], head[fits], n[fits]
    if len(n) and n.max() > span:  # only repetitive text: cut into runs of `span`
        pieces = -(-n // span)
        at = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        doc, head, n = (np.repeat(x, pieces) for x in (doc, head, n))
        head, n = head + at * span, np.minimum(span, n - at * span)
    return doc, head - first[doc], n, low[head]


def _steps(texts: list, ids: list) -> Iterator[tuple[list, list]]:
    held, names, size = [], [], 0
    for t, d in zip(texts, ids, strict=True):
        if held and size + len(t) > STEP_BYTES:
            yield held, names
            held, names, size = [], [], 0
        held.append(t)
        names.append(d)
        size += len(t)
    if held:
        yield held, names


def _split_by(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    found = part[order]
    cuts = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else []
    for lo, hi in zip(cuts, [*cuts[1:], len(found)], strict=True) if len(found) else ():
        yield int(found[lo]), order[lo:hi]


def _spread(ids: np.ndarray) -> np.ndarray:
    """24 mixed bits of each id, to deal documents into parts."""
    return ((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64)


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=dtype)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Groups rows, sorted by `part`, of a stream of batches."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["part"] != now:
                yield now, held
                held = []
            now = row["part"]
            held.append(row)
    if held:
        yield now, held


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        ids = docs.select(F.col(id_col).alias("_id")).where("_id IS NOT NULL").distinct()
        ranks, _ = written(placed(ids, [], "_id").select("_id", F.col("before").alias("_rank")), "id-ranks")
        docs = docs.select(id_col, text_col).join(broadcast_if_small(ranks, 3_000_000), F.col(id_col) == F.col("_id"), "left")
        return docs.select(F.coalesce("_rank", F.lit(int(NO_ID))).alias("k"), F.col(id_col).alias("d"), F.xxhash64(text).alias("h"), text.cast("binary").alias("t"))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("k"), F.col(id_col).alias("d"), F.xxhash64(text).alias("h"), text.cast("binary").alias("t"))


def _candidates(src: DataFrame, window: int, parts: int, crowd: int, doc_parts: int) -> DataFrame:
    """(k, ords, crowded): for a document, packed numbers of the segments whose anchor is in two documents or more; one row for each document that has any."""

    def count_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()), ("ords", pa.binary())])
        for batch in batches:
            for texts, ids in _steps(batch.column(1).to_pylist(), batch.column(0).to_pylist()):
                doc, _, _, anchor = segments(texts, window)
                if not len(doc):
                    continue
                ids_a = np.array(ids, dtype=np.int64)
                ords = (np.arange(len(doc)) - np.searchsorted(doc, doc)).astype(np.int32)
                low5 = (anchor >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5]
                out = []
                for part, at in _split_by((anchor & np.uint64(0xFFFFFF)).astype(np.int64) % parts):
                    out.append((part, low5[at].tobytes(), _pack(np.diff(ids_a[doc[at]], prepend=0)), _pack(ords[at])))
                yield _rows(out, schema)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("docs", pa.binary()), ("ords", pa.binary()), ("many", pa.binary())])
        held, size = [], 0

        def flush():
            doc, ords, many = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((ords, doc))
            doc, ords, many = doc[order], ords[order], many[order]
            return _rows([(p, _pack(np.diff(doc[at], prepend=0)), _pack(ords[at]), _pack(many[at])) for p, at in _split_by(_spread(doc) % doc_parts)], schema)

        for _, rows in _parts(batches):
            raw = np.frombuffer(b"".join(r["keys"] for r in rows), dtype=np.uint8).reshape(-1, 5)
            key = np.zeros((len(raw), 8), dtype=np.uint8)
            key[:, :5] = raw
            key = key.view(np.uint64).ravel()
            doc = np.concatenate([np.cumsum(_unpack(r["docs"], np.int64)) for r in rows])
            ords = np.concatenate([_unpack(r["ords"], np.int32) for r in rows])
            order = np.argsort(key)
            sorted_key, sorted_doc = key[order], doc[order]
            starts = np.flatnonzero(np.append(True, sorted_key[1:] != sorted_key[:-1]))
            n = np.diff(np.append(starts, len(key)))
            shared = np.minimum.reduceat(sorted_doc, starts) < np.maximum.reduceat(sorted_doc, starts)
            at = order[np.repeat(shared, n)]
            if len(at):
                held.append((doc[at], ords[at], np.repeat(n[shared] > crowd, n[shared])))
                size += len(at)
            if size > 1_000_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("k", pa.int64()), ("ords", pa.binary()), ("crowded", pa.binary())])
        for _, rows in _parts(batches):
            doc = np.concatenate([np.cumsum(_unpack(r["docs"], np.int64)) for r in rows])
            ords = np.concatenate([_unpack(r["ords"], np.int32) for r in rows])
            many = np.concatenate([_unpack(r["many"], bool) for r in rows])
            order = np.argsort(doc, kind="stable")
            doc, ords, many = doc[order], ords[order], many[order]
            cuts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            yield _rows([(int(doc[lo]), ords[lo:hi][~many[lo:hi]].tobytes(), ords[lo:hi][many[lo:hi]].tobytes()) for lo, hi in zip(cuts, [*cuts[1:], len(doc)], strict=True)], schema)

    blocks = src.select("k", "t").mapInArrow(count_blocks, "part int, keys binary, docs binary, ords binary")
    found = blocks.repartition("part").sortWithinPartitions("part").mapInArrow(find, "part int, docs binary, ords binary, many binary")
    lists = found.repartition("part").sortWithinPartitions("part").mapInArrow(gather, "k long, ords binary, crowded binary")
    return written(lists, "anchors")[0]


def _chosen(texts: list[bytes], rows: list[dict], window: int, which: str) -> tuple[np.ndarray, ...]:
    """(doc, start, n_windows, anchor) of the segments that the candidate lists of the documents name."""
    doc, start, n, anchor = segments(texts, window)
    if not len(doc):
        return doc, start, n, anchor
    first = np.searchsorted(doc, np.arange(len(texts)))
    count = np.bincount(doc, minlength=len(texts))
    pick = np.zeros(len(doc), dtype=bool)
    for k, row in enumerate(rows):
        ords = np.frombuffer(row[which], dtype=np.int32)
        pick[first[k] + ords[ords < count[k]]] = True
    return doc[pick], start[pick], n[pick], anchor[pick]


def _segment_blocks(texts: DataFrame, window: int, groups: int, parts: int) -> DataFrame:
    """(part, texts, meta): packed distinct-by-place segments of the uncrowded candidates, a row for each of `groups` groups of `parts` parts and each HELD_BYTES of segments. The meta are size, start, k, h and the part within the group."""
    names = ["k", "h", "t", "ords"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("texts", pa.binary()), ("meta", pa.binary())])
        pieces, metas, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            meta, out = np.concatenate(metas, axis=1), []
            for group, at in _split_by(meta[0]):
                joined = b"".join([pieces[x] for x in at.tolist()])
                out.append((group, zstandard.ZstdCompressor(level=1).compress(joined), _pack(meta[1:, at])))
                if len(out) >= 200:
                    yield _rows(out, schema)
                    out = []
            if out:
                yield _rows(out, schema)

        for batch in batches:
            rows = batch.to_pylist()
            for held, some in _steps([r["t"] for r in rows], rows):
                doc, start, n, anchor = _chosen(held, some, window, "ords")
                if not len(doc):
                    continue
                keys, hashes = (np.array([r[c] for r in some], dtype=np.int64) for c in ("k", "h"))
                stop = start + n + window - 1
                pieces += [held[d][s:e] for d, s, e in zip(doc.tolist(), start.tolist(), stop.tolist(), strict=True)]
                group = (anchor & np.uint64(0xFFFFFF)).astype(np.int64) % groups
                part = (anchor >> np.uint64(24)).astype(np.int64) % parts
                metas.append(np.stack([group, stop - start, start, keys[doc], hashes[doc], part]))
                size += int((stop - start).sum())
                if size > HELD_BYTES:
                    yield from flush()
                    pieces, metas, size = [], [], 0
        if metas:
            yield from flush()

    return texts.select(*names).mapInArrow(run, "part int, texts binary, meta binary")


def _span_blocks(found: Iterator[tuple[np.ndarray, ...]], parts: int) -> Iterator[pa.RecordBatch]:
    """Packs (k, h, start, end) arrays into one row for each part of the documents and flush."""
    schema = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("spans", pa.binary())])
    held, size = [], 0

    def flush():
        k, h, s, e = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((s, h, k))
        keys, spans = np.stack([k, h])[:, order], np.stack([s, e]).astype(np.int32)[:, order]
        return _rows([(p, _pack(keys[:, at]), _pack(spans[:, at])) for p, at in _split_by(_spread(keys[0]) % parts)], schema)

    for one in found:
        if len(one[0]):
            held.append(one)
            size += len(one[0])
        if size > 500_000:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _merged(blocks: DataFrame) -> DataFrame:
    """(k, h, spans): one row for each document that loses bytes, its (start, end) spans packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("k", pa.int64()), ("h", pa.int64()), ("spans", pa.binary())])
        for _, rows in _parts(batches):
            k, h = np.concatenate([_unpack(r["keys"], np.int64).reshape(2, -1) for r in rows], axis=1)
            spans = np.concatenate([_unpack(r["spans"], np.int32).reshape(2, -1) for r in rows], axis=1)
            order = np.lexsort((h, k))
            k, h, spans = k[order], h[order], np.ascontiguousarray(spans[:, order].T)
            cuts = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (h[1:] != h[:-1])))
            yield _rows([(int(k[lo]), int(h[lo]), spans[lo:hi].tobytes()) for lo, hi in zip(cuts, [*cuts[1:], len(k)], strict=True)], schema)

    return blocks.repartition("part").sortWithinPartitions("part").mapInArrow(run, "k long, h long, spans binary")


SPAN_BLOCK = "part int, keys binary, spans binary"


def _owned_spans(blocks: DataFrame, window: int, parts: int) -> DataFrame:
    """Packed spans: what each part's transform says is removed."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for _, rows in _parts(batches):
            pieces, metas = [], []
            for row in rows:
                joined = zstandard.ZstdDecompressor().decompress(row["texts"])
                metas.append(_unpack(row["meta"], np.int64).reshape(5, -1))
                stops = np.cumsum(metas[-1][0])
                pieces += [joined[a:b] for a, b in zip((stops - metas[-1][0]).tolist(), stops.tolist(), strict=True)]
            _, start, keys, hashes, part = np.concatenate(metas, axis=1)
            for _, at in _split_by(part):
                number: dict[bytes, int] = {}
                text = np.array([number.setdefault(pieces[x], len(number)) for x in at.tolist()])
                owners = np.full(len(number), NO_ID)
                np.minimum.at(owners, text, keys[at])
                least = least_owner_of_windows(list(number), owners, window)
                for lo in range(0, len(text), 100_000):
                    t, here = text[lo : lo + 100_000], at[lo : lo + 100_000]
                    s, k, h = start[here], keys[here], hashes[here]
                    gone = np.zeros((len(t), least.shape[1] + 2), dtype=np.int8)
                    gone[:, 1:-1] = least[t] < k[:, None]
                    edge = np.diff(gone, axis=1)
                    i, first = np.nonzero(edge == 1)
                    _, last = np.nonzero(edge == -1)
                    yield k[i], h[i], s[i] + first, s[i] + last - 1 + window

    return blocks.repartition("part").sortWithinPartitions("part").mapInArrow(lambda b: _span_blocks(found(b), parts), SPAN_BLOCK)


def _crowded_spans(texts: DataFrame, window: int, parts: int) -> DataFrame:
    """Packed spans for segments of crowded anchors, grouped by content in DataFrames: segments first, then the windows of the distinct ones."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for held, some in _steps([r["t"] for r in rows], rows):
                doc, start, n, _ = _chosen(held, some, window, "crowded")
                if len(doc):
                    segs = [held[d][s : s + m + window - 1] for d, s, m in zip(doc.tolist(), start.tolist(), n.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(segs, pa.binary()), pa.array([some[d]["k"] for d in doc], pa.int64()), pa.array([some[d]["h"] for d in doc], pa.int64()), pa.array(start, pa.int64())], ["seg", "k", "h", "start"])

    places = texts.select("k", "h", "t", "crowded").where(F.length("crowded") > 0).mapInArrow(flat, "seg binary, k long, h long, start long")
    distinct = places.groupBy("seg").agg(F.min("k").alias("least"))
    wins = distinct.select("seg", "least", F.explode(F.sequence(F.lit(0), F.length("seg") - window)).alias("i")).withColumn("w", F.expr(f"substring(seg, i + 1, {window})"))
    owners = wins.groupBy("w").agg(F.min("least").alias("owner"))
    # at most 27 windows a segment; a table of its own, so that Spark can split the places of one very common segment
    owned, _ = written(wins.join(owners, "w").groupBy("seg").agg(F.collect_list(F.struct("i", "owner")).alias("owners")), "owned-segments")
    gone = places.join(owned, "seg").select("k", "h", "start", F.explode("owners").alias("o")).where(F.col("o.owner") < F.col("k")).select("k", "h", (F.col("start") + F.col("o.i")).alias("s"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _span_blocks(((lambda k, h, s: (k, h, s, s + window))(*(c.to_numpy() for c in b.columns)) for b in batches), parts)

    return gone.select("k", "h", "s").mapInArrow(pack, SPAN_BLOCK)


def cut(text: bytes, spans: np.ndarray) -> tuple[bytes, int, int]:
    """(kept bytes, removed, runs) of a text less the union of (start, end) spans; spans that touch are one run."""
    if not len(spans):
        return text, 0, 0
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    upto = np.maximum.accumulate(spans[:, 1])
    head = np.append(True, spans[1:, 0] > upto[:-1])
    starts, stops = spans[head, 0].tolist(), upto[np.append(np.flatnonzero(head)[1:] - 1, len(spans) - 1)].tolist()
    kept, at = [], 0
    for s, e in zip(starts, stops, strict=True):
        kept.append(text[at:s])
        at = e
    kept.append(text[at:])
    return b"".join(kept), sum(stops) - sum(starts), len(starts)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, crowd: int = 20_000, part_bytes: int = 1_000_000, keep_text: bool = False) -> DataFrame:
    """(d, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]), one row for each input row."""
    if window % 2 or not ANCHOR + 8 <= window <= 128:
        raise ValueError(f"the window must be an even number from {ANCHOR + 8} to 128")
    spark = docs.sparkSession
    src = _source(docs, id_col, text_col)
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = _candidates(src, window, max(512, 8 * shuffled), crowd, max(64, 4 * shuffled))
    total = found.agg(F.sum(F.length("ords")).alias("n")).first().n or 0
    size = total // 4 * 64
    groups = int(min(1 << 20, max(4 * shuffled, size // max(part_bytes, HELD_BYTES))))
    parts = int(min(1 << 20, 1 + size // groups // min(part_bytes, BUILT_BYTES)))
    doc_parts = max(64, 2 * shuffled)
    held, _ = written(src.join(found, "k").select("k", "d", "h", "t", "ords", "crowded"), "anchored")
    found_spans = _owned_spans(_segment_blocks(held, window, groups, parts), window, doc_parts).unionByName(_crowded_spans(held, window, doc_parts))
    spans, _ = written(_merged(found_spans), "spans")
    with_spans = held.select("k", "d", "h", "t").join(spans, ["k", "h"])
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_text]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
        for batch in batches:
            out = []
            for text, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                kept, removed, runs = cut(text, np.frombuffer(packed, dtype=np.int32).reshape(-1, 2).astype(np.int64))
                out.append((len(text), removed, runs, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(cols[c], kinds[c]) for c in range(len(names)))], ["d", *names])

    kind = src.schema["d"].dataType.simpleString()
    cut_rows = with_spans.select("d", "t", "spans").mapInArrow(finish, f"d {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)
    bare = src.select("k", "d", "h", F.length("t").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("t", 256).alias("kept_sha256"), *[F.col("t").alias("kept")] * keep_text)
    whole = bare.alias("a").join(spans.select("k", "h").alias("b"), same("a", "b", "k", "h"), "left_anti").select("d", *names)
    return whole.unionByName(cut_rows)
