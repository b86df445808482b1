"""Quality rules with suffix-array repetition.

The documents of a batch share one suffix array over word numbers, built by prefix doubling with the document as the
most significant part of the key, so no repeat crosses documents and groups that are settled are not sorted again. The
ranks of each doubling give the longest common prefix of neighbouring suffixes. Every suffix whose prefix with a
neighbour has `min_repeat` words or more starts a maximal repeat of that length; the union of these spans is what is
repeated. A document is kept if neither the repeated share of its words nor its longest repeat is over a limit.

Defined results: null text has no words; an empty text has no words and fails the length rule; only the id and text
columns are read; an empty table gives no rows; repeated rows give equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = b"#*$%&|<>"
WORD_SPACES = b" \t\n\x0b\x0c\r"
#: Words of documents that share a suffix array; one longer document has an array of its own.
BATCH_WORDS = 200_000


def suffix_array(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of the concatenated documents and the ranks after each doubling (k = 1, 2, 4, ...).

    codes: document and word of each position as one number, grouped by document; ends: for each position the end of its document.
    """
    n = len(codes)
    sa = np.argsort(codes, kind="stable")
    sorted_codes = codes[sa]
    head = np.concatenate([[True], sorted_codes[1:] != sorted_codes[:-1]])
    slots = np.arange(n)
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, slots, 0))
    ranks, k = [rank.copy()], 1
    while True:
        alone = head & np.concatenate([head[1:], [True]])
        open_slots = slots[~alone]
        if not len(open_slots):
            return sa, ranks
        at = sa[open_slots]
        nxt = at + k
        inside = nxt < ends[at]
        second = np.where(inside, rank[np.minimum(nxt, n - 1)] + 1, 0)
        key = rank[at] * np.int64(n + 2) + second
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        sa[open_slots] = at
        head[open_slots] = np.concatenate([[True], key[1:] != key[:-1]])
        new = np.maximum.accumulate(np.where(head, slots, 0))
        rank[at] = new[open_slots]
        ranks.append(rank.copy())
        k *= 2


def repeat_lengths(codes: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """For each position, the length of the longest repeat that starts there, 0 if it is under `least`."""
    n = len(codes)
    out = np.zeros(n, dtype=np.int64)
    if n < 2:
        return out
    sa, ranks = suffix_array(codes, ends)
    a, b = sa[:-1], sa[1:]
    floor = least.bit_length() - 1
    for level in range(min(floor, len(ranks) - 1) + 1):  # a quick pass: pairs that share fewer words drop out
        same = ranks[level][a] == ranks[level][b]
        a, b = a[same], b[same]
    lcp = np.zeros(len(a), dtype=np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        x, y = np.minimum(a + lcp, n - 1), np.minimum(b + lcp, n - 1)
        same = (a + lcp < ends[a]) & (b + lcp < ends[b]) & (ranks[level][x] == ranks[level][y]) & (x != y)
        lcp += same << level
    lcp[lcp < least] = 0
    np.maximum.at(out, a, lcp)
    np.maximum.at(out, b, lcp)
    return out


def measure(texts: list[bytes], min_repeat: int = 8) -> list[tuple[int, int, int, int, int, int]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, longest_repeat) of each UTF-8 text."""
    numbers: dict[bytes, int] = {}
    out, codes, sizes = [], [], []
    for doc, text in enumerate(texts):
        words = text.split()
        chars = len(text.decode()) - sum(text.count(c) for c in WORD_SPACES)
        seen: set[bytes] = set()
        dup = 0
        for line in text.split(b"\n"):
            if line.split(None, 1):
                if line in seen:
                    dup += 1
                seen.add(line)
        out.append((len(words), chars, sum(text.count(c) for c in SYMBOLS), dup))
        sizes.append(len(words))
        codes.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words)))
    total = sum(sizes)
    if not total:
        return [(*x, 0, 0) for x in out]
    sizes_a = np.array(sizes)
    doc_of = np.repeat(np.arange(len(texts)), sizes_a)
    stops = np.cumsum(sizes_a)
    longest = repeat_lengths(np.concatenate(codes) + doc_of * np.int64(len(numbers) + 1), stops[doc_of], min_repeat)
    edge = np.zeros(total + 1, dtype=np.int64)
    at = np.flatnonzero(longest)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + longest[at], -1)
    covered = np.cumsum(edge)[:-1] > 0
    repeated = np.bincount(doc_of, weights=covered, minlength=len(texts)).astype(np.int64)
    most = np.zeros(len(texts), dtype=np.int64)
    np.maximum.at(most, doc_of, longest)
    return [(*x, int(r), int(m)) for x, r, m in zip(out, repeated, most, strict=True)]


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20, min_repeat: int = 8, max_repeat_percent: int = 30, max_longest: int = 200) -> DataFrame:
    """(d, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, longest_repeat, base_failed, kept)."""
    src = docs.select(F.col(id_col).alias("d"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, size = 0, [], 0
            for k in range(batch.num_rows + 1):
                text = batch.column(1)[k].as_py() if k < batch.num_rows else None
                n = 0 if text is None else len(text) // 5 + 1
                if held and (text is None or size + n > BATCH_WORDS):
                    rows = np.array(measure(held, min_repeat), dtype=np.int64).reshape(-1, 6)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(held)), *(pa.array(rows[:, c]) for c in range(6))], ["d", *names])
                    start, held, size = k, [], 0
                if text is not None:
                    held.append(text)
                    size += n

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat"]
    measured = src.mapInArrow(run, f"d {src.schema['d'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in names))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("longest_repeat") <= max_longest))
