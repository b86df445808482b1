"""Column-wise construction of a collection's Burrows-Wheeler transform and common prefixes.

Each round puts one more symbol of every string, from its right end, in front of that string's newest suffix. The
transform and the prefix lengths are columns that are read and rewritten in order, once a round; where a new suffix
goes follows from counting symbols before its parent's row, and its common prefix with a neighbour is one more than the
least prefix length between the two parents' rows.
"""

from __future__ import annotations

import numpy as np

#: Marks a string whose symbols are all in; names of blocks are below it.
END = 65_535
#: Bytes of a block that is one symbol. A block of one byte always has names enough.
BLOCKS = (10, 8, 5, 4, 2, 1)


def _minimum_table(values: np.ndarray, longest: int) -> np.ndarray:
    """Row k holds the least of each 2^k neighbouring values, as far as ranges of `longest` need it."""
    depth = max(1, int(longest).bit_length())
    table = np.empty((depth, len(values)), dtype=np.uint8)
    table[0] = values
    for k in range(1, depth):
        step = 1 << (k - 1)
        np.minimum(table[k - 1, :-step], table[k - 1, step:], out=table[k, :-step])
        table[k, -step:] = table[k - 1, -step:]
    return table


def _range_minimum(table: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least value in each half-open range lo..hi (hi > lo)."""
    k = np.frexp((hi - lo).astype(np.float32))[1] - 1
    return np.minimum(table[k, lo], table[k, hi - (1 << k)])


def collection_bwt(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(transform, prefixes) of a collection. symbols: 16-bit numbers below END; row i holds string i from its last symbol to its first, then END; up to 250 columns.

    Rows 0..k-1 of the result belong to the k empty suffixes in the order of the strings. prefixes[r] is the number of
    symbols that the suffixes of rows r-1 and r share.
    """
    k, width = symbols.shape
    bwt = symbols[:, 0].copy()
    lcp = np.zeros(k, dtype=np.uint8)
    fresh, owner = np.arange(k), np.arange(k)
    for j in range(1, width):
        going = bwt[fresh] != END
        fresh, owner = fresh[going], owner[going]
        if not len(fresh):
            break
        order = np.argsort(bwt, kind="stable")
        order = order[: len(bwt) - np.count_nonzero(bwt == END)]
        isnew = np.zeros(len(bwt), dtype=bool)
        isnew[fresh] = True
        new_at = np.flatnonzero(isnew[order])
        parent = order[new_at]
        whose = np.empty(len(bwt), dtype=np.int32)
        whose[fresh] = owner
        whose = whose[parent]
        before = np.maximum(new_at - 1, 0)
        has_before = (new_at > 0) & (bwt[order[before]] == bwt[parent])
        after = np.minimum(new_at + 1, len(order) - 1)
        has_after = (new_at + 1 < len(order)) & (bwt[order[after]] == bwt[parent])
        from_before, to_after = order[before[has_before]] + 1, order[after[has_after]] + 1
        upto, since = parent[has_before] + 1, parent[has_after] + 1
        lo, hi = np.concatenate([from_before, since]), np.concatenate([upto, to_after])
        least = 1 + _range_minimum(_minimum_table(lcp, (hi - lo).max(initial=1)), lo, hi)
        size = k + len(order)
        old = np.ones(size, dtype=bool)
        old[k + new_at] = False
        new_bwt, new_lcp = np.empty(size, dtype=np.uint16), np.empty(size, dtype=np.uint8)
        new_bwt[old], new_lcp[old] = bwt, lcp
        new_bwt[k + new_at] = symbols[whose, j]
        head = np.zeros(len(new_at), dtype=np.uint8)
        head[has_before] = least[: len(upto)]
        new_lcp[k + new_at] = head
        new_lcp[k + new_at[has_after] + 1] = least[len(upto) :]
        bwt, lcp, fresh, owner = new_bwt, new_lcp, k + new_at, whose
    return bwt, lcp


def suffix_rows(bwt: np.ndarray, k: int, lengths: np.ndarray) -> np.ndarray:
    """Row of each suffix: entry [i, j] is the row of string i's suffix of length j, -1 beyond its length."""
    order = np.argsort(bwt, kind="stable")
    order = order[: len(bwt) - np.count_nonzero(bwt == END)]
    step = np.full(len(bwt), -1, dtype=np.int64)
    step[order] = k + np.arange(len(order))
    out = np.full((k, int(lengths.max(initial=0)) + 1), -1, dtype=np.int64)
    at = np.arange(k)
    out[:, 0] = at
    for j in range(1, out.shape[1]):
        live = np.flatnonzero(lengths >= j)
        at[live] = step[at[live]]
        out[live, j] = at[live]
    return out


def block_names(texts: bytes, width: int) -> tuple[np.ndarray, int]:
    """(names, how many): the rank, in byte order, of the `width` bytes from each position among all that occur; zeros follow the end. A width over 8 is even and is named by the names of its halves."""
    if width > 8:
        half, n = block_names(texts + bytes(width // 2), width // 2)
        value = half[: len(texts)].astype(np.uint64) * np.uint64(n) + half[width // 2 :].astype(np.uint64)
    else:
        padded = np.frombuffer(texts + bytes(8), dtype=np.uint8)
        value = np.ndarray((len(texts),), dtype=">u8", buffer=padded, strides=(1,)).astype(np.uint64) >> np.uint64(64 - 8 * width)
    found, names = np.unique(value, return_inverse=True)
    return names, len(found)


def block_symbols(texts: list[bytes], window: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(width, symbols, lengths): row shift * k + i holds text i less its last `shift` bytes, as named blocks of `width` bytes counted from its end; first bytes that fill no block are left out.

    The width is the largest of BLOCKS that divides the window and needs no more names than symbols hold.
    """
    sizes = np.array([len(t) for t in texts])
    joined = b"".join(texts)
    for width in (w for w in BLOCKS if window % w == 0):
        names, n = block_names(joined, width)
        if n <= END:
            break
    shift = np.arange(width)[:, None]
    lengths = np.maximum(sizes - shift, 0) // width
    column = np.arange(int(lengths.max()) + 1)
    at = (np.cumsum(sizes) - shift)[:, :, None] - width * (column + 1)
    symbols = np.where(column < lengths[:, :, None], names.astype(np.uint16)[at], np.uint16(END))
    return width, symbols.reshape(-1, len(column)), lengths.ravel()


def least_owner_of_windows(texts: list[bytes], owners: np.ndarray, window: int) -> np.ndarray:
    """Entry [i, s] is the least owner of any text that contains the `window` bytes at s of text i; the largest int64 where there is no such window.

    Symbols are blocks of bytes, so each text goes in once for each byte of a block, less its last 0, 1, ... bytes: every byte
    starts a suffix of one of them, and the rounds are as many times fewer.
    """
    none = np.iinfo(np.int64).max
    if not texts:
        return np.full((0, 0), none)
    sizes = np.array([len(t) for t in texts])
    k = len(texts)
    width, symbols, lengths = block_symbols(texts, window)
    bwt, lcp = collection_bwt(symbols)
    rows = suffix_rows(bwt, width * k, lengths)
    need = window // width
    i, j = np.nonzero(rows[:, need:] >= 0)
    j += need
    at = rows[i, j]
    text = i % k
    start = sizes[text] - i // k - width * j
    owner = np.full(len(bwt), none)
    owner[at] = owners[text]
    starts = np.flatnonzero(lcp < need)  # row 0 always starts a group
    group = np.cumsum(lcp < need) - 1
    least = np.minimum.reduceat(owner, starts)
    out = np.full((k, max(1, int(sizes.max()) - window + 1)), none)
    out[text, start] = least[group[at]]
    return out
