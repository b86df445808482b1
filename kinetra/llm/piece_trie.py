"""A trie of vocabulary pieces as flat arrays, walked for many words at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

#: Cells of one table of words, letters by words; longer words come in smaller tables.
MAX_CELLS = 120_000


@dataclass
class PieceTrie:
    """Edges (node, letter code) -> node in a hash table of fixed places; value: the piece that ends in a node, or -1. Letters of no piece have the code 0."""

    code: np.ndarray
    keys: np.ndarray
    kids: np.ndarray
    value: np.ndarray
    longest: int

    @classmethod
    def build(cls, pieces: Sequence[str]) -> PieceTrie:
        letters = sorted({c for p in pieces for c in p})
        code_of = {c: k + 1 for k, c in enumerate(letters)}
        edges: dict[int, int] = {}
        ends = [-1]
        for number, piece in enumerate(pieces):
            at = 0
            for c in piece:
                key = at << 21 | code_of[c]
                if key not in edges:
                    edges[key] = len(ends)
                    ends.append(-1)
                at = edges[key]
            if piece:
                ends[at] = number
        bits = max(4, (4 * len(edges)).bit_length())
        keys, kids = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        trie = cls(np.zeros(0x110000, np.uint16 if len(letters) < 1 << 16 else np.int32), keys, kids, np.array(ends, np.int32), max(map(len, pieces), default=0))
        for key, place in zip(edges, trie._places(np.array(list(edges), np.int64)).tolist()):
            while keys[place] >= 0:
                place = (place + 1) & len(keys) - 1
            keys[place], kids[place] = key, edges[key]
        trie.code[[ord(c) for c in letters]] = range(1, len(letters) + 1)
        return trie

    def _places(self, wanted: np.ndarray) -> np.ndarray:
        return (wanted.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)

    def child(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The node below each state by its letter, or -1."""
        wanted = state.astype(np.int64) << 21 | code
        place = self._places(wanted)
        held = self.keys[place]
        out = np.where(held == wanted, self.kids[place], np.int32(-1))
        open_ = np.flatnonzero((held != wanted) & (held >= 0))
        while len(open_):
            place[open_] = (place[open_] + 1) & len(self.keys) - 1
            held = self.keys[place[open_]]
            hit = held == wanted[open_]
            out[open_[hit]] = self.kids[place[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out

    def tables(self, words: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, lengths, codes): words in tables by falling length, codes by letter and word; every word is in one table."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lengths, kind="stable")
        at = 0
        while at < len(order):
            tall = max(int(lengths[order[at]]), 1)
            rows = order[at : at + max(1, MAX_CELLS // tall)]
            n = lengths[rows]
            flat = self.code[np.frombuffer("".join([words[r] for r in rows]).encode("utf-32-le", "surrogatepass"), np.uint32)]
            codes = np.zeros((tall, len(rows)), flat.dtype)
            column = np.repeat(np.arange(len(rows)), n)
            codes[np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n), column] = flat
            yield rows, n, codes
            at += len(rows)

    def steps(self, lengths: np.ndarray, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(end, words, word, start, piece) for each end position: how many words reach it, and the pieces that end there. A letter that is no piece itself gives the piece -1."""
        word, start, state = (np.zeros(0, np.int32) for _ in range(3))
        for at in range(len(codes)):
            n = int(np.searchsorted(-lengths, -at, side="left"))  # words longer than `at`, as lengths fall
            if n < len(codes[at]):
                alive = word < n
                word, start, state = word[alive], start[alive], state[alive]
            word = np.concatenate([word, np.arange(n, dtype=np.int32)])
            start = np.concatenate([start, np.full(n, at, np.int32)])
            state = np.concatenate([state, np.zeros(n, np.int32)])
            code = codes[at][word]
            after = self.child(state, code)
            fits = after >= 0
            word, start, state = word[fits], start[fits], after[fits]
            piece = self.value[state]
            ends = piece >= 0
            alone = np.ones(n, bool)
            alone[word[ends & (start == at)]] = False
            lone = np.flatnonzero(alone).astype(np.int32)
            yield at + 1, n, np.concatenate([word[ends], lone]), np.concatenate([start[ends], np.full(len(lone), at, np.int32)]), np.concatenate([piece[ends], np.full(len(lone), -1, np.int32)])
