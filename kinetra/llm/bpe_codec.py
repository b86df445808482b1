"""BPE encoding and decoding by per-prefix dynamic programming, exact to the merge rules.

For each prefix of a piece of text there is one token that a valid encoding of the prefix can end with. An automaton over
the vocabulary lists, for each end position, the tokens that are suffixes of the prefix; the one whose left neighbour -
the stored last token of the prefix before it - is compatible is stored. Two neighbouring tokens are compatible if no
merge would have crossed their border before both were complete. Back-pointers then give the ids. A token that its own
bytes do not merge to can end no valid encoding and is left out of the automaton; a file in which a merge comes before one
that makes its parts, or whose added tokens strip spaces or need word borders, is refused.

Defined results: null text counts as empty and has no ids; the strings of added tokens in a text become their ids; texts
of any length are encoded whole; rows that repeat give equal results; an empty table gives no rows; only the id and text
columns are read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.llm.common import held_once

#: Fixed value: the published splitting pattern of byte-level BPE.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces and pairs that are kept between texts; a full store is emptied, so memory is bounded.
MAX_PIECES = 350_000
MAX_PAIRS = 400_000
#: Longer pieces are not stored.
MAX_PIECE_BYTES = 64
#: Above every merge rank.
NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable in Latin-1, else the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], free = chr(free), free + 1
    return out


class BpeCodec:
    """Encodes and decodes with the vocabulary and merges of a byte-level BPE file of the tokenizers library."""

    def __init__(self, spec: str, max_pieces: int = MAX_PIECES, max_pairs: int = MAX_PAIRS):
        self.max_pieces, self.max_pairs = max_pieces, max_pairs
        data = json.loads(spec)
        model = data["model"]
        if model["type"] != "BPE" or data.get("normalizer") or data["pre_tokenizer"]["type"] != "ByteLevel" or data["pre_tokenizer"].get("add_prefix_space") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE is supported")
        if any(t.get(k) for t in data.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that strip spaces or need word borders are not supported")
        self.added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        ids = model["vocab"]
        top = max([*ids.values(), *self.added.values()]) + 1
        to_byte = {c: b for b, c in enumerate(byte_letters())}
        self.bytes_of: list[bytes] = [b""] * top
        for s, i in ids.items():
            self.bytes_of[i] = bytes(to_byte[c] for c in s)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank: dict[int, int] = {ids[a] << 32 | ids[b]: r for r, (a, b) in enumerate(merges)}
        #: By token: its parts, and the rank of the merge that makes it; -1 and -1 for a byte.
        self.left, self.right, self.made = [-1] * top, [-1] * top, [-1] * top
        if any(self.rank[ids[a] << 32 | ids[b]] != r for r, (a, b) in enumerate(merges)):
            raise ValueError("a merge occurs twice")
        for r, (a, b) in enumerate(merges):
            x, y, token = ids[a], ids[b], ids[a + b]
            if any(self.made[t] < 0 and len(self.bytes_of[t]) > 1 for t in (x, y)):
                if any(a_ + b_ in (a, b) for a_, b_ in merges[r:]):
                    raise ValueError("a merge comes before one that makes its parts")
                continue  # a part cannot come about, so neither can this
            if self.made[token] < 0 and not self._crossed(x, y, r):
                self.left[token], self.right[token], self.made[token] = x, y, r
        self.size = [len(b) for b in self.bytes_of]
        for s, i in self.added.items():
            self.bytes_of[i] = s.encode()
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.whole: dict[bytes, int] = {}
        for i in ids.values():
            if (self.size[i] == 1 or self.made[i] >= 0) and i not in self.added.values():
                self.automaton.add_word(self.bytes_of[i].decode("latin-1"), i)
                self.whole[self.bytes_of[i]] = i
        self.automaton.make_automaton()
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}

    def _crossed(self, a: int, b: int, before: int) -> bool:
        """Whether a merge of a rank less than `before` joins a right-hand part of a and a left-hand part of b while both are still there. Of equal ranks the left one goes first."""
        rank, made = self.rank, self.made
        edge, edge_used = [], NEVER
        y = b
        while y >= 0:
            edge.append((y, edge_used))
            edge_used, y = made[y], self.left[y]
        x, x_used = a, NEVER
        while x >= 0:
            for y, y_used in edge:
                r = rank.get(x << 32 | y)
                if r is not None and r < x_used and r <= y_used and r < before:
                    return True
            x_used, x = made[x], self.right[x]
        return False

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b stay apart."""
        known = not self._crossed(a, b, NEVER)
        if len(self.pairs) >= self.max_pairs:
            self.pairs.clear()
        self.pairs[a << 32 | b] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece: last token of every prefix, then the back-pointers. A token that is the whole piece needs no other prefix."""
        one = self.whole.get(piece)
        if one is not None:
            return [one]
        last: list[int] = [-1] * (len(piece) + 1)
        pairs, size = self.pairs, self.size
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            length = size[token]
            if end > length:
                left = last[end - length]
                if left < 0:
                    continue
                fits = pairs.get(left << 32 | token)
                if not (self.compatible(left, token) if fits is None else fits):
                    continue
            last[end] = token
        out, at = [], len(piece)
        while at:
            token = last[at]
            if token < 0:
                raise ValueError("a byte of the text is not in the vocabulary")
            out.append(token)
            at -= self.size[token]
        out.reverse()
        return out

    def _packed(self, piece: str) -> bytes:
        raw = piece.encode()
        ids = np.array(self.encode_piece(raw), dtype="<u4").tobytes()
        if len(raw) <= MAX_PIECE_BYTES:
            if len(self.pieces) >= self.max_pieces:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out, known = [], self.pieces
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.added:
                out.append(np.array([self.added[part]], dtype="<u4").tobytes())
            elif part:
                for piece in self.split.findall(part):
                    ids = known.get(piece)
                    out.append(self._packed(piece) if ids is None else ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", errors="replace")


def read_spec(path: str) -> str:
    """The tokenizer file, read once on the driver and sent to the executors: its size is fixed by the vocabulary."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, keep_decoded: bool = True, max_pieces: int = MAX_PIECES, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """(d, n_tokens, ids array<int>, ids_sha256, decoded, decoded_sha256); ids and the decoded text only where they are to be kept. A worker stores max_pieces and max_pairs at most between texts."""
    src = docs.select(F.col(id_col).alias("d"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    sent = docs.sparkSession.sparkContext.broadcast(spec)
    names = ["d", "n_tokens", *["ids"] * keep_ids, "ids_sha256", *["decoded"] * keep_decoded, "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = held_once(sent.value, lambda spec: BpeCodec(spec, max_pieces, max_pairs))
        for batch in batches:
            cols: dict[str, list] = {n: [] for n in names[1:]}
            start, size = 0, 0
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py()
                ids = bpe.encode(text)
                decoded = bpe.decode(ids)
                cols["n_tokens"].append(len(ids) // 4)
                cols["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                cols["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if keep_ids:
                    cols["ids"].append(ids)
                if keep_decoded:
                    cols["decoded"].append(decoded)
                size += len(text)
                if size > 2_000_000 or k == batch.num_rows - 1:
                    arrays = {n: _id_lists(v) if n == "ids" else pa.array(v, pa.int64() if n == "n_tokens" else pa.string()) for n, v in cols.items()}
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, k + 1 - start), *arrays.values()], names)
                    cols, start, size = {n: [] for n in names[1:]}, k + 1, 0

    schema = {"n_tokens": "long", "ids": "array<int>"}
    return src.mapInArrow(run, ", ".join(f"{n} {src.schema['d'].dataType.simpleString() if n == 'd' else schema.get(n, 'string')}" for n in names))


def _id_lists(packed: list[bytes]) -> pa.Array:
    """Lists of 32-bit integers from packed ids, without an object for each id."""
    ends = np.cumsum([0, *(len(x) // 4 for x in packed)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))
