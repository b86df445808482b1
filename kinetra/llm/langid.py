"""Language ID by segmentation-marginalised unigrams.

A fixed public vocabulary gives the pieces; each language has its own probabilities for them. A word's likelihood in a
language is the sum over all of its segmentations into pieces, by the forward algorithm; a text's score adds the logs
of its words, and the best language wins with its share of the posterior. Words are runs of letters (`\\p{L}`, each with
the marks `\\p{M}` after it) of any length, never cut. All languages and many words advance one letter at a time as arrays.

Beside the languages stands a background of single letters, as frequent as in the whole training sample. It is no answer,
but takes its share of the posterior, so a text that looks like no learned language has a low score. In every language a
word may be a stray one, spelt by the background, so a few keys or names in a text decide nothing.

Training counts the words of labelled texts by language in Spark, then re-estimates the probabilities from expected piece
counts (forward and backward over each distinct word). At most about `max_train_docs` texts of each language, chosen by
their hash, are used whole: the documented bound of the labelled sample. Words of over 32 letters train in parts of 32.
Only piece totals - vocabulary size times the number of languages - and letter totals come to the driver.

Defined results: null text or text without letters is `und` with score 0; ties go to the language that sorts first; rows
without a language do not train; no training rows at all make every text `und`; rows that repeat give equal results; an
empty table gives no rows; texts and words of any length are scored whole; only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from kinetra.llm.common import held_once, remove_table, written
from kinetra.llm.piece_trie import PieceTrie

ASCII_WORDS = re.compile(r"[a-z]+")
WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
MARK = "▁"
UNDECIDED = "und"
#: Letters of a part of a long word in training; words that a worker keeps scores of; texts that are scored together.
TRAIN_LETTERS = 32
MAX_WORDS_KEPT = 150_000
MAX_LETTERS_AT_ONCE = 500_000
#: Distinct words that train together, however many Spark sends at a time.
TRAIN_WORDS_AT_ONCE = 10_000
MAX_LANGUAGES = 1_000
#: Pseudo-count of each piece, and probability of a letter that no piece covers.
SMOOTH = 0.1
UNKNOWN = 1e-7
#: Probability, in every language, of a word that is none of its own (a key, a name) and is made of background letters.
STRAY = 1e-3
#: After so many letters sums are brought back to the size of 1, so a word of any length is scored.
RESCALE = 16


def vocabulary(path: str) -> list[str]:
    """Pieces of a sentencepiece file, without control and byte pieces, in the order of their ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(k) for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_byte(k) or sp.is_unknown(k) or sp.is_unused(k))]


def text_words(text: str) -> list[str]:
    """Runs of letters and their marks, lower-cased."""
    low = text.lower()
    return ASCII_WORDS.findall(low) if low.isascii() else WORDS.findall(low)


def likelihoods(trie: PieceTrie, p: np.ndarray, words: list[str]) -> np.ndarray:
    """(words, languages): log of the sum over all segmentations of each word, the word-start mark before it. p: (pieces + 1, languages), last the unknown letter."""
    n = p.shape[1]
    out = np.zeros((len(words), n))
    ring = max(trie.longest, 1) + 1
    for rows, lengths, codes in trie.tables([MARK + w for w in words]):
        wide = len(rows)
        alpha, scale = np.zeros((ring, wide, n)), np.zeros((wide, n))
        alpha[0] = 1.0
        for end, reach, word, start, piece in trie.steps(lengths, codes):
            steps = alpha[start % ring, word] * p[piece]
            now = alpha[end % ring]
            for k in range(n):
                now[:, k] = np.bincount(word, weights=steps[:, k], minlength=wide)
            if end % RESCALE == 0:
                top = now[:reach].copy()
                alpha[:, :reach] /= top
                scale[:reach] += np.log(top)
            over = int(np.searchsorted(-lengths, -end, side="left"))  # words longer than `end`
            out[rows[over:reach]] = np.log(now[over:reach]) + scale[over:reach]
    return out


def expected_counts(trie: PieceTrie, p: np.ndarray, words: list[str], weights: np.ndarray) -> np.ndarray:
    """Expected number of each piece in weighted words of one language, by forward and backward sums; words of a bounded length."""
    out = np.zeros(len(p))
    for rows, lengths, codes in trie.tables(words):
        wide, tall = codes.shape[1], len(codes)
        alpha, beta = np.zeros((tall + 1, wide)), np.zeros((tall + 1, wide))
        alpha[0] = 1.0
        beta[lengths, np.arange(wide)] = 1.0
        seen = []
        for end, _, word, start, piece in trie.steps(lengths, codes):
            q = p[piece]
            alpha[end] = np.bincount(word, weights=alpha[start, word] * q, minlength=wide)
            seen.append((end, word, start, piece, q))
        share = weights[rows] / alpha[lengths, np.arange(wide)]
        for end, word, start, piece, q in reversed(seen):
            part = q * beta[end, word]
            np.add.at(beta, (start, word), part)
            np.add.at(out, piece, part * alpha[start, word] * share[word])
    return out[:-1]


@dataclass
class Model:
    languages: list[str]
    trie: PieceTrie
    #: (pieces + 1, languages): probabilities.
    p: np.ndarray
    #: Log probability of each letter code in the background; code 0 is any other letter.
    letters: np.ndarray
    known: dict[str, int] = field(default_factory=dict, repr=False)
    table: np.ndarray | None = field(default=None, repr=False)

    def rows_of(self, words: list[str]) -> np.ndarray:
        """Rows of `table` for words; scores of new words are added, and all are dropped when there are too many."""
        width = len(self.languages) + 1
        if self.table is None:
            self.table = np.zeros((MAX_WORDS_KEPT, width))
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if len(known) + len(new) > MAX_WORDS_KEPT:
            known.clear()
            new = list(dict.fromkeys(words))
            if len(new) > len(self.table):
                self.table = np.zeros((len(new), width))
        if new:
            at = len(known)
            flat = self.trie.code[np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), np.uint32)]
            ends = np.cumsum([0, *map(len, new)])
            plain = np.add.reduceat(self.letters[flat], ends[:-1])
            self.table[at : at + len(new), :-1] = np.logaddexp(likelihoods(self.trie, self.p, new) + np.log1p(-STRAY), plain[:, None] + np.log(STRAY))
            self.table[at : at + len(new), -1] = plain
            known.update(zip(new, range(at, at + len(new))))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        found = [text_words(t) if t else [] for t in texts] if self.languages else [[]] * len(texts)
        total = np.zeros((len(texts), len(self.languages) + 1))
        at = 0
        while at < len(found):  # a bounded number of letters at once, or one text
            end, size = at, 0
            while end < len(found) and (end == at or size < MAX_LETTERS_AT_ONCE):
                size += len(texts[end] or "")
                end += 1
            sizes = np.array([len(f) for f in found[at:end]])
            full = np.flatnonzero(sizes)
            if len(full):
                rows = self.rows_of([w for f in found[at:end] for w in f])
                total[at + full] = np.add.reduceat(self.table[rows], (np.cumsum(sizes) - sizes)[full])
            at = end
        none = np.array([not f for f in found], dtype=bool)
        if not self.languages:
            return [UNDECIDED] * len(texts), np.zeros(len(texts))
        best = np.argmax(total[:, :-1], axis=1)
        top = total[np.arange(len(total)), best]
        score = 1 / np.exp(np.minimum(total - top[:, None], 700)).sum(axis=1) if len(total) else np.zeros(0)
        return [UNDECIDED if x else self.languages[k] for x, k in zip(none, best.tolist())], np.where(none, 0.0, score)


def _model(value: tuple) -> Model:
    return Model(*value)


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves no remainder; a null id counts as the text `null`."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("null")).cast("binary")), F.lit(folds)) == 0


def _joined(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The same rows in tables of at least `rows`, but for the last."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def train(labelled: DataFrame, pieces: list[str], lang_col: str = "lang", text_col: str = "text", max_train_docs: int = 5_000, rounds: int = 2) -> Model:
    """Fits the piece probabilities of each language; rows without text or language are ignored."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("t")).where("lang IS NOT NULL AND t IS NOT NULL")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    languages, vocab = sorted(sizes), tuple(pieces)
    n, v = len(languages), len(vocab)
    if not n:
        return Model([], PieceTrie.build([]), np.zeros((1, 0)), np.zeros(1))
    spark = labelled.sparkSession
    share = spark.createDataFrame([(lang, min(1_000_000, -(-max_train_docs * 1_000_000 // k))) for lang, k in sizes.items()], "lang string, share long")
    sample = rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("t"), F.lit(1_000_000)) < F.col("share")).select("lang", "t")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            parts: Counter = Counter()
            for name, found in counts.items():
                for w, k in found.items():
                    w = MARK + w
                    for at in range(0, len(w), TRAIN_LETTERS):
                        parts[name, w[at : at + TRAIN_LETTERS]] += k
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in parts]), pa.array([k[1] for k in parts]), pa.array(list(parts.values()), pa.int64())], ["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                counts.setdefault(lang.as_py(), Counter()).update(text_words(text.as_py()))
                if sum(map(len, counts.values())) > MAX_WORDS_KEPT:
                    yield out()
        if any(counts.values()):
            yield out()

    words, path = written(sample.mapInArrow(count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    letters = words.select(F.explode(F.split(F.translate("word", MARK, ""), "")).alias("c"), "n").where("c <> ''").groupBy("c").agg(F.sum("n").alias("n"))
    seen = {r.c: r.n for r in letters.toLocalIterator()}  # bounded by the letters of Unicode
    trie = PieceTrie.build(vocab)
    frequency = np.full(int(trie.code.max()) + 1, SMOOTH)
    for c, k in seen.items():
        frequency[trie.code[ord(c)]] += k
    background = np.log(frequency / frequency.sum())
    lengths = np.array([len(x) for x in vocab])
    p = np.repeat(np.append(0.02**lengths * 4.0 ** (lengths - 1), UNKNOWN)[:, None], n, axis=1)  # first, pieces weigh by length alone
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((languages, trie, p))

        def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            langs, trie_, table = sent.value
            totals = np.zeros((len(langs), len(table) - 1))
            for batch in _joined(batches, TRAIN_WORDS_AT_ONCE):
                lang, word, count = np.array(batch.column(0).to_pylist()), batch.column(1).to_pylist(), batch.column(2).to_numpy().astype(float)
                for k in np.flatnonzero(np.isin(langs, lang)).tolist():
                    own = np.flatnonzero(lang == langs[k])
                    totals[k] += expected_counts(trie_, table[:, k], [word[i] for i in own], count[own])
            for k in np.flatnonzero(totals.any(axis=1)).tolist():
                piece = np.flatnonzero(totals[k])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(piece), k, np.int32)), pa.array(piece.astype(np.int32)), pa.array(totals[k][piece])], ["k", "piece", "n"])

        counts = np.full((v, n), SMOOTH)
        for r in words.mapInArrow(pieces_of, "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).toLocalIterator():
            counts[r.piece, r.k] += r.n
        p = np.vstack([np.round(counts / counts.sum(axis=0), 12), np.full((1, n), UNKNOWN)])
        sent.unpersist()
    remove_table(spark, path)
    return Model(languages, trie, p, background)


def annotate(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The kept columns of docs (all, by default) with lang_pred and score appended; docs may have neither name yet."""
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.trie, model.p, model.letters))
    at, kept = docs.columns.index(text_col), [docs.columns.index(c) for c in (docs.columns if keep is None else keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held_once(sent.value, _model)  # its word scores serve later tasks
        for whole in batches:
            for first in range(0, whole.num_rows, 250):
                batch = whole.slice(first, 250)
                names, scores = m.predict(batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*(batch.schema.names[k] for k in kept), "lang_pred", "score"])

    return docs.mapInArrow(run, StructType([*(docs.schema.fields[k] for k in kept), StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, lang_pred, score) of each row. The model's size is vocabulary times languages, bounded by MAX_LANGUAGES."""
    src = docs.select(F.col(id_col).alias("d"), F.col(text_col).cast("string").alias("t"))
    return annotate(src, model, "t", keep=("d",))
