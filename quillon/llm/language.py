"""Language identification by unigram models marginalised over segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum,
over all its segmentations into pieces, of the product of their probabilities (forward algorithm); pieces never
span words, so a text's log-probability is the sum over its words. Piece probabilities are fitted by expected
counts over the distinct words of a bounded sample, in a few distributed rounds. A word may be as long as a text (scripts
without spaces): sums are scaled as they go, so none becomes 0, and the work is linear in the length.

Defined results: a null text, or one without letters, is ``und`` with score 0; ties go to the language that
sorts first; rows without a language teach nothing; without any labelled row every text is ``und``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Memo, checkpoint, column_of, map_pieces, pieces, record, sample_rows, texts_of, worker_cache

#: Documents that a model is fitted on, at most (about): the bound of the fit.
FIT_ROWS = 6000
ROUNDS = 3
START = "▁"
WORD = re.compile(r"[^\W\d_]+")
LONG = 64  # longer words aren't kept in the memo of scores: few of them come again
CELLS = 200_000  # characters of words that are scored together
LOW, RAISE = 1e-100, 1e100  # sums below are raised by the factor; a few steps can't take them to 0
_B = 0x9E3779B97F4A7C15


def sentencepiece_vocabulary(path: str) -> list[str]:
    """The text pieces of a sentencepiece model, without its control and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, _B, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), length).astype(np.uint64) + np.uint64(1)


class Pieces:
    """The vocabulary as a sorted table of hashes; row n (the last) stands for no piece."""

    def __init__(self, vocabulary: list[str]) -> None:
        vocabulary = sorted({p for p in vocabulary if p and p == p.lower()})
        self.n = len(vocabulary)
        self.longest = max(map(len, vocabulary), default=1)
        keys = np.zeros(self.n, np.uint64)
        for k in range(1, self.longest + 1):
            own = [i for i, p in enumerate(vocabulary) if len(p) == k]
            if own:
                keys[own] = self._hash(_codes([vocabulary[i] for i in own], k))[:, -1]
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.order]
        self.lengths = np.array([len(p) for p in vocabulary], np.int32)

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        """Hash of each prefix; position 0 weighs the highest power."""
        out = np.zeros(codes.shape, np.uint64)
        h = np.zeros(len(codes), np.uint64)
        for j in range(codes.shape[1]):
            h = h * np.uint64(_B) + codes[:, j]
            out[:, j] = h
        return out

    def rows(self, words: list[str], length: int) -> Iterator[tuple[int, np.ndarray]]:
        """(k, piece row of each word's k characters from each start), for all lengths k that some word has a piece of; 1 always."""
        codes = _codes(words, length)
        prefix = np.concatenate([np.zeros((len(words), 1), np.uint64), self._hash(codes)], 1)
        power = _powers(length)
        for k in range(1, min(self.longest, length) + 1):
            h = prefix[:, k:] - prefix[:, :-k] * power[k]
            at = np.searchsorted(self.keys, h)
            at[at == self.n] = 0
            row = np.where(self.keys[at] == h, self.order[at], self.n) if self.n else np.zeros(h.shape, np.int32)
            if k == 1 or (row < self.n).any():
                yield k, row


@dataclass
class LanguageModel:
    languages: list[str]
    pieces: Pieces
    #: (pieces + 1, languages): probabilities; the last row is 0.
    p: np.ndarray
    #: of a character that is no piece.
    other: np.ndarray
    prior: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        """(words, languages): log-probabilities, summed over all segmentations."""
        out = np.zeros((len(words), len(self.languages)))
        for some, length in _alike(words):
            f = Forward(self, [words[i] for i in some], length, False)
            out[some] = np.log(f.sums[length]) - np.log(RAISE) * f.raised[length]
        return out


def _alike(words: list[str]) -> Iterator[tuple[np.ndarray, int]]:
    """Numbers of words of one length, about CELLS characters at a time."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths):
        own = np.nonzero(lengths == length)[0]
        step = max(1, CELLS // int(length))
        for a in range(0, len(own), step):
            yield own[a : a + step], int(length)


class Forward:
    """The forward sums of words of one length: of each prefix length, the summed probability of its segmentations.

    sums[e] times LOW to the power raised[e] is the probability, (words, languages) each. A pass needs the last sums only;
    ``keep`` holds all, as expected counts need them.
    """

    def __init__(self, model: LanguageModel, words: list[str], length: int, keep: bool) -> None:
        self.model, n, lang = model, len(words), len(model.languages)
        none = model.pieces.n
        self.rows = [(k, row, (row < none).any(0) | (k == 1)) for k, row in model.pieces.rows(words, length)]
        # a pass that keeps nothing holds as many steps as its longest piece
        self.sums = np.empty((length + 1, n, lang)) if keep else {}
        self.raised = np.zeros((length + 1, n, lang), np.int32) if keep else {}
        self.sums[0], self.raised[0] = np.ones((n, lang)), np.zeros((n, lang), np.int32)
        reach = max(k for k, _, _ in self.rows)
        for end in range(1, length + 1):
            f = np.zeros((n, lang))
            for k, row, used in self.rows:
                if k <= end and used[end - k]:
                    f += self.sums[end - k] * self.chance(row[:, end - k], k)
            self.sums[end], self.raised[end] = f, self.raised[end - 1]
            if end % 8 == 0 and f.min() < LOW:
                low = f < LOW
                for s in range(max(0, end - reach), end + 1):
                    self.sums[s] = np.where(low, self.sums[s] * RAISE, self.sums[s])
                    self.raised[s] = self.raised[s] + low
            if not keep and end >= reach:
                del self.sums[end - reach], self.raised[end - reach]

    def chance(self, row: np.ndarray, k: int) -> np.ndarray:
        p = self.model.p[row]
        return np.where((row == self.model.pieces.n)[:, None], self.model.other, p) if k == 1 else p


def expected_counts(model: LanguageModel, words: list[str], weights: np.ndarray) -> np.ndarray:
    """(pieces + 1, languages): expected uses of each piece, of unknown characters in the last row.

    From a word's end backwards, reach[e] is the chance that a piece ends at e; a piece from s to e takes the share of it
    that s's sum times the piece's probability has in e's sum.
    """
    n, lang = model.pieces.n, len(model.languages)
    out = np.zeros((n + 1, lang))
    for some, length in _alike(words):
        f = Forward(model, [words[i] for i in some], length, True)
        reach = np.zeros((length + 1, len(some), lang))
        reach[length] = weights[some]
        for end in range(length, 0, -1):
            for k, row, used in f.rows:
                start = end - k
                if start < 0 or not used[start]:
                    continue
                share = f.sums[start] * f.chance(row[:, start], k) / f.sums[end]
                later = f.raised[end] - f.raised[start]
                if later.any():
                    share = share * RAISE**later
                use = reach[end] * share
                reach[start] += use
                for g in range(lang):
                    out[:, g] += np.bincount(row[:, start], use[:, g], n + 1)
    return out


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def parts_of(words: list[str]) -> list[str]:
    return [START + w for w in words]


def fit(docs: DataFrame, vocabulary: list[str], *, text_col: str = "text", lang_col: str = "lang", key: Column | None = None, rows: int = FIT_ROWS, rounds: int = ROUNDS) -> LanguageModel:
    """Fit on about ``rows`` rows with a language, at most. What reaches the driver is a count for each piece and language."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = sample_rows(known, F.xxhash64(text_col) if key is None else key, rows).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 16 << 20):
            found: dict[str, Counter] = {}
            for lang, text in zip(texts_of(piece, "lang"), texts_of(piece, "text")):
                found.setdefault(lang, Counter()).update(words_of(text))
            for lang, c in found.items():
                yield record(lang=([lang] * len(c), pa.string()), word=(list(c), pa.string()), n=(list(c.values()), pa.int64()))

    counts = checkpoint(known.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    sizes = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(sizes)
    table = Pieces(vocabulary)
    n, lang = table.n, len(languages)
    start = np.zeros((n + 1, lang))
    start[:n] = (1 / np.maximum(1, 4.0 ** (5 - np.minimum(table.lengths, 5))))[:, None]
    start[:n] /= max(1e-9, start[:n].sum(0, keepdims=True).max(initial=0))
    total = np.array([sizes[x] for x in languages], float)
    model = LanguageModel(languages, table, start, np.full(lang, 1e-7), np.log((total + 1) / (total + 1).sum()) if lang else total)
    if not lang:
        return model
    for _ in range(rounds):
        sent = docs.sparkSession.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, sums = sent.value, None
            at = {x: i for i, x in enumerate(m.languages)}
            for piece in pieces(batches, "word"):
                words, langs, k = texts_of(piece, "word"), texts_of(piece, "lang"), column_of(piece, "n").to_pylist()
                weights = np.zeros((len(words), len(at)))
                for i, x in enumerate(langs):
                    weights[i, at[x]] = k[i]
                found = expected_counts(m, parts_of(words), weights)
                sums = found if sums is None else sums + found
            if sums is not None:
                row, g = np.nonzero(sums)
                yield record(piece=(row, pa.int32()), lang=(g, pa.int32()), n=(sums[row, g], pa.float64()))

        got = counts.mapInArrow(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        c = np.zeros((n + 1, lang))
        c[got["piece"], got["lang"]] = got["n"]
        shared = (c.sum(1) + 0.01)[:, None] / (c.sum() + 0.01 * (n + 1))
        c = (c + 50 * shared) / (c.sum(0) + 50)
        p = c.copy()
        p[n] = 0
        model = LanguageModel(languages, table, p, np.maximum(c[n], 1e-9) / 100, model.prior)
    return model


def predict(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, lang_pred, score): the likeliest language of each whole text and its posterior probability."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [id_col, *keep]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + ", lang_pred string, score double"

    def make():
        m = sent.value
        cache = _memo(m)

        def run(piece: pa.RecordBatch) -> pa.RecordBatch:
            words = [words_of(x) if x else [] for x in texts_of(piece, text_col)]
            every = set().union(*words)
            long = {w for w in every if len(w) > LONG}
            todo = cache.missing(every - long)
            score = lambda some: zip(some, map(tuple, (m.word_scores(parts_of(some)) if m.languages else np.zeros((len(some), 1))).tolist()))
            cache.new.update(score(todo))
            langs, best = [], []
            own = dict(score(list(long)))
            get = (lambda w: own[w] if w in own else cache.new[w]) if own else cache.new.__getitem__
            for w in words:
                if not m.languages or not any(c.isalpha() for x in w for c in x):
                    langs.append("und")
                    best.append(0.0)
                    continue
                total = np.array(list(map(get, w))).sum(0) + m.prior
                k = int(total.argmax())
                langs.append(m.languages[k])
                best.append(float(1 / np.exp(total - total[k]).sum()))
            return pa.RecordBatch.from_arrays([*(column_of(piece, c) for c in names), pa.array(langs), pa.array(best)], names=[*names, "lang_pred", "score"])

        return run

    return map_pieces(docs.select(*names, text_col), text_col, make, schema)


def _memo(model: LanguageModel) -> Memo:
    """The worker's memo for this model."""
    return worker_cache(("language", hash((tuple(model.languages), model.p.tobytes()))), lambda: Memo(300_000))
