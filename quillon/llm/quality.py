"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Terms are the parts of a text (words in lower case), the parts' shapes (runs of capitals, small letters, digits and
signs), and the parts that repeat the one before. Hashed term counts are weighted log(1 + tf) * idf, projected
on the leading singular vectors of a bounded labelled sample, and scaled to length 1. The labelled vectors are
broadcast (rows x dimensions, both parameters); for every text the exact cosine products with all of them are
computed in blocks, and its nearest ones vote with their similarity as weight; all that are as near as the last of them
(to ``TIE``) vote too. The sample is sorted by a hash of the text, so the same rows give the same model in any partitions.

Defined results: a text without known terms (null, empty) gets the labels' mean; repeated label rows count once (the
larger label); without labelled rows every score is 0.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.common import column_of, id_bucket, labelled, map_pieces, texts_of, worker_cache
from quillon.llm.terms import TermHasher, row_sums, starts_of

#: Labelled documents that vote, and that the space is fitted on, at most (about): the bound of what is broadcast.
FIT_ROWS = 3000
BITS = 15
DIMENSIONS = 32
NEIGHBOURS = 15
TIE = 1e-5  # of cosines in single precision
PIECE = 1 << 20  # bytes of text scored at a time
LEAST_SHARE = 0.01  # of the sample's texts that a term must occur in
_CLASSES = [(re.compile(r"[^\W\d_a-zß-öø-ÿ]*[A-ZÀ-ÖØ-Þ]{2,}[^\W\d_a-zß-öø-ÿ]*"), "A"), (re.compile(r"[A-ZÀ-ÖØ-Þ]"), "B"), (re.compile(r"[^\W\d_AB]+"), "a"), (re.compile(r"\d+"), "0")]


def shape(part: str) -> str:
    for pattern, letter in _CLASSES:
        part = pattern.sub(letter, part)
    return part


def quality_terms(part: str) -> list[str]:
    return ["w" + part.lower(), "s" + shape(part)]


def repeat_marks(parts: list[str]) -> list[str]:
    """What a text says by repeating parts: for each that repeats the one before it, a term with the share of such parts, as a power of two."""
    repeats = sum(map(eq, parts, parts[1:]))
    return ["r" + str((repeats * 8 // len(parts)).bit_length())] * repeats if repeats else []


@dataclass
class NeighbourModel:
    #: of each term: weight times its coordinates; terms x dimensions.
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int = NEIGHBOURS

    def project(self, rows: np.ndarray, ids: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
        x = row_sums(self.axes[ids] * np.log1p(counts).astype(np.float32)[:, None], rows, n)
        length = np.sqrt((x * x).sum(1, keepdims=True))
        return x / np.where(length > 0, length, 1)

    def votes(self, x: np.ndarray, block: int = 512) -> np.ndarray:
        if not len(self.labels):
            return np.zeros(len(x))
        out = np.full(len(x), float(self.labels.mean()))
        k = min(self.neighbours, len(self.labels))
        for a in range(0, len(x), block):
            sims = x[a : a + block] @ self.vectors.T
            last = np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k, None]
            weight = np.where(sims >= last - TIE, np.maximum(sims, 0), 0).astype(np.float64)
            total = weight.sum(1)
            known = total > 1e-9
            out[a : a + block][known] = np.clip((weight @ self.labels)[known] / total[known], 0, 1)
        return out


def leading(x: np.ndarray, dimensions: int, spare: int = 8, rounds: int = 20, seed: int = 7) -> np.ndarray:
    """The right singular vectors of the largest singular values, as columns, by subspace iteration: it needs no square matrix."""
    k = min(dimensions + spare, *x.shape)
    q = np.random.default_rng(seed).normal(size=(x.shape[1], k)).astype(np.float32)
    for _ in range(rounds if k else 0):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    return q @ np.linalg.svd(x @ q, full_matrices=False)[2].T[:, :dimensions] if k else q


def fit_space(rows: np.ndarray, ids: np.ndarray, counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> NeighbourModel:
    n, size = len(labels), 1 << BITS
    axes = np.zeros((size, dimensions), np.float32)
    if not n:
        return NeighbourModel(axes, np.zeros((0, dimensions), np.float32), labels)
    df = np.bincount(ids, minlength=size)
    terms = np.nonzero(df >= max(2, LEAST_SHARE * n))[0]
    idf = np.log((n + 1) / (df[terms] + 0.5)).clip(0.05)
    column = np.full(size, -1)
    column[terms] = np.arange(len(terms))
    keep = column[ids] >= 0
    x = np.zeros((n, len(terms)), np.float32)
    x[rows[keep], column[ids[keep]]] = np.log1p(counts[keep]) * idf[column[ids[keep]]]
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
    lead = leading(x, dimensions)
    axes[terms, : lead.shape[1]] = lead * idf[:, None]
    model = NeighbourModel(axes, np.zeros((0, dimensions), np.float32), labels)
    model.vectors = model.project(rows, ids, counts, n).astype(np.float32)
    return model


def _counted(hasher: TermHasher, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return hasher.counted([x or "" for x in texts])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", rows: int = FIT_ROWS, folds: int = 5) -> NeighbourModel:
    """Fit on about ``rows`` labelled rows at most, of those whose id's crc32 modulo ``folds`` isn't 0. Only term counts reach the driver."""
    sample = labelled(docs, labels, label, id_col, text_col, rows, id_bucket(id_col, folds) == 0)

    def make():
        hasher = _hasher()

        def run(piece: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(piece, "text")
            r, ids, counts = _counted(hasher, texts)
            at = pa.array(starts_of(r, len(texts)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (ids, counts)]
            return pa.RecordBatch.from_arrays([column_of(piece, "__label"), column_of(piece, "__order"), *lists], names=["label", "order", "ids", "counts"])

        return run

    got = map_pieces(sample, "text", make, "label int, order string, ids array<int>, counts array<int>").toArrow()
    empty = np.zeros(0, np.int64)
    if not got.num_rows:
        return fit_space(empty, empty, empty, np.zeros(0))
    got = got.sort_by([("order", "ascending"), ("label", "ascending")])
    lists = got["ids"].combine_chunks()
    n = np.asarray(lists.value_lengths())
    return fit_space(np.repeat(np.arange(len(n)), n), np.asarray(lists.flatten()).astype(np.int64), np.asarray(got["counts"].combine_chunks().flatten()), np.asarray(got["label"]).astype(float))


def predict(docs: DataFrame, model: NeighbourModel, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), threshold: float = 0.3) -> DataFrame:
    """(id, *keep, score, predicted) of every whole text; keep may name the text itself."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = list(dict.fromkeys([id_col, *keep]))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + ", score double, predicted int"

    def make():
        m, hasher = sent.value, _hasher()

        def run(piece: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(piece, text_col)
            s = m.votes(m.project(*_counted(hasher, texts), len(texts)))
            return pa.RecordBatch.from_arrays([*(column_of(piece, c) for c in names), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

        return run

    return map_pieces(docs.select(*dict.fromkeys([*names, text_col])), text_col, make, schema, PIECE)


def _hasher() -> TermHasher:
    """A worker's: its memo doesn't depend on the model."""
    return worker_cache("quality", lambda: TermHasher(quality_terms, BITS, repeat_marks))
