"""Toxicity scores by a factorization machine over hashed terms.

score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), x_i = 1 for a term that a text has. Terms are
lower-case words and their beginnings of four and five letters. The pairwise part costs as much as the linear one:
half of |sum v_i|^2 - sum |v_i|^2. It is fitted with AdaGrad on a bounded sample of labelled rows, sorted by a hash of the
text, so the same rows give the same machine in any partitions.

Defined results: null and empty texts have no terms and get the bias's score; repeated label rows count once
(the larger label); without labelled rows every score is 0.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.common import column_of, id_bucket, labelled, map_pieces, texts_of, worker_cache
from quillon.llm.terms import TermHasher, row_sums, starts_of

#: Labelled documents that the machine is fitted on, at most (about): the bound of the fit.
FIT_ROWS = 10_000
BITS = 18
FACTORS = 4
EPOCHS = 12
#: Share of the texts that a term must have for its pairs to be looked at, where it isn't tied to the label by itself.
PAIR_SHARE = 0.02
_WORD = re.compile(r"\w+")


def toxic_terms(part: str) -> list[str]:
    out = []
    for w in _WORD.findall(part.lower()):
        out.append(w)
        if len(w) > 4:
            out.append(w[:4] + "*")
            out.append(w[:5] + "*")
    return out


@dataclass
class FactorizationMachine:
    bias: float
    #: (terms, 2 + factors): linear weight, half the factors' squared length, factors.
    table: np.ndarray
    #: Fitted on no rows at all: every score is 0.
    blank: bool = False

    def scores(self, rows: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
        if self.blank:
            return np.zeros(n)
        s = row_sums(self.table[ids], rows, n)
        z = self.bias + s[:, 0] + 0.5 * (s[:, 2:] ** 2).sum(1) - s[:, 1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def tie(df: np.ndarray, hits: np.ndarray, n: int, positive: float) -> np.ndarray:
    """Likelihood ratio statistic of each term's 2 x 2 table with the label."""
    part = lambda k, total, share: np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(total * share, 1e-9)), 0)
    yes, no = positive / n, 1 - positive / n
    return 2 * (part(hits, df, yes) + part(df - hits, df, no) + part(positive - hits, n - df, yes) + part(n - df - positive + hits, n - df, no))


def paired(x: np.ndarray, residual: np.ndarray, variance: np.ndarray, least: float, block: int = 1024, texts: int = 2048) -> np.ndarray:
    """Columns of x (texts x terms, 0 or 1) that are tied to the residual together with another: a standard score of ``least`` or more.

    The score of a pair is the sum of residual times both centred columns over its standard deviation, by the residuals'
    variance; all pairs are scored, in blocks of columns.
    """
    n, terms = x.shape
    mean = x.mean(0, dtype=np.float32) if n else np.zeros(terms, np.float32)
    out = np.zeros(terms, bool)
    for a in range(0, terms, block):
        total, square = (np.zeros((min(block, terms - a), terms), np.float32) for _ in range(2))
        for d in range(0, n, texts):
            c = x[d : d + texts] - mean
            e = residual[d : d + texts, None].astype(np.float32)
            total += (c[:, a : a + block] * e).T @ c
            c *= c
            square += (c[:, a : a + block] * variance[d : d + texts, None].astype(np.float32)).T @ c
        score = np.abs(total) >= least * np.sqrt(np.maximum(square, 1e-9))
        score[np.arange(len(score)), np.arange(a, a + len(score))] = False
        out |= score.any(0)
        out[a : a + block] |= score.any(1)
    return out


def fit_machine(rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, *, bits: int = BITS, factors: int = FACTORS, epochs: int = EPOCHS, batch: int = 32, rate: float = 0.1, penalty: float = 1e-4, least: int = 4, tied: float = 12.0, together: float = 6.5, pair_share: float = PAIR_SHARE, frequent: float = 0.05, seed: int = 5) -> FactorizationMachine:
    """labels: one for each text; rows, ids: the texts' distinct terms in order.

    Fitted are the terms of ``least`` texts or more that are tied to the label (a likelihood ratio statistic of ``tied``); then,
    again, with those that are tied to what these left unexplained together with another term (a standard score of
    ``together``; all pairs of terms of ``pair_share`` of the texts or more are scored), for a pair may tell what neither
    term does. The number of either kind isn't bounded.
    Terms of ``frequent`` of the texts or more are centred while it is fitted (x less its mean), or their many chance pairs
    would hide the pairs that matter; the centres go into bias and linear weights afterwards, so it scores as any other.
    """
    n, size = len(labels), 1 << bits
    if not n:
        return FactorizationMachine(0.0, np.zeros((size, 2 + factors), np.float32), True)
    df = np.bincount(ids, minlength=size)
    column = np.full(size, -1)

    def matrix(terms: np.ndarray) -> np.ndarray:
        column[terms] = np.arange(len(terms))
        own = np.zeros(size, bool)
        own[terms] = True
        own = own[ids]
        x = np.zeros((n, len(terms)), bool)
        x[rows[own], column[ids[own]]] = True
        return x

    def descended(known: np.ndarray) -> FactorizationMachine:
        dense = np.nonzero(known & (df >= frequent * n))[0]
        sparse = np.nonzero(known & (df < frequent * n))[0]
        mean = (df[dense] / n).astype(np.float32)
        x = matrix(dense)
        column[sparse] = np.arange(len(sparse))
        own = np.zeros(size, bool)
        own[sparse] = True
        own = own[ids]
        at, own_ids = starts_of(rows[own], n), column[ids[own]]

        share = (labels.sum() + 0.5) / (n + 1)
        bias = float(np.log(share / (1 - share)))
        rng = np.random.default_rng(seed)
        model = [np.zeros((len(t), 1 + factors)) for t in (dense, sparse)]  # weight, factors
        for m in model:
            m[:, 1:] = rng.normal(0, 0.01, (len(m), factors))
        seen, seen_bias = [np.full(m.shape, 1e-2) for m in model], 1e-2
        speed = np.array([rate, *[rate * 0.2] * factors])

        def step(m: np.ndarray, g: np.ndarray, which: slice | np.ndarray, gradient: np.ndarray) -> None:
            gradient = gradient + penalty * m[which]
            g[which] += gradient**2
            m[which] -= speed * gradient / np.sqrt(g[which])

        for _ in range(epochs):
            order = rng.permutation(n)
            for a in range(0, n, batch):
                docs = order[a : a + batch]
                k = len(docs)
                xd = x[docs] - mean
                flat = np.concatenate([np.arange(at[d], at[d + 1]) for d in docs])
                own = np.repeat(np.arange(k), at[docs + 1] - at[docs])
                f = own_ids[flat]
                md, ms = model[0], model[1][f]
                both = xd @ md + row_sums(ms, own, k)  # sums of weights, and of factors
                sums = both[:, 1:]
                squares = (xd**2) @ (md[:, 1:] ** 2).sum(1) + row_sums((ms[:, 1:] ** 2).sum(1), own, k)
                z = bias + both[:, 0] + 0.5 * ((sums**2).sum(1) - squares)
                err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[docs]) / k
                wide = np.concatenate([err[:, None], err[:, None] * sums], 1)
                step(*(y[0] for y in (model, seen)), slice(None), xd.T @ wide - np.concatenate([np.zeros((len(dense), 1)), ((xd**2).T @ err)[:, None] * md[:, 1:]], 1))
                u, back = np.unique(f, return_inverse=True)
                e = wide[own]
                e[:, 1:] -= err[own, None] * ms[:, 1:]
                step(*(y[1] for y in (model, seen)), u, np.stack([np.bincount(back, e[:, j], len(u)) for j in range(1 + factors)], 1))
                gradient = err.sum()
                seen_bias += gradient**2
                bias -= rate * gradient / np.sqrt(seen_bias)
        table = np.zeros((size, 2 + factors), np.float32)
        for terms, m in ((dense, model[0]), (sparse, model[1])):
            table[terms, 0], table[terms, 1], table[terms, 2:] = m[:, 0], 0.5 * (m[:, 1:] ** 2).sum(1), m[:, 1:]
        v, centre = model[0][:, 1:], mean @ model[0]
        square = (v**2).sum(1)
        table[dense, 0] += square * mean
        fitted = np.concatenate([dense, sparse])
        table[fitted, 0] -= table[fitted, 2:] @ centre[1:]
        bias += 0.5 * (centre[1:] @ centre[1:] - square @ mean**2) - centre[0]
        return FactorizationMachine(float(bias), table)

    known = (df >= least) & (tie(df, np.bincount(ids, labels[rows], size), n, labels.sum()) >= tied)
    first = descended(known)
    pairs = np.nonzero((df >= max(least, pair_share * n)) & (df < n))[0]
    chance = first.scores(rows, ids, n)
    found = pairs[paired(matrix(pairs), labels - chance, chance * (1 - chance), together)]
    if known[found].all():
        return first
    known[found] = True
    return descended(known)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", rows: int = FIT_ROWS, folds: int = 5) -> FactorizationMachine:
    """Fit on about ``rows`` labelled rows at most, of those whose id's crc32 modulo ``folds`` isn't 0. Only term ids reach the driver."""
    sample = labelled(docs, labels, label, id_col, text_col, rows, id_bucket(id_col, folds) == 0)

    def make():
        hasher = _hasher()

        def run(piece: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(piece, "text")
            r, ids = hasher.distinct(texts)
            lists = pa.ListArray.from_arrays(pa.array(starts_of(r, len(texts)).astype(np.int32)), pa.array(ids.astype(np.int32)))
            return pa.RecordBatch.from_arrays([column_of(piece, "__label"), column_of(piece, "__order"), lists], names=["label", "order", "ids"])

        return run

    got = map_pieces(sample, "text", make, "label int, order string, ids array<int>").toArrow()
    if not got.num_rows:
        return fit_machine(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    got = got.sort_by([("order", "ascending"), ("label", "ascending")])
    lists = got["ids"].combine_chunks()
    n = np.asarray(lists.value_lengths())
    return fit_machine(np.repeat(np.arange(len(n)), n), np.asarray(lists.flatten()).astype(np.int64), np.asarray(got["label"]).astype(float))


def predict(docs: DataFrame, model: FactorizationMachine, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), threshold: float = 0.5) -> DataFrame:
    """(id, *keep, score, predicted) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [id_col, *keep]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + ", score double, predicted int"

    def make():
        m, hasher = sent.value, _hasher()

        def run(piece: pa.RecordBatch) -> pa.RecordBatch:
            texts = [x or "" for x in texts_of(piece, text_col)]
            s = m.scores(*hasher.distinct(texts), len(texts))
            return pa.RecordBatch.from_arrays([*(column_of(piece, c) for c in names), pa.array(s.astype(np.float64)), pa.array((s >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

        return run

    return map_pieces(docs.select(*names, text_col), text_col, make, schema, 1 << 20)


def _hasher() -> TermHasher:
    """A worker's: its memo doesn't depend on the model."""
    return worker_cache("toxicity", lambda: TermHasher(toxic_terms, BITS))
