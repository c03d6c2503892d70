"""Hashed terms of texts, for the two classifiers."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from itertools import chain

import numpy as np

from quillon.llm.common import Memo


class TermHasher:
    """Maps texts to hashed term ids through a memo of space-separated parts; terms(part) lists a part's terms.

    whole(parts) lists terms of the text as a whole, which counted() adds.
    """

    def __init__(self, terms: Callable[[str], list[str]], bits: int, whole: Callable[[list[str]], list[str]] | None = None) -> None:
        self.terms, self.mask, self.memo, self.whole = terms, (1 << bits) - 1, Memo(100_000), whole

    def ids(self, part: str) -> tuple[int, ...]:
        return tuple(set(map(self.id, self.terms(part))))

    def id(self, term: str) -> int:
        return zlib.crc32(term.encode("utf-8", "surrogatepass")) * 0x9E3779B1 >> 7 & self.mask

    def distinct(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of all texts one after another: number of the text, and each of its distinct term ids, in order."""
        parts = [set(x.split()) for x in texts]
        todo = self.memo.missing(set().union(*parts))
        new = self.memo.new
        for p in todo:
            new[p] = self.ids(p)
        get = new.__getitem__
        rows, ids = [], []
        for i, p in enumerate(parts):
            own = np.unique(np.fromiter(chain.from_iterable(map(get, p)), np.int64))
            ids.append(own)
            rows.append(np.full(len(own), i))
        return (np.concatenate(rows), np.concatenate(ids)) if rows else (np.zeros(0, np.int64),) * 2

    def counted(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the text, distinct term id, and how often it occurs there."""
        parts = [x.split() for x in texts]
        todo = self.memo.missing(set().union(*parts))
        new = self.memo.new
        for p in todo:
            new[p] = self.ids(p)
        get = new.__getitem__
        rows, ids, counts = [], [], []
        for i, p in enumerate(parts):
            more = list(map(self.id, self.whole(p))) if self.whole else []
            own = np.bincount(np.fromiter(chain(chain.from_iterable(map(get, p)), more), np.int64), minlength=1)
            k = np.nonzero(own)[0]
            ids.append(k)
            counts.append(own[k])
            rows.append(np.full(len(k), i))
        return (np.concatenate(rows), np.concatenate(ids), np.concatenate(counts)) if rows else (np.zeros(0, np.int64),) * 3


def starts_of(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each text's entries begin, and the end of the last."""
    return np.searchsorted(rows, np.arange(n + 1))


def row_sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums over each text's entries; values may have columns; texts without entries sum to 0."""
    out = np.zeros((n, *values.shape[1:]), values.dtype)
    if len(rows):
        at = starts_of(rows, n)
        full = np.nonzero(at[1:] > at[:-1])[0]
        out[full] = np.add.reduceat(values, at[full], axis=0)
    return out
