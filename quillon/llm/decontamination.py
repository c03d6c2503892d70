"""Benchmark decontamination: an FM-index for each shard of training documents, searched for the benchmark's windows.

A window is 13 consecutive words of an item, or all words of a shorter item. A shard is what one task has read, up to
a bound of symbols. Words that no item has, and runs of item words shorter than the shortest window, can't take part in
a match, so a shard's text holds the other runs only, with a mark between them. The windows are searched backwards
through wavelet ranks, their occurrences located by sampled suffix positions, and the hit spans merged.

The benchmark is cut into blocks of a bounded size; documents pass through one search for each block.

Defined results: a null or empty text has no words and no hits; an item without words has no windows; items of equal id
count as one; repeated documents are each reported; extra columns pass only if asked for.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bytes_of, column_of, drop_caches, pieces
from quillon.llm.fm_index import FMIndex

WINDOW = 13
#: Bytes of benchmark text in a block: the bound of what is broadcast at a time.
BLOCK_BYTES = 4 << 20
#: Symbols, and bytes of text, after which a task closes a shard.
SHARD_SYMBOLS, SHARD_BYTES = 1 << 20, 64 << 20

_TABLE = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z became a-z."""
    return text.translate(_TABLE).split()


@dataclass
class Windows:
    """A block of the benchmark. ids: word -> symbol from 2; patterns: for each length, distinct windows as rows and the items that have each."""

    ids: dict[bytes, int]
    patterns: list[tuple[np.ndarray, list[list[str]]]]

    @property
    def shortest(self) -> int:
        return min((p.shape[1] for p, _ in self.patterns), default=WINDOW)


def windows_of(items: list[tuple[str, bytes]], window: int = WINDOW) -> Windows:
    ids: dict[bytes, int] = {}
    found: dict[int, dict[tuple[int, ...], set[str]]] = {}
    for item, text in items:
        symbols = [ids.setdefault(w, len(ids) + 2) for w in words_of(text)]
        k = min(window, len(symbols))
        for i in range(len(symbols) - k + 1) if k else ():
            found.setdefault(k, {}).setdefault(tuple(symbols[i : i + k]), set()).add(item)
    return Windows(ids, [(np.array(list(w), np.int64), [sorted(x) for x in w.values()]) for _, w in sorted(found.items())])


class Shard:
    """Documents whose index isn't built yet."""

    def __init__(self, windows: Windows) -> None:
        self.windows, self.symbols, self.places, self.docs, self.size, self.bytes = windows, [], [], 0, 0, 0

    def add(self, words: list[bytes], n_bytes: int) -> None:
        symbols = np.fromiter(map(self.windows.ids.get, words, repeat(1)), np.int64, len(words))
        edges = np.diff(np.r_[0, (symbols > 1).astype(np.int8), 0])
        starts, ends = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
        long = ends - starts >= self.windows.shortest
        for a, b in zip(starts[long], ends[long]):
            self.symbols += [symbols[a:b], np.ones(1, np.int64)]
            self.places.append((self.size, b - a, self.docs, a))
            self.size += int(b - a) + 1
        self.docs += 1
        self.bytes += n_bytes

    def search(self) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
        """Of each document: merged spans of hit words, and the items."""
        spans: list[list[tuple[int, int]]] = [[] for _ in range(self.docs)]
        items: list[set[str]] = [set() for _ in range(self.docs)]
        if not self.size:
            return spans, items
        index = FMIndex(np.concatenate(self.symbols))
        at, _, doc, first = np.array(self.places, np.int64).T
        cover = np.zeros(self.size + 1, np.int64)
        for patterns, owners in self.windows.patterns:
            low, high = index.search(patterns)
            n = high - low
            which = np.repeat(np.arange(len(n)), n)
            rows = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            start = index.locate(rows)
            np.add.at(cover, start, 1)
            np.add.at(cover, start + patterns.shape[1], -1)
            run = np.searchsorted(at, start, "right") - 1
            for d, w in np.unique(np.stack([doc[run], which], 1), axis=0) if len(run) else ():
                items[d].update(owners[w])
        hit = np.diff(np.r_[0, (np.cumsum(cover) > 0).astype(np.int8), 0])
        for a, b in zip(np.nonzero(hit == 1)[0], np.nonzero(hit == -1)[0]):
            k = np.searchsorted(at, a, "right") - 1
            spans[doc[k]].append((int(a - at[k] + first[k]), int(b - at[k] + first[k])))
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def byte_spans(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans as spans of the text's bytes, from the first word's start to the last one's end."""
    if not spans:
        return []
    at = [m.span() for m in _WORD.finditer(text.translate(_TABLE))]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


def blocks_of(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> tuple[int, Callable[[int], Windows]]:
    """How many blocks of about block_bytes of text the benchmark has, and what makes each: the driver holds one at a time."""
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).cast("binary").alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // block_bytes)
    return n, lambda k: windows_of([(r["i"], bytes(r["t"])) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()], window)


_SPANS = "array<struct<start:int,end:int>>"


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, *keep, n_words, n_hit, items, spans, byte_spans, contaminated): spans are merged removal spans, of words and of bytes."""
    names = list(dict.fromkeys([id_col, *keep]))
    clash = set(names) & {"n_words", "n_hit", "items", "spans", "byte_spans", "contaminated", "__text"}
    if clash:
        raise ValueError(f"kept columns have names of the result: {sorted(clash)}")
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names]
    n, block = blocks_of(benchmark, item_col, item_text_col, window, block_bytes)
    rows = docs.select(*names, F.col(text_col).cast("binary").alias("__text"))
    for k in range(max(1, n)):  # a broadcast lies in a file: the driver forgets its block
        rows = _search(rows, names, fields, block(k) if n else Windows({}, []), k == 0, k >= n - 1)
    hit: Column = F.col("n_hit")
    return rows.withColumn("contaminated", (hit > 0) & (hit * 20 >= F.col("n_words")))


def _search(rows: DataFrame, names: list[str], fields: list[str], windows: Windows, first: bool, last: bool) -> DataFrame:
    """One block's pass; what earlier blocks found goes along and is merged."""
    sent = rows.sparkSession.sparkContext.broadcast(windows)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    found = [("items", pa.list_(pa.string())), ("spans", span)]
    more = [("n_words", pa.int64()), ("n_hit", pa.int64()), *found, ("byte_spans", span)]
    pack = lambda x: [{"start": a, "end": b} for a, b in x]

    def close(shard: Shard, held: list[pa.RecordBatch], words: list[int]) -> Iterator[pa.RecordBatch]:
        spans, items = shard.search()
        at = 0
        for piece in held:
            n = piece.num_rows
            s, i = spans[at : at + n], items[at : at + n]
            if not first:
                s = [merged(x + [(d["start"], d["end"]) for d in old]) for x, old in zip(s, column_of(piece, "spans").to_pylist())]
                i = [x | set(old) for x, old in zip(i, column_of(piece, "items").to_pylist())]
            own = [pa.array([sorted(x) for x in i], found[0][1]), pa.array([pack(x) for x in s], span)]
            kept = [column_of(piece, c) for c in names]
            if last:
                texts = column_of(piece, "__text")
                where = [pack(byte_spans(texts[k].as_py(), x)) if x else [] for k, x in enumerate(s)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(words[at : at + n], pa.int64()), pa.array([sum(b - a for a, b in x) for x in s], pa.int64()), *own, pa.array(where, span)], names=[*names, *(c for c, _ in more)])
            else:
                yield pa.RecordBatch.from_arrays([*kept, column_of(piece, "__text"), *own], names=[*names, "__text", *(c for c, _ in found)])
            at += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        w = sent.value
        shard, held, words = Shard(w), [], []
        for piece in pieces(batches, "__text"):
            for text in bytes_of(piece, "__text"):
                own = words_of(text or b"")
                words.append(len(own))
                shard.add(own, len(text or b""))
            held.append(piece)
            if shard.size >= SHARD_SYMBOLS or shard.bytes >= SHARD_BYTES:
                yield from close(shard, held, words)
                shard, held, words = Shard(w), [], []
        if held:
            yield from close(shard, held, words)

    if last:
        fields = [*fields, "n_words long", "n_hit long", "items array<string>", f"spans {_SPANS}", f"byte_spans {_SPANS}"]
    else:
        fields = [*fields, "__text binary", "items array<string>", f"spans {_SPANS}"]
    return rows.mapInArrow(run, ", ".join(fields))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    items = F.array_join(F.array_sort("items"), ",")
    return found.select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), "contaminated")


def item_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
