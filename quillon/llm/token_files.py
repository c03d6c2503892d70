"""Token ids in Parquet: list columns with dictionary or delta encoding, bounded row groups, page indexes.

A folder of files in ascending id order (nulls first, ties by the text's hash). Columns: shard (order of the
file), doc id, start within the shard, n_tokens, token_ids. Row groups and pages are small and have min/max
indexes, so a reader of a few documents or of the metadata alone reads only their pages.

Defined results: a null or empty text has the end id only; repeated rows are each written; an empty table
gives an empty folder of files with the same schema. The vocabulary file is read on the driver and sent as a
broadcast value: its size is that of one vocabulary.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import bytes_of, column_of, pieces, read_file, shared_dir, worker_cache

END_ID = 2
#: Files whose offsets (16 bytes each) may be broadcast; beyond, they meet the ids by a shuffle.
FILES = 500_000
#: Signs that end a part: after letters, a run of them is one pre-token.
SIGNS = "!\"#$%&()*+,-./:;?@[]^_|~"


class WordIds:
    """Ids and bytes of distinct parts by the parts' 64-bit hashes: sorted arrays, a large one and a small one that is merged into it.

    A hash only says where to look: what is found counts if its bytes are the part's (``holds``).
    """

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.levels = [(np.zeros(0, np.uint64), np.zeros(0, np.int32))] * 2
        self.ends = np.zeros(1, np.int64)
        self.flat = np.zeros(0, "<u4")
        self.byte_ends = np.zeros(1, np.int64)
        self.bytes = np.zeros(0, np.uint8)
        self.n = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1."""
        out = np.full(len(keys), -1, np.int32)
        for known, slots in self.levels:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                out = np.where(known[at] == keys, slots[at], out)
        return out

    @staticmethod
    def _appended(flat: np.ndarray, ends: np.ndarray, n: int, values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        used = ends[n]
        need = used + len(values)
        if need > len(flat):
            flat = np.concatenate([flat[:used], np.zeros(need * 5 // 4 - used + 1024, flat.dtype)])
        flat[used:need] = values
        if n + len(counts) + 1 > len(ends):
            ends = np.concatenate([ends[: n + 1], np.zeros((n + len(counts)) // 4 + len(counts) + 1, np.int64)])
        ends[n + 1 : n + 1 + len(counts)] = used + np.cumsum(counts)
        return flat, ends

    def holds(self, slots: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether the bytes of each slot are raw[start:end]."""
        own = self.byte_ends[slots]
        return same_bytes(self.bytes, own, self.byte_ends[slots + 1], raw, start, end)

    def add(self, keys: np.ndarray | None, parts: list[bytes], ids: list[bytes]) -> np.ndarray:
        """The slots of parts with their ids as bytes; keys are new. Without keys the parts aren't found again."""
        counts = np.array([len(x) // 4 for x in ids], np.int64)
        self.flat, self.ends = self._appended(self.flat, self.ends, self.n, np.frombuffer(b"".join(ids), "<u4"), counts)
        lengths = np.array([len(x) for x in parts], np.int64)
        self.bytes, self.byte_ends = self._appended(self.bytes, self.byte_ends, self.n, np.frombuffer(b"".join(parts), np.uint8), lengths)
        slots = np.arange(self.n, self.n + len(parts), dtype=np.int32)
        self.n += len(parts)
        if keys is None:
            return slots
        new = (keys, slots)
        large, small = self.levels
        small = self._merged(small, new)
        if len(small[0]) > 50_000 + len(large[0]) // 4:
            large, small = self._merged(large, small), (np.zeros(0, np.uint64), np.zeros(0, np.int32))
        self.levels = [large, small]
        return slots

    @staticmethod
    def _merged(*levels: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in levels])
        order = np.argsort(keys)
        return keys[order], np.concatenate([v for _, v in levels])[order]

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, count of each slot)."""
        start = self.ends[slots]
        n = self.ends[slots + 1] - start
        at = np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n)
        at += np.arange(len(at))
        return self.flat[at], n


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def same_bytes(x: np.ndarray, x_start: np.ndarray, x_end: np.ndarray, y: np.ndarray, y_start: np.ndarray, y_end: np.ndarray) -> np.ndarray:
    """Of each pair of spans, whether they hold the same bytes: eight at a time, and as a whole beyond 64."""
    n = x_end - x_start
    same = n == y_end - y_start
    own = np.nonzero(same & (n > 0))[0]
    eights = [np.ndarray(len(z) + 1, "<u8", np.r_[z, np.zeros(8, np.uint8)], strides=(1,)) for z in (x, y)]
    for k in range(0, 64, 8):
        left = n[own] - k
        other = ((eights[0][x_start[own] + k] ^ eights[1][y_start[own] + k]) & _MASKS[np.minimum(left, 8)]) != 0
        same[own[other]] = False
        own = own[~other & (left > 8)]
    for i in own.tolist():
        same[i] = np.array_equal(x[x_start[i] + 64 : x_end[i]], y[y_start[i] + 64 : y_end[i]])
    return same


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def parts_of(raw: np.ndarray, ends: np.ndarray, power: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the parts between spaces, line feeds and text ends; ends: where each text ends."""
    n = len(raw)
    gap = (raw == 32) | (raw == 10)
    edge = np.zeros(n + 1, bool)
    edge[ends] = True
    first = np.ones(n, bool)
    first[1:] = gap[:-1] | edge[1:n]
    start = np.nonzero(first & ~gap)[0]
    last = np.ones(n, bool)
    last[:-1] = gap[1:] | edge[1:n]
    end = np.nonzero(last & ~gap)[0] + 1
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n], out=prefix[1:])
    h = (prefix[end] - prefix[start]) * inverse[start]
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return start, end, h ^ h >> np.uint64(29)


def word_encoder(vocabulary: bytes, limit: int = 1_000_000) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]:
    """Encodes UTF-8 texts with the tokenizers library: (ids one after another, count of each text).

    The vocabulary's normalizer and pre-tokenizer treat a space or line feed only as an end of words, so a
    text's ids are those of its parts between them, in order; each distinct part is encoded once a worker
    (within the bound of its table) and found by its hash, then compared byte by byte: a part that only shares the
    hash of another is encoded by itself. Parts of Latin letters, which are one pre-token each
    whatever their case, are encoded many at a time in one text and told apart by the tokens that end a word; a
    run of signs after such a part is a part of its own.
    """

    def load() -> tuple:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_buffer(vocabulary)
        ends = np.zeros(tokenizer.get_vocab_size(), bool)
        ends[[i for t, i in tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        return tokenizer, ends, WordIds(limit)

    tokenizer, ends, table = worker_cache(("tokens", zlib.crc32(vocabulary)), load)
    power: list[np.ndarray] = []

    def single(parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def plain(words: list[str]) -> list[bytes]:
        """Ids of lower-case parts of Latin letters."""
        out: list[bytes] = []
        for a in range(0, len(words), 4000):
            some = words[a : a + 4000]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            at = np.nonzero(ends[ids])[0] + 1
            if len(at) != len(some) or at[-1] != len(ids):
                out += single(some)
                continue
            raw, cut = ids.tobytes(), (4 * at).tolist()
            out += [raw[x:y] for x, y in zip([0, *cut], cut)]
        return out

    def learn(parts: list[str]) -> list[bytes]:
        words = [p.rstrip(SIGNS) for p in parts]
        easy = [w.isalpha() and (w.isascii() or max(w) < "\u0130") for w in words]
        low = list({w.lower() for w, e in zip(words, easy) if e})
        known = dict(zip(low, plain(low))) if low else {}
        signs = list({p[len(w) :] for p, w, e in zip(parts, words, easy) if e})
        after = dict(zip(signs, single(signs)))
        rest = iter(single([p for p, e in zip(parts, easy) if not e]))
        return [known[w.lower()] + after[p[len(w) :]] if e else next(rest) for p, w, e in zip(parts, words, easy)]

    def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        joined = b"".join(texts)
        text_ends = np.cumsum([len(x) for x in texts])
        raw = np.frombuffer(joined, np.uint8)
        if not len(raw):
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        if not power or len(power[0]) <= len(raw):
            power[:] = [powers(_MULTIPLIER, len(raw)), powers(_INVERSE, len(raw))]
        start, end, h = parts_of(raw, text_ends, *power)
        codes, kinds = pd.factorize(h)
        if table.n + len(kinds) > table.limit:
            table.clear()
        # any place of each kind: the codes are numbered by first use
        where = np.empty(len(kinds), np.int64)
        where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        slots = table.find(kinds)
        known = slots >= 0
        known[known] = table.holds(slots[known], raw, start[where[known]], end[where[known]])
        new = np.nonzero(slots < 0)[0]
        if len(new):
            at = where[new]
            parts = [joined[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())]
            slots[new] = table.add(kinds[new], parts, learn([p.decode("utf-8") for p in parts]))
            known[new] = True
        slot = slots[codes]
        # parts that aren't their kind's, or whose kind isn't the table's
        odd = ~(known[codes] & same_bytes(raw, start[where][codes], end[where][codes], raw, start, end))
        if odd.any():
            at = np.nonzero(odd)[0]
            parts = [joined[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())]
            own = list(dict.fromkeys(parts))
            of = dict(zip(own, table.add(None, own, learn([p.decode("utf-8") for p in own])).tolist()))
            slot[at] = [of[p] for p in parts]
        ids, n = table.gather(slot)
        owner = np.searchsorted(start, np.r_[0, text_ends])  # parts before each text
        before = np.r_[0, np.cumsum(n)]
        return ids, np.diff(before[owner])

    return encode


def write_tokens(docs: DataFrame, path: str, vocabulary: bytes, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, encoding: str = "dictionary", row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10) -> None:
    """Write the files. encoding: ``dictionary``, or ``delta`` (Parquet v2 pages without dictionaries)."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(encoding)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, start = word_encoder(sent.value), TaskContext.get().partitionId(), 0
        for piece in pieces(batches, text_col, 2 << 20):
            ids, n = encode([x or b"" for x in bytes_of(piece, text_col)])
            ids = np.insert(ids, np.cumsum(n), end_id)
            n = n + 1
            ends = np.cumsum(n)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids.astype("<i4", copy=False)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), shard, np.int32)), column_of(piece, id_col), pa.array(start + ends - n), pa.array(n), lists], names=["shard", id_col, "shard_start", "n_tokens", "token_ids"])
            start += int(ends[-1])

    rows = docs.select(id_col, text_col).repartitionByRange(F.col(id_col).asc_nulls_first(), F.xxhash64(text_col)).sortWithinPartitions(F.col(id_col).asc_nulls_first(), F.xxhash64(text_col))
    out = rows.mapInArrow(run, f"shard int, `{id_col}` {kind}, shard_start long, n_tokens long, token_ids array<int>")
    delta = encoding == "delta"
    (out.write.option("compression", "zstd").option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes).option("parquet.enable.dictionary", str(not delta).lower())
        .option("parquet.writer.version", "v2" if delta else "v1").parquet(path))


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, token_ids): start is the number of ids of all documents before it.

    Offsets of the shards come from the files' metadata columns alone; there is one row for each file.
    """
    files = spark.read.parquet(path)
    sums = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("shard").alias("__shard"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    # a row a file: broadcast within a bound of files, so that the ids aren't shuffled
    few = len(sums.select("shard").take(FILES + 1)) <= FILES
    return files.join(F.broadcast(offsets) if few else offsets, F.col("shard") == F.col("__shard")).select(id_col, (F.col("__base") + F.col("shard_start")).alias("start"), "n_tokens", "token_ids")


def token_digest(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of what read_tokens gives."""
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "token_ids"):
            lists = column_of(piece, "token_ids")
            ids = np.asarray(lists.values).astype("<u4", copy=False)
            at = np.asarray(lists.offsets)
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
            n = at[1:] - at[:-1]
            yield pa.RecordBatch.from_arrays([column_of(piece, id_col), column_of(piece, "start"), pa.array(n.astype(np.int64)), pa.array(crc, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    return tokens.select(id_col, "start", "token_ids").mapInArrow(run, f"`{id_col}` {kind}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary_path: str, **options) -> DataFrame:
    """Write the token files to the shared folder and read their digest."""
    path = shared_dir(docs.sparkSession)
    write_tokens(docs, path, read_file(vocabulary_path), **options)
    id_col = options.get("id_col", "doc_id")
    return token_digest(read_tokens(docs.sparkSession, path, id_col), id_col)
