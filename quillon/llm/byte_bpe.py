"""Byte-level BPE over a corpus by a global shuffle of distinct words.

1. Blocks: each task splits its documents into pre-tokens and gathers them into blocks of a bounded number of bytes. A
   block is one row: its document ids, the positions of its pre-tokens (numbers of distinct words, in document order) and
   its distinct words. The blocks are written to the shared folder once, so all that follows sees the same numbers,
   whatever executors are lost.
2. Words: a block's distinct words are dealt by their hash into packets of (bucket, block), which are shuffled by bucket. All
   uses of a distinct word of the corpus meet in one bucket, where it is encoded once and its ids go into every packet that
   has it. Buckets are as many as make ``BUCKET_WORDS`` words each; packets without words aren't made, so there are never more
   of them than distinct words of blocks. A task holds a bucket's packets: one a block for a word that every block has, so
   beyond some terabytes, at 32 MB a block, such a bucket has more than ``BUCKET_WORDS`` words.
3. Join back: the ids return to their block, and the documents are put together by position. Decoding looks every id up
   in the token-byte table, which has one row for each entry of the vocabulary.

A hot word has one entry a block, not one a use, and a block is bounded by its bytes (a longer text is a block of its own).

Defined results: a null or empty text has no ids; repeated rows are each encoded; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bytes_of, checkpoint, column_of, drop_caches, pieces, read_file, record, texts_of, worker_cache

#: Bytes of text in a block, about.
BLOCK_BYTES = 32 << 20
#: Distinct words of blocks in a bucket, about, and buckets of a task.
BUCKET_WORDS, TASK_BUCKETS = 125_000, 4


def load_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file's tokens: base64 and rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def splitter(pattern: str):
    """The pattern for the regex library; its white space is what the ranks' own library takes as white space."""
    import regex

    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def piece_encoder(ranks: bytes, pattern: str):
    """Encodes one pre-token to ids; kept between tasks."""

    def make():
        import tiktoken

        encoding = tiktoken.Encoding("quillon", pat_str=pattern, mergeable_ranks=load_ranks(ranks), special_tokens={})
        return encoding.encode_ordinary

    return worker_cache(("pieces", zlib.crc32(ranks)), make)


def _pack(*arrays: np.ndarray) -> bytes:
    """zstd of the arrays' bytes, lowest bytes first, so that like bytes stand together."""
    planes = []
    for a in arrays:
        a = np.ascontiguousarray(a, "<u4")
        planes += [np.array([len(a)], "<u4").tobytes(), a.view(np.uint8).reshape(-1, 4).T.tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(planes))


def _unpack(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 4], "little")
        out.append(np.frombuffer(raw, np.uint8, 4 * n, at + 4).reshape(4, n).T.copy().view("<u4").ravel())
        at += 4 + 4 * n
    return out


def _pack_ranks(ranks: np.ndarray) -> bytes:
    """Frequency ranks, most of them small: a byte each, and two or four more bytes for ranks of 240 and more."""
    big = ranks >= 240
    head = np.where(big, 240 + (ranks >> 16 > 0), ranks).astype(np.uint8)
    rest = ranks[big]
    streams = [head, (rest & 255).astype(np.uint8), (rest >> 8 & 255).astype(np.uint8), (rest[rest >> 16 > 0] >> 16).astype("<u2")]
    done = [zstandard.compress(x.tobytes(), 3) for x in streams]
    return b"".join(len(x).to_bytes(4, "little") + x for x in done)


def _unpack_ranks(data: bytes) -> np.ndarray:
    streams, at = [], 0
    for kind in (np.uint8, np.uint8, np.uint8, "<u2"):
        n = int.from_bytes(data[at : at + 4], "little")
        streams.append(np.frombuffer(zstandard.decompress(data[at + 4 : at + 4 + n]), kind))
        at += 4 + n
    head, low, high, more = streams
    out = head.astype(np.uint32)
    big = np.nonzero(head >= 240)[0]
    out[big] = low | high.astype(np.uint32) << 8
    out[np.nonzero(head == 241)[0]] |= more.astype(np.uint32) << 16
    return out


class _Block:
    """Documents of a block in the making."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.flat: list[np.ndarray] = []
        self.ids: list[pa.Array] = []
        self.bytes = 0

    def add(self, tokens: list[str], n_bytes: int) -> None:
        numbers = self.numbers
        own = np.array([numbers.setdefault(t, len(numbers)) for t in tokens], np.uint32)
        self.flat.append(own)
        self.bytes += n_bytes

    def row(self) -> tuple[bytes, bytes, bytes, int]:
        """(lengths, positions, words, number of words): a word's number is its rank by uses in the block."""
        flat = np.concatenate(self.flat) if self.flat else np.zeros(0, np.uint32)
        words = [w.encode("utf-8") for w in self.numbers]
        common = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[common] = np.arange(len(words))
        return _pack(np.array([len(x) for x in self.flat], np.uint32)), _pack_ranks(rank[flat]), _packed_words(np.arange(len(words)), [words[i] for i in common]), len(words)


def _packed_words(numbers: np.ndarray, words: list[bytes]) -> bytes:
    head = _pack(np.diff(numbers, prepend=0), np.array([len(w) for w in words], np.uint32))
    return len(head).to_bytes(4, "little") + head + zstandard.compress(b"".join(words), 3)


def _words_of(packed: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Ascending numbers within the block, and the words."""
    n = int.from_bytes(packed[:4], "little")
    step, lengths = _unpack(packed[4 : 4 + n])
    raw = zstandard.ZstdDecompressor().decompress(packed[4 + n :])
    ends = np.cumsum(lengths).tolist()
    return np.cumsum(step), [raw[a:b] for a, b in zip([0, *ends], ends)]


def blocks_of(docs: DataFrame, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, ids, lengths, positions, words, n_words): step 1, not yet written."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        drop_caches()
        find, number = splitter(pattern).findall, TaskContext.get().partitionId() << 32

        def close(block: _Block) -> pa.RecordBatch:
            ids = pa.concat_arrays(block.ids)
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            *packed, n = block.row()
            return pa.RecordBatch.from_arrays([pa.array([number]), lists, *(pa.array([x], pa.binary()) for x in packed), pa.array([n])], names=["block", "ids", "lengths", "positions", "words", "n_words"])

        block = _Block()
        for piece in pieces(batches, text_col, min(block_bytes, 4 << 20)):
            for text in texts_of(piece, text_col):
                block.add(find(text) if text else [], len(text or ""))
            block.ids.append(column_of(piece, id_col))
            if block.bytes >= block_bytes:
                yield close(block)
                block, number = _Block(), number + 1
        if block.ids:
            yield close(block)

    return docs.select(id_col, text_col).mapInArrow(run, f"block long, ids array<{kind}>, lengths binary, positions binary, words binary, n_words long")


def packets(blocks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, packed): the words of each block, dealt by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "words", 1):
            numbers, words = _words_of(column_of(piece, "words")[0].as_py())
            bucket = np.array([zlib.crc32(w) % buckets for w in words], np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            cut = np.r_[0, np.nonzero(np.diff(bucket))[0] + 1, len(bucket)] if len(bucket) else np.zeros(1, np.int64)
            packed = [_packed_words(numbers[order[a:b]], [words[i] for i in order[a:b]]) for a, b in zip(cut[:-1], cut[1:])]
            block = column_of(piece, "block").take(pa.array(np.zeros(len(packed), np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]]), block, pa.array(packed, pa.binary())], names=["bucket", "block", "packed"])

    return blocks.select("block", "words").mapInArrow(run, "bucket long, block long, packed binary")


def encode_words(blocks: DataFrame, ranks: bytes, pattern: str, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """(block, coded): step 2; coded holds numbers of a block's words, their counts of ids, and the ids."""
    spark = blocks.sparkSession
    sent = spark.sparkContext.broadcast(ranks)

    def coded(group: pa.Table) -> pa.Table:
        encode = piece_encoder(sent.value, pattern)
        found = [_words_of(x.as_py()) for x in group["packed"]]
        ids = {w: np.array(encode(w.decode("utf-8")), "<u4").tobytes() for w in set().union(*(words for _, words in found))}
        out = []
        for numbers, words in found:
            own = list(map(ids.__getitem__, words))
            out.append(_pack(np.diff(numbers, prepend=0), np.array([len(x) // 4 for x in own], np.uint32), np.frombuffer(b"".join(own), "<u4")))
        return pa.table([group["block"], pa.array(out, pa.binary())], names=["block", "coded"])

    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(1, -(-total // bucket_words))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-buckets // TASK_BUCKETS))
    dealt = packets(blocks, max(buckets, tasks)).repartition(tasks, "bucket")
    return dealt.groupBy("bucket").applyInArrow(coded, "block long, coded binary")


class Coded:
    """A block's words by number: ids, their decimal text, and what they decode to by the token-byte table."""

    def __init__(self, rows: list[bytes], token_bytes: list[bytes]) -> None:
        found = [_unpack(x) for x in rows]
        numbers = np.concatenate([np.cumsum(f[0]) for f in found]) if found else np.zeros(0, np.int64)
        counts = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        ids = np.concatenate([f[2] for f in found]) if found else np.zeros(0, np.uint32)
        order = np.argsort(numbers, kind="stable")
        if not np.array_equal(numbers[order], np.arange(len(numbers))):
            raise RuntimeError("words of a block are missing or come twice")
        ends = np.cumsum(counts)
        self.counts = counts[order].astype(np.int64)
        self.starts = (ends - counts)[order].astype(np.int64)
        self.flat = ids
        lists = [ids[a : a + n].tolist() for a, n in zip(self.starts.tolist(), self.counts.tolist())]
        self.bytes = [b"".join(map(token_bytes.__getitem__, x)) for x in lists]
        self.texts = [b"".join([b"%d," % i for i in x]) for x in lists]

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        """Ids of words one after another."""
        n = self.counts[numbers]
        at = np.repeat((self.starts[numbers] - np.r_[0, np.cumsum(n)[:-1]]), n)
        at += np.arange(len(at))
        return self.flat[at]


def token_byte_table(ranks: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, with_ids: bool = True) -> DataFrame:
    """(id, [token_ids], n_tokens, ids_sha256, decoded_sha256) of every whole text."""
    spark = docs.sparkSession
    ranks = read_file(ranks_path)
    blocks = checkpoint(blocks_of(docs, pattern, id_col=id_col, text_col=text_col, block_bytes=block_bytes))
    none = F.lit(None)
    rows = blocks.select("block", "ids", "lengths", "positions", none.cast("binary").alias("coded")).unionByName(encode_words(blocks, ranks, pattern).select("block", none.cast(blocks.schema["ids"].dataType).alias("ids"), none.cast("binary").alias("lengths"), none.cast("binary").alias("positions"), "coded"))
    sent = spark.sparkContext.broadcast(ranks)
    kind = docs.schema[id_col].dataType.simpleString()

    def assemble(group: pa.Table) -> pa.Table:
        table = _token_bytes(sent.value)
        positions = [x for x in group["positions"].to_pylist() if x is not None]
        if len(positions) != 1:
            raise RuntimeError("a block must have one row of positions")
        coded = Coded([x for x in group["coded"].to_pylist() if x is not None], table)
        ids = next(x.values for x in group["ids"].drop_null().chunks if len(x))
        lengths, flat = _unpack(group["lengths"].drop_null()[0].as_py())[0], _unpack_ranks(positions[0])
        n, sha, decoded, lists, at = [], [], [], [], 0
        for length in lengths.tolist():
            own = flat[at : at + length]
            at += length
            numbers = own.tolist()
            n.append(int(coded.counts[own].sum()))
            sha.append(hashlib.sha256(b"".join(map(coded.texts.__getitem__, numbers))[:-1]).hexdigest())
            decoded.append(hashlib.sha256(b"".join(map(coded.bytes.__getitem__, numbers))).hexdigest())
            if with_ids:
                lists.append(coded.gather(own).astype(np.int32))
        out = record(n_tokens=(n, pa.int64()), ids_sha256=(sha, pa.string()), decoded_sha256=(decoded, pa.string()))
        columns, names = [ids, *out.columns], [id_col, *out.schema.names]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(np.concatenate(lists))))
            names.append("token_ids")
        return pa.table(columns, names=names)

    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks.count())
    return rows.repartition(tasks, "block").groupBy("block").applyInArrow(assemble, schema)


def _token_bytes(ranks: bytes) -> list[bytes]:
    return worker_cache(("token bytes", zlib.crc32(ranks)), lambda: token_byte_table(load_ranks(ranks)))


def decode_documents(tokens: DataFrame, ranks_path: str, *, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(id, decoded): the bytes of each row's ids, by the token-byte table; an unknown id fails the task."""
    sent = tokens.sparkSession.sparkContext.broadcast(read_file(ranks_path))
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _token_bytes(sent.value)
        for piece in pieces(batches, ids_col):
            lists = column_of(piece, ids_col).to_pylist()
            yield pa.RecordBatch.from_arrays([column_of(piece, id_col), pa.array([b"".join(map(table.__getitem__, x or ())) for x in lists], pa.binary())], names=[id_col, "decoded"])

    return tokens.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, decoded binary")

