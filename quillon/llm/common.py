"""What the operators of this subpackage share: table access, Arrow plumbing, shared storage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into Python objects at a time.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which every executor reaches.

    Where the setting is unset and the session is a local one, as in tests, it is a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "quillon-checkpoints")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def checkpoint(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back.

    narrow: the rows are small next to the documents, so two files a core are enough, whatever the number of partitions.
    """
    path = shared_dir(df.sparkSession)
    if narrow:
        df = df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reliable(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder that keeps the partitions as they are, and their order."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def pieces(batches: Iterator[pa.RecordBatch], column: str | None = None, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Split batches so that a piece's text column stays near ``limit`` bytes; a longer text is a piece of its own."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        size = batch.nbytes if column is None else batch.column(batch.schema.get_field_index(column)).nbytes
        step = max(1, min(n, int(n * limit / max(1, size))))
        for i in range(0, n, step):
            yield batch.slice(i, step)


def texts_of(piece: pa.RecordBatch, column: str) -> list[str | None]:
    return piece.column(piece.schema.get_field_index(column)).to_pylist()


def bytes_of(piece: pa.RecordBatch, column: str) -> list[bytes | None]:
    return piece.column(piece.schema.get_field_index(column)).cast(pa.large_binary()).to_pylist()


def column_of(piece: pa.RecordBatch, name: str) -> pa.Array:
    return piece.column(piece.schema.get_field_index(name))


def map_pieces(df: DataFrame, column: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, limit: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow with a per-task setup: ``make()`` is called once a task and gives the piece function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for piece in pieces(batches, column, limit):
            out = fn(piece)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def record(**columns: tuple) -> pa.RecordBatch:
    """A record batch from name=(values, type)."""
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in columns.values()], names=list(columns))


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Memo:
    """A dict of two generations: bounded, and what is used keeps its place."""

    def __init__(self, limit: int = 400_000) -> None:
        self.new: dict = {}
        self.old: dict = {}
        self.limit = limit

    def missing(self, keys: set) -> list:
        """The keys to compute; afterwards all others are in ``new``."""
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        todo = []
        old, new = self.old, self.new
        for k in keys - new.keys():
            v = old.get(k)
            if v is None:
                todo.append(k)
            else:
                new[k] = v
        return todo


def sample_rows(df: DataFrame, key: Column, rows: int, seed: int = 7) -> DataFrame:
    """About ``rows`` rows at most, chosen by a hash of the key, so that a rerun chooses the same ones."""
    total = df.count()
    if total <= rows:
        return df
    part = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 20))
    return df.where(part < int(rows / total * (1 << 20)))


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, rows: int, held_out: Column) -> DataFrame:
    """(text, label, order) of about ``rows`` labelled rows outside the held-out part; the ids choose rows, and go no further.

    order: a hash of the text, by which a fit sorts what it gathers, so that it doesn't depend on the partitions.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label).cast("int")).alias("__label"))
    known = sample_rows(known.where(~held_out), F.col(id_col), rows)
    return docs.where(F.col(text_col).isNotNull()).select(id_col, text_col).join(known, id_col).select(F.col(text_col).alias("text"), "__label", F.sha2(text_col, 256).alias("__order"))


_cached: dict = {}


def worker_cache(key, make: Callable):
    """What a Python worker keeps between tasks: one value at a time, so that stages don't add up their memory."""
    if key not in _cached:
        drop_caches()
        _cached[key] = make()
    return _cached[key]


def drop_caches() -> None:
    if _cached:
        _cached.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # glibc keeps freed memory otherwise
            ctypes.CDLL("libc.so.6").malloc_trim(0)
