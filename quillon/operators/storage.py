"""Cutting lineage through the folder that all executors share, and bounded broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def checkpoint_root(df: DataFrame) -> str:
    """spark.checkpoint.dir; where it is unset in a local session, as in tests, a temporary folder."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "quillon-checkpoints")
    return root.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read back."""
    path = f"{checkpoint_root(df)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """``stored``, and aggregates of the rows that the same job computes while it writes; no second pass."""
    seen = Observation()
    out = stored(df.observe(seen, *[c.alias(name) for name, c in metrics.items()]))
    return out, seen.get


def fits(df: DataFrame, rows: int = 100_000) -> bool:
    """Whether the table has no more rows than the bound; no more than that are looked at."""
    return len(df.select(F.lit(1)).take(rows + 1)) <= rows


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Broadcast a table of no more rows than the bound; a larger one is left to the planner's shuffled join."""
    return F.broadcast(df) if fits(df, rows) else df


_KEPT: dict[tuple, str] = {}


def kept_path(name: str, source: DataFrame, save: Callable[[str], None]) -> str:
    """The folder of what ``save`` writes from a table of files: written once a session while the files are the same."""
    files = source.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().collect()
    key = (name, source.sparkSession.sparkContext.applicationId, checkpoint_root(source), tuple(sorted(map(tuple, files))))
    if key not in _KEPT:
        path = f"{checkpoint_root(source)}/{uuid.uuid4().hex}"
        save(path)
        _KEPT[key] = path
    return _KEPT[key]
