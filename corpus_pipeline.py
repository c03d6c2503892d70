"""The training-data pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Quality classifier, line dedup, near-duplicate removal, benchmark decontamination, byte-level BPE. A stage works on all
that the one before kept. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import byte_bpe, decontamination, line_dedup, near_dedup
from quillon.llm import quality as quality_model
from quillon.llm.common import checkpoint, table


def shielded(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """The table with all columns but id and text renamed, so that none clashes with a stage's own, and how to name them back."""
    names = {c: c if c in ("doc_id", "text") else f"__c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), [F.col(n).alias(c) for c, n in names.items()]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled ones vote for."""
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    rows, back = shielded(docs)
    return quality_model.predict(rows, model, keep=tuple(rows.columns)).where("predicted = 1").select(back)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines (``n_chars``, if it is there, follows); documents that lose their last line with words go."""
    rows, back = shielded(docs)
    whole = F.size("__gone") == 0
    out = line_dedup.dedup_lines(rows, removed_col="__gone").where(whole | (F.trim(F.replace("text", F.lit("\n"), F.lit(" "))) != ""))
    back = [F.when(whole, c).otherwise(F.length("text")).alias("n_chars") if n == "n_chars" else c for n, c in zip(docs.columns, back)]
    return out.select(back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, linked from a similarity of 0.8 on: the one of the least id."""
    kept = near_dedup.near_duplicates(docs, percent=80).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated."""
    rows, back = shielded(docs)
    found = decontamination.decontaminate(rows, table(spark, sf_dir, "benchmark"), keep=tuple(rows.columns))
    return found.where(~F.col("contaminated")).select(back)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, token_ids)."""
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("tokens", tokens),
]

#: Nearest-neighbour voting and BPE can't be said in SQL; the stages are tested against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
