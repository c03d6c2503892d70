"""Incremental enrichment: worklists, caches over earlier snapshots, insert-ignore, generation layer by layer."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text
from quillon.operators.graph import layers
from quillon.operators.storage import stored, stored_observed

PROMPT_DEPENDENCIES = 20


def worklist(rows: DataFrame, missing: str, present: str | None = None, limit: int | None = None, id_col: str = "id") -> DataFrame:
    """Rows whose ``missing`` is null (and ``present`` isn't), by id; limit 0 or None: all."""
    out = rows.where(F.col(missing).isNull())
    if present:
        out = out.where(F.col(present).isNotNull())
    return out.orderBy(id_col).limit(limit) if limit else out


def to_embed(rows: DataFrame, source: str, embedding: str) -> DataFrame:
    """Of a worklist, what a model is called for: an empty text is none."""
    return rows.where((F.col(source) != "") & F.col(embedding).isNull())


def first_wins(sources: Sequence[DataFrame], keys: Sequence[str], value: str, seq: str | None = None) -> DataFrame:
    """(keys, value) over caches in order of priority: the first source's first row of each key; null keys and values are left out."""
    numbered = [s.select(*keys, value, F.lit(i).alias("__source"), (F.col(seq) if seq else F.lit(0)).alias("__seq")) for i, s in enumerate(sources)]
    every = reduce(DataFrame.unionByName, numbered)
    for c in (*keys, value):
        every = every.where(F.col(c).isNotNull())
    return every.groupBy(*keys).agg(F.min_by(value, F.struct("__source", "__seq")).alias(value))


def split_by_cache(rows: DataFrame, cache: DataFrame, keys: Sequence[str], value: str) -> tuple[DataFrame, DataFrame]:
    """(hits with the cached value, misses); rows with a null key are in neither. Of a key that the cache has more than once, the least value counts."""
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    cached = cache.groupBy(*keys).agg(F.min(value).alias("cached"))
    return rows.join(cached, list(keys)), rows.join(cached, list(keys), "left_anti")


def apply_values(rows: DataFrame, values: DataFrame, keys: Sequence[str], target: str, value: str) -> DataFrame:
    """The next snapshot: the target filled from the values where it is null. Of a key with several values the least one counts, so no row is doubled."""
    own = values.groupBy(*keys).agg(F.min(value).alias("__value"))
    return rows.join(own, list(keys), "left").withColumn(target, F.coalesce(target, "__value")).drop("__value").select(rows.columns)


def insert_ignore(target: DataFrame, batch: DataFrame, key: str = "name", order: str = "seq") -> DataFrame:
    """Rows of the batch that are new: the first of each key, where the target has none."""
    first = batch.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")
    return first.join(target.select(key), key, "left_anti")


def batches(rows: DataFrame, size: int, order: str = "id") -> DataFrame:
    """Rows with batch numbers from 0, ``size`` rows each, in order.

    The sorted rows are written once, each with its partition and place, so that every later step sees the same ones; counts
    of the partitions, one row each, give each partition's first number. There is no global window over rows.
    """
    if size < 1:
        raise ValueError("a batch has one row at least")
    placed = stored(rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("__place", F.monotonically_increasing_id()))
    part, at = F.shiftright("__place", 33), F.col("__place").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__k"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("__part"), F.coalesce(F.sum("__k").over(before), F.lit(0)).alias("__start"))
    met = placed.join(F.broadcast(starts), part == F.col("__part"))
    return met.withColumn("batch", F.floor((F.col("__start") + at) / size).cast("long")).select(*rows.columns, "batch")


def described_dependencies(rows: DataFrame, texts: DataFrame, most: int = PROMPT_DEPENDENCIES) -> DataFrame:
    """(name, pairs): of a row's first dependencies the (name, text) structs of those with a text, in order."""
    asked = rows.select("name", F.posexplode(F.slice("dependencies", 1, most)).alias("pos", "dep"))
    met = asked.join(texts.select(F.col("name").alias("dep"), F.col("text").alias("dep_text")).where("dep_text is not null"), "dep")
    found = met.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("pos", F.col("dep").alias("name"), F.col("dep_text").alias("text")))).alias("pairs"))
    return found.select("name", F.transform("pairs", lambda p: F.struct(p["name"].alias("name"), p["text"].alias("text"))).alias("pairs"))


def prompts(rows: DataFrame, texts: DataFrame, template: str) -> DataFrame:
    """rows (name, source_text, docstring, dependencies) with ``prompt``."""
    met = rows.join(described_dependencies(rows, texts), "name", "left")
    pairs = F.coalesce("pairs", F.array().cast("array<struct<name:string,text:string>>"))
    return met.withColumn("prompt", text.prompt(template, F.col("name"), F.col("source_text"), F.col("docstring"), text.dependency_lines(pairs))).drop("pairs")


def generate_in_layers(rows: DataFrame, template: str, generate: Callable[[Column], Column], target: str = "informalization", report: Callable[[int, dict], None] | None = None) -> DataFrame:
    """Fill null targets, dependencies before what depends on them; ``generate`` maps a prompt column to a text column.

    A layer is one job whose result is written before the next one starts, so that a failure costs one layer. report gets each
    layer's number and the count of its filled texts, which that job tells.
    """
    todo = rows.where(F.col(target).isNull())
    order = stored(layers(todo.select("name", F.coalesce("dependencies", F.array().cast("array<string>")).alias("dependencies"))))
    last = order.agg(F.max("layer")).first()[0] or 0
    texts = stored(rows.where(F.col(target).isNotNull()).select("name", F.col(target).alias("text")))
    made = None
    for layer in range(1, last + 1):
        own = todo.join(order.where(F.col("layer") == layer).select("name"), "name", "left_semi")
        answers = prompts(own, texts, template).select("name", text.trimmed(generate(F.col("prompt"))).alias("text")).where("text is not null")
        new, told = stored_observed(answers, filled=F.count(F.lit(1)))
        if report:
            report(layer, told)
        texts = texts.unionByName(new)
        made = new if made is None else made.unionByName(new)
    return apply_values(rows, made, ["name"], target, "text") if made is not None else rows


def layer_totals(rows: DataFrame, order: DataFrame, target: str) -> DataFrame:
    """(layer, rows, filled) of each layer."""
    return rows.join(order, "name").groupBy("layer").agg(F.count(F.lit(1)).alias("rows"), F.count(target).alias("filled"))
