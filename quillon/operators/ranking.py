"""Ranking stages over (query_id, id, ...) tables: fusion, dependency boost, filters, final combination."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import scoring, text
from quillon.functions.scoring import RerankWeights
from quillon.operators.lexical import pool_scores
from quillon.operators.storage import fits

POOL = 500


def fuse(left: DataFrame, right: DataFrame) -> DataFrame:
    """(query_id, id, fused, fused_rank): reciprocal ranks of two score tables, summed."""
    every = Window.partitionBy("query_id")
    sides = []
    for name, side in (("l", left), ("r", right)):
        sides.append(side.select("query_id", "id", scoring.rank_by(F.col("score"), "id").alias(f"rank_{name}")))
    met = sides[0].join(sides[1], ["query_id", "id"], "full_outer")
    # a side's length is how many of the joined rows have its rank
    met = met.withColumns({"n_l": F.count("rank_l").over(every), "n_r": F.count("rank_r").over(every)})
    fused = scoring.reciprocal_sum(F.col("rank_l"), F.col("n_l"), F.col("rank_r"), F.col("n_r"))
    out = met.select("query_id", "id", fused.alias("fused"))
    return out.withColumn("fused_rank", scoring.rank_by(F.col("fused"), "id"))


def dependents(pool: DataFrame) -> DataFrame:
    """(query_id, name, dependents) for each name of a pool (query_id, name, dependencies): how often the pool's rows name it."""
    names = pool.where("name is not null").select("query_id", "name").distinct()
    named = pool.select("query_id", F.explode("dependencies").alias("name")).groupBy("query_id", "name").agg(F.count(F.lit(1)).alias("dependents"))
    return names.join(named, ["query_id", "name"], "left").withColumn("dependents", F.coalesce("dependents", F.lit(0)))


def boost(fused: DataFrame, declarations: DataFrame, pool_size: int = POOL, few: bool | None = None) -> DataFrame:
    """The pool's rows with their declaration's columns, boosted score and rank; ids without a declaration keep a score.

    few: whether the pools, pool_size rows a query, are broadcast to pick the declarations where they lie; None counts them.
    """
    pool = fused.where(F.col("fused_rank") <= pool_size)
    wanted = pool.select("id").distinct()
    picked = declarations.join(F.broadcast(wanted) if (fits(wanted, POOL * 1000) if few is None else few) else wanted, "id", "left_semi")
    rows = pool.join(picked, "id", "left")
    counted = rows.join(dependents(rows), ["query_id", "name"], "left").withColumn("dependents", F.coalesce("dependents", F.lit(0)))
    most = F.max("dependents").over(Window.partitionBy("query_id"))
    place = scoring.dependency_rank(F.col("dependents"), most, pool_size)
    out = counted.withColumn("boosted", 1 / F.col("fused_rank") + 1 / place)
    return out.withColumn("boosted_rank", scoring.rank_by(F.col("boosted"), "fused_rank")).withColumnRenamed("dependents", "pool_dependents")


def in_packages(rows: DataFrame, packages: Sequence[str] | None) -> DataFrame:
    """After the pool and the boost, so a filtered search may give fewer rows than there are."""
    return rows.where(text.package_name(F.col("module")).isin(list(packages))) if packages else rows


def candidates(boosted: DataFrame, size: int) -> DataFrame:
    """The best ``size`` rows of what is left, those without a declaration dropped after the cut."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("boosted_rank"))
    return boosted.withColumn("__place", place).where(F.col("__place") <= size).drop("__place").where("name is not null")


def word_overlap(query: Column, document: Column) -> Column:
    """The default pair score: the share of the query's distinct words that the document has."""
    asked = F.array_distinct(text.tokenize_words(query))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, text.tokenize_words(document))) / F.size(asked)).otherwise(0.0)


def rerank(pool: DataFrame, *, pair_score: Callable[[Column, Column], Column] = word_overlap, fuzzy: Callable[[Column, Column], Column] | None = None, weights: RerankWeights = RerankWeights()) -> DataFrame:
    """pool (query_id, query, id, name, informalization, dependencies, boosted_rank, ...) with ``final`` and ``final_rank``.

    fuzzy: the name similarity; None leaves its part out (and Python out of the plan).
    """
    every = Window.partitionBy("query_id")
    shown = F.when(F.coalesce(F.col("informalization"), F.lit("")) != "", F.col("informalization")).otherwise(F.col("name"))
    rows = pool.withColumn("pair_score", pair_score(F.col("query"), text.rerank_document(F.col("name"), F.col("informalization"))))
    rows = rows.join(pool_scores(pool, text.tokenize_words(shown), text.tokenize_words(F.col("query"))), ["query_id", "id"])
    rows = rows.join(dependents(pool), ["query_id", "name"])
    rows = rows.withColumn("fuzzy", fuzzy(F.col("query"), F.col("name")) if fuzzy else F.lit(0.0))
    parts = [scoring.normalized(F.col("pair_score"), every), scoring.normalized(F.col("text_score"), every), scoring.log_normalized(F.col("dependents"), every)]
    rows = rows.withColumn("final", scoring.combined(weights, *parts, F.col("fuzzy"), scoring.normalized(F.col("fuzzy"), every)))
    return rows.withColumn("final_rank", scoring.rank_by(F.col("final"), "boosted_rank"))


def visible(ranked: DataFrame, rank: str, limit: int) -> DataFrame:
    """Generated names hidden, then the first ``limit`` of each query, with their position."""
    shown = ranked.where(~text.is_autogenerated(F.col("name")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(rank))
    return shown.withColumn("position", place).where(F.col("position") <= limit)
