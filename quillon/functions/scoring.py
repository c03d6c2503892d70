"""Score arithmetic over columns and over windows of one query's candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def query_window(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or ("query_id",)))


def rank_by(score: Column, *ties: str, keys: tuple[str, ...] = ("query_id",)) -> Column:
    """1-based position by descending score; ties go by the given columns, ascending."""
    return F.row_number().over(query_window(*keys).orderBy(score.desc(), *(F.col(t).asc() for t in ties)))


def reciprocal_sum(left: Column, n_left: Column, right: Column, n_right: Column) -> Column:
    """Two reciprocal ranks; a missing one is that of the place after the ranking's last."""
    return 1 / F.coalesce(left, n_left + 1) + 1 / F.coalesce(right, n_right + 1)


def dependency_rank(count: Column, most: Column, pool_size: int) -> Column:
    """The most depended-on is first; without any dependents, one after the last (or after the whole pool)."""
    last = F.when(most > 0, most + 1).otherwise(F.lit(pool_size + 1))
    return F.when(count > 0, most - count + 1).otherwise(last)


def normalized(score: Column, window: WindowSpec) -> Column:
    """Min-max over the window; if all are equal, 1 for a positive score and 0 for others."""
    low, high = F.min(score).over(window), F.max(score).over(window)
    flat = F.when(high > 1e-9, 1.0).otherwise(0.0)
    return F.when(high - low < 1e-9, flat).otherwise((score - low) / F.when(high > low, high - low))


def log_normalized(count: Column, window: WindowSpec) -> Column:
    most = F.max(count).over(window)
    return F.when(most > 0, F.log1p(count) / F.log1p(most)).otherwise(0.0)


def two_class_probability(true_logit: Column, false_logit: Column) -> Column:
    return 1 / (1 + F.exp(false_logit - true_logit))


@dataclass(frozen=True)
class RerankWeights:
    """Weights of a candidate's final score; a name similarity under the threshold adds nothing."""

    reranker: float = 1.0
    text: float = 0.4
    dependency: float = 0.2
    fuzzy_name: float = 1.0
    fuzzy_threshold: float = 0.7


def combined(weights: RerankWeights, reranker: Column, text: Column, dependency: Column, fuzzy: Column, fuzzy_normalized: Column) -> Column:
    base = weights.reranker * reranker + weights.text * text + weights.dependency * dependency
    return base + F.when(fuzzy >= weights.fuzzy_threshold, weights.fuzzy_name * fuzzy_normalized).otherwise(0.0)
