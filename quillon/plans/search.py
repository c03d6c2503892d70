"""The hybrid search: names by BM25+, texts by vectors, fused, boosted by dependents, filtered and reranked."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text
from quillon.functions.scoring import RerankWeights
from quillon.functions.udfs import fuzzy_name_score
from quillon.operators import lexical, ranking, semantic
from quillon.operators.storage import fits
from quillon.schema import RESULT_COLUMNS


@dataclass
class SearchEngine:
    """Search over declarations (schema.DECLARATION) and their index tables.

    embed maps a query table (query_id, query) to (query_id, embedding); pair_score and fuzzy are column functions.
    """

    declarations: DataFrame
    spaced: lexical.LexicalIndex | None = None  # lookups need no index
    raw: lexical.LexicalIndex | None = None
    vectors: DataFrame | semantic.InvertedLists | None = None
    embed: Callable[[DataFrame], DataFrame] | None = None
    pair_score: Callable[[Column, Column], Column] = ranking.word_overlap
    fuzzy: Callable[[Column, Column], Column] | None = fuzzy_name_score
    weights: RerankWeights = field(default_factory=RerankWeights)

    @classmethod
    def build(cls, declarations: DataFrame, embed: Callable[[DataFrame], DataFrame], inverted: bool = False, **options) -> SearchEngine:
        """Index tables computed from the declarations (save and load them to build once)."""
        name = F.coalesce("name", F.lit(""))
        indices = [lexical.build_index(declarations, f(name), distinct=True) for f in (text.tokenize_spaced, text.tokenize_raw)]
        vectors = declarations.where("informalization_embedding is not null").select("id", F.col("informalization_embedding").alias("embedding"))
        return cls(declarations, *indices, semantic.build_lists(vectors) if inverted else vectors, embed, **options)

    def save(self, path: str) -> None:
        self.spaced.save(f"{path}/spaced")
        self.raw.save(f"{path}/raw")
        self.save_vectors(path)

    def save_vectors(self, path: str) -> None:
        if isinstance(self.vectors, semantic.InvertedLists):
            self.vectors.save(f"{path}/lists")
        else:
            self.vectors.write.mode("overwrite").parquet(f"{path}/flat")

    @classmethod
    def load(cls, spark: SparkSession, path: str, declarations: DataFrame, embed: Callable[[DataFrame], DataFrame], inverted: bool = False, **options) -> SearchEngine:
        vectors = semantic.InvertedLists.load(spark, f"{path}/lists") if inverted else spark.read.parquet(f"{path}/flat")
        return cls(declarations, lexical.LexicalIndex.load(spark, f"{path}/spaced"), lexical.LexicalIndex.load(spark, f"{path}/raw"), vectors, embed, **options)

    def search(self, queries: DataFrame, limit: int = 50, semantic_k: int = 1000, bm25_k: int = 1000, rerank_top: int | None = 25, packages: Sequence[str] | None = None) -> DataFrame:
        """(query_id, position, id, name, ...) for a batch of queries (query_id, query); blank queries give no rows."""
        asked = queries.where(~text.is_blank(F.col("query"))).select("query_id", "query")
        tokens = asked.select("query_id", text.tokenize_spaced(F.col("query")).alias("spaced_tokens"), text.tokenize_raw(F.col("query")).alias("raw_tokens"))
        by_name = lexical.name_candidates(tokens, self.spaced, self.raw, bm25_k)
        vectors = self.embed(asked)
        near = semantic.probed_top_k(vectors, self.vectors, semantic_k) if isinstance(self.vectors, semantic.InvertedLists) else semantic.exact_top_k(vectors, self.vectors, semantic_k)
        fused = ranking.fuse(by_name, lexical.best_of(near))
        boosted = ranking.in_packages(ranking.boost(fused, self.declarations.select(RESULT_COLUMNS), few=fits(asked, semantic.QUERY_ROWS)), packages)
        again = bool(rerank_top and rerank_top > 0)
        pool = ranking.candidates(boosted, rerank_top if again else limit)
        if not again:
            return ranking.visible(pool, "boosted_rank", limit).select("query_id", "position", *RESULT_COLUMNS)
        ranked = ranking.rerank(pool.join(asked, "query_id"), pair_score=self.pair_score, fuzzy=self.fuzzy, weights=self.weights)
        return ranking.visible(ranked, "final_rank", limit).select("query_id", "position", *RESULT_COLUMNS)

    def get_by_id(self, ids: Sequence[int] | DataFrame) -> DataFrame:
        """Rows of some ids; ids that aren't there are left out."""
        if isinstance(ids, DataFrame):
            return self.declarations.join(ids.select("id").distinct(), "id", "left_semi").select(RESULT_COLUMNS)
        return self.declarations.where(F.col("id").isin(list(ids))).select(RESULT_COLUMNS)

    def get_field(self, declaration_id: int, name: str) -> DataFrame:
        """(id, name, field) of one declaration; no row for an unknown id."""
        return self.declarations.where(F.col("id") == declaration_id).select("id", F.col("name"), F.col(name).alias("field"))

    def get_by_name(self, name: str) -> DataFrame:
        """The row of an exact name; more than one is an error."""
        found = self.declarations.where(F.col("name") == name).select(RESULT_COLUMNS)
        only = F.count(F.lit(1)).over(_all())
        return found.withColumn("__n", only).withColumn("__ok", F.when(F.col("__n") > 1, F.raise_error(F.lit("several rows have this name")))).where("__ok is null").select(RESULT_COLUMNS)


def _all():
    from pyspark.sql import Window

    return Window.partitionBy("name")


@dataclass
class Service:
    """Answers for one query at a time, as plain values."""

    engine: SearchEngine

    def _spark(self) -> SparkSession:
        return self.engine.declarations.sparkSession

    def search(self, query: str, limit: int = 20, rerank_top: int | None = 50, packages: Sequence[str] | None = None) -> dict:
        began = time.perf_counter()
        rows = self.engine.search(self._spark().createDataFrame([(0, query)], "query_id long, query string"), limit=limit, rerank_top=rerank_top, packages=packages)
        results = [{k: v for k, v in r.asDict().items() if k not in ("query_id", "position")} for r in rows.orderBy("position").collect()]
        return {"query": query, "results": results, "packages_applied": list(packages) if packages else None, "count": len(results), "processing_time_ms": int((time.perf_counter() - began) * 1000)}

    def search_summary(self, query: str, limit: int = 10, rerank_top: int | None = 50, packages: Sequence[str] | None = None) -> dict:
        """Names and bold headers only; fields without a value are left out."""
        import re

        full = self.search(query, limit, rerank_top, packages)
        rows = []
        for r in full["results"]:
            m = re.match(r"\*\*(.+?)\*\*", r["informalization"] or "")
            rows.append({"id": r["id"], "name": r["name"]} | ({"description": m[1]} if m else {}))
        return {k: v for k, v in full.items() if v is not None} | {"results": rows}

    def get_by_id(self, declaration_id: int) -> dict | None:
        row = self.engine.get_by_id([declaration_id]).first()
        return row.asDict() if row else None

    def get_field(self, declaration_id: int, name: str) -> dict | None:
        """(id, name, field) of one declaration; None for an unknown id."""
        row = self.engine.get_field(declaration_id, name).first()
        return {k: v for k, v in zip(("id", "name", name), row) if v is not None} if row else None


def hashed_words(dimension: int = 64) -> Callable[[DataFrame], DataFrame]:
    """A deterministic embedding without a model: counts of hashed words. Query tables (query_id, query) to (query_id, embedding)."""

    def embed(queries: DataFrame) -> DataFrame:
        return queries.select("query_id", hashed_vector(F.col("query"), dimension).alias("embedding"))

    return embed


def hashed_vector(column: Column, dimension: int = 64) -> Column:
    places = F.transform(text.tokenize_words(column), lambda w: F.pmod(F.xxhash64(w), F.lit(dimension)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("float"))
