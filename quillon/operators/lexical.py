"""BM25+ over token columns: an index of three tables, built once, and top-k retrieval for a batch of queries.

score(q, d) = sum over q's tokens of idf(t) * (delta + (k1 + 1) tf / (k1 (1 - b + b dl / avgdl) + tf)), idf = ln((N + 1) / df).
A token that d lacks gives idf * delta, whatever d; so d's score is a constant of the query plus its matched terms'
part, and only postings of the query's terms are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import scoring
from quillon.operators.storage import fits

K1, B, DELTA = 1.5, 0.75, 0.5
#: Tokens that are counted at a time (a row has its own at least); terms of a batch that are looked up in saved postings.
BLOCK_TOKENS, LOOKED_UP = 4 << 20, 1000


@dataclass
class LexicalIndex:
    """postings (term, id, tf, dl), terms (term, df), corpus (n, avgdl: one row)."""

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame

    blocks: DataFrame | None = None  # what it was built from: see ``_blocks``

    def save(self, path: str) -> None:
        """Postings dealt by term in blocks and sorted by it, so that a reader prunes pages by the query's terms.

        One pass over the rows: blocks hold many postings of a term in little room and move once; terms and corpus come from them.
        """
        spark = self.postings.sparkSession
        deal = lambda df: df.repartition(F.coalesce("term", F.col("ids")[0].cast("string"))).sortWithinPartitions("term")
        if self.blocks is not None:
            deal(self.blocks).write.mode("overwrite").parquet(f"{path}/blocks")
            kept = spark.read.parquet(f"{path}/blocks")
            rows = kept.where("term is null").select(F.explode(F.arrays_zip("ids", "dls")).alias("row")).select("row.*")
            n, different = rows.count(), rows.distinct().count()
            if n == different:
                kept.where("term is not null").groupBy("term").agg(F.sum(F.size("ids")).alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
                rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dls").alias("avgdl")).write.mode("overwrite").parquet(f"{path}/corpus")
                return
        # rows of one id and length count as one, so their postings have to meet
        deal(self.postings.select("term", *(F.array(c).alias(f"{c}s") for c in ("id", "tf", "dl")))).write.mode("overwrite").parquet(f"{path}/blocks")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.corpus.write.mode("overwrite").parquet(f"{path}/corpus")

    @classmethod
    def load(cls, spark, path: str) -> LexicalIndex:
        blocks, terms, corpus = (spark.read.parquet(f"{path}/{name}") for name in ("blocks", "terms", "corpus"))
        postings = blocks.where("term is not null").select("term", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p"))
        return cls(postings.select("term", F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl")), terms, corpus)


def _blocks() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, dl, tokens) to blocks (term, ids, tfs, dls): a term's postings of some rows; the null term's block has all the rows."""

    def lists(offsets: np.ndarray, *values: pa.Array) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), v) for v in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(np.asarray(batch.column(2).offsets)).astype(np.int64)
            part = (np.cumsum(size) - 1) // BLOCK_TOKENS
            bounds = [0, *(np.nonzero(np.diff(part))[0] + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
            for a, b in zip(bounds[:-1], bounds[1:]):
                ids, dl, own = (batch.column(i).slice(a, b - a) for i in range(3))
                flat, row = own.flatten(), np.repeat(np.arange(b - a, dtype=np.int64), size[a:b])
                if flat.null_count:
                    flat, row = flat.drop_null(), row[np.asarray(flat.is_valid())]
                coded = flat.dictionary_encode()
                pair, tf = np.unique(np.asarray(coded.indices).astype(np.int64) * (b - a) + row, return_counts=True)
                code, row = np.divmod(pair, b - a)
                first = np.nonzero(np.r_[True, code[1:] != code[:-1]])[0] if len(code) else np.zeros(0, np.int64)
                rows = pa.array(np.r_[row, np.arange(b - a)])
                terms = pa.concat_arrays([coded.dictionary.take(pa.array(code[first])).cast(pa.string()), pa.array([None], pa.string())])
                tfs = pa.array(np.r_[tf, np.zeros(b - a)].astype(np.int64))
                yield pa.RecordBatch.from_arrays([terms, *lists(np.r_[first, len(row), len(rows)], ids.take(rows), tfs, dl.take(rows))], names=["term", "ids", "tfs", "dls"])

    return run


def build_index(rows: DataFrame, tokens: Column, id_col: str = "id", distinct: bool = False, terms: Sequence[str] | None = None) -> LexicalIndex:
    """distinct: count a token once a row, as the name indices do. terms: all that will be asked, where the index isn't kept."""
    own = rows.select(F.col(id_col).alias("id"), (F.array_distinct(tokens) if distinct else tokens).alias("tokens"))
    own = own.withColumn("dl", F.size("tokens").cast("long"))
    if terms is not None:
        own = own.withColumn("tokens", F.filter("tokens", lambda t: t.isin(list(terms))))
    # outer: a plain explode would add a filter on the tokens' number, and with it tokenize twice
    postings = own.select("id", "dl", F.explode_outer("tokens").alias("term")).where("term is not null").groupBy("term", "id", "dl").agg(F.count(F.lit(1)).alias("tf")).select("term", "id", "tf", "dl")
    frequencies = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    corpus = own.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    kind = own.schema["id"].dataType.simpleString()
    blocks = own.select("id", "dl", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens")).mapInArrow(_blocks(), f"term string, ids array<{kind}>, tfs array<long>, dls array<long>")
    return LexicalIndex(postings, frequencies, corpus, blocks)


def score_matches(queries: DataFrame, index: LexicalIndex, k1: float = K1, b: float = B, delta: float = DELTA) -> DataFrame:
    """(query_id, id, score) of every row with one of the query's tokens. queries: (query_id, tokens).

    A batch within the bound of ``fits`` is broadcast to the terms and the postings, which aren't shuffled for it.
    """
    asked = queries.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))
    near = F.broadcast if fits(asked) else lambda df: df
    known = index.terms.join(near(asked), "term").crossJoin(F.broadcast(index.corpus)).withColumn("idf", F.log((F.col("n") + 1) / F.col("df")) * F.col("qf"))
    base = known.groupBy("query_id").agg((F.sum("idf") * delta).alias("base"))
    tf, dl = F.col("tf").cast("double"), F.col("dl").cast("double")
    part = F.col("idf") * (k1 + 1) * tf / (k1 * (1 - b + b * dl / F.col("avgdl")) + tf)
    postings = index.postings
    if fits(asked, LOOKED_UP):
        postings = postings.where(F.col("term").isin([r["term"] for r in asked.select("term").distinct().collect()]))
    matched = postings.join(near(known), "term").groupBy("query_id", "id").agg(F.sum(part).alias("part"))
    return matched.join(near(base), "query_id").select("query_id", "id", (F.col("part") + F.col("base")).alias("score"))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each query; ties go by id."""
    return scores.withColumn("rank", scoring.rank_by(F.col("score"), "id")).where(F.col("rank") <= k)


def name_candidates(queries: DataFrame, spaced: LexicalIndex, raw: LexicalIndex, k: int = 1000) -> DataFrame:
    """(query_id, id, score): best of the two name indices, never under 0. queries: (query_id, spaced_tokens, raw_tokens)."""
    hits = [top_k(score_matches(queries.select("query_id", F.col(c).alias("tokens")), index), k) for c, index in (("spaced_tokens", spaced), ("raw_tokens", raw))]
    return best_of(*hits)


def best_of(*scores: DataFrame) -> DataFrame:
    """One row for each (query, id) of several score tables: its best score, never under 0."""
    every = scores[0].select("query_id", "id", "score")
    for other in scores[1:]:
        every = every.unionByName(other.select("query_id", "id", "score"))
    return every.groupBy("query_id", "id").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("score"))


def pool_scores(pool: DataFrame, tokens: Column, query_tokens: Column, k1: float = K1, b: float = B, delta: float = DELTA) -> DataFrame:
    """(query_id, id, text_score): BM25+ with each query's own candidates as corpus. Candidates without a match get the constant."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id")
    rows = pool.select("query_id", "id", tokens.alias("tokens"), query_tokens.alias("asked")).withColumn("dl", F.size("tokens").cast("double"))
    rows = rows.withColumns({"n": F.count(F.lit(1)).over(w), "avgdl": F.avg("dl").over(w)})
    # counted before the terms are dealt out, so that no row carries its tokens once a term
    times = lambda c, t: F.size(F.filter(c, lambda x: x == t)).cast("double")
    counted = F.transform(F.array_distinct("asked"), lambda t: F.struct(t.alias("term"), times("tokens", t).alias("tf"), times("asked", t).alias("qf")))
    terms = rows.select("query_id", "id", "n", "avgdl", "dl", F.inline(counted))
    terms = terms.withColumn("df", F.sum((F.col("tf") > 0).cast("long")).over(Window.partitionBy("query_id", "term")))
    idf = F.when(F.col("df") > 0, F.log((F.col("n") + 1) / F.col("df")) * F.col("qf")).otherwise(0.0)
    part = idf * (delta + F.when(F.col("tf") > 0, (k1 + 1) * F.col("tf") / (k1 * (1 - b + b * F.col("dl") / F.col("avgdl")) + F.col("tf"))).otherwise(0.0))
    scored = terms.groupBy("query_id", "id").agg(F.sum(part).alias("text_score"))
    return pool.select("query_id", "id").join(scored, ["query_id", "id"], "left").withColumn("text_score", F.coalesce("text_score", F.lit(0.0)))
