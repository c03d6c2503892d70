"""Nearest vectors by inner product: exact, or through inverted lists of a k-means quantizer.

A vector stands in two lists: that of its nearest centroid, and a second one, chosen so that the error it makes there points
another way than the first one's, for a query that misses the first list misses it because of that error. A copy in the
second list is read for a query that doesn't read the first, so no vector is scored twice. Scores are exact products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.operators.lexical import top_k

LEAST_LISTS, PROBES = 256, 64
#: Queries whose vectors are sent to the tasks as one matrix.
QUERY_ROWS = 1000
#: Bytes of all centroids, which are on the driver and sent to the tasks.
CENTROID_BYTES = 128 << 20
#: Vectors that are dealt to lists, or scored, at a time; scores that a task holds before it drops all but the best.
DEAL_ROWS, HELD_SCORES = 1024, 1 << 20


def unit_queries(queries: DataFrame) -> DataFrame:
    """Query vectors (query_id, embedding) scaled to length 1; stored vectors are used as they are."""
    return queries.select("query_id", V.unit(F.col("embedding")).alias("q"))


def exact_top_k(queries: DataFrame, vectors: DataFrame, k: int = 1000) -> DataFrame:
    """(query_id, id, score, rank) by inner product with the query scaled to length 1.

    A batch of at most ``QUERY_ROWS`` queries goes to the tasks as one matrix: some vectors at a time are one matrix
    product, and only a task's best k of each query leave it. A larger batch is cut into blocks of about
    so many queries, each of which passes over the vectors.
    """
    own = vectors.where("embedding is not null").select("id", "embedding")
    return reduce(DataFrame.unionByName, [top_k(_products(block, own, k), k) for block in _blocks(queries)])


def _blocks(queries: DataFrame) -> list[list]:
    """The rows (query_id, q) of the queries in parts of about ``QUERY_ROWS``, dealt by a hash of their id."""
    asked = unit_queries(queries.where("embedding is not null"))
    first = asked.take(QUERY_ROWS + 1)
    if len(first) <= QUERY_ROWS:
        return [first]
    n = math.ceil(asked.count() / QUERY_ROWS)
    return [asked.where(F.pmod(F.xxhash64("query_id", F.lit(5)), F.lit(n)) == i).collect() for i in range(n)]


def _products(queries: list, vectors: DataFrame, k: int, lists: tuple[np.ndarray, np.ndarray] | None = None, probes: int = 0) -> DataFrame:
    """(query_id, id, score); with lists (ascending ids, centroids), of the vectors in each query's nearest ``probes`` lists only."""
    rows = [(r["query_id"], r["q"]) for r in queries]
    ids = np.array([q for q, _ in rows], np.int64)
    matrix = np.array([v for _, v in rows], np.float64).reshape(len(rows), -1 if rows else 0)
    kind = vectors.schema["id"].dataType.simpleString()
    if lists is not None:
        numbers, centroids = lists
        wanted = np.zeros((len(rows), len(numbers)), bool)
        if wanted.size:
            near = np.argsort(-(matrix @ centroids.T), axis=1, kind="stable")[:, :probes]
            np.put_along_axis(wanted, near, True, axis=1)
        # unread lists are pruned as partitions
        vectors = vectors.where(F.col("list_id").isin(numbers[wanted.any(0)].tolist()))
    vectors = vectors.select("id", "embedding", *(["list_id", "home"] if lists is not None else []))

    def scored(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray | bool]:
        column = batch.column(1)
        if set(np.unique(np.diff(np.asarray(column.offsets)))) != {matrix.shape[1]}:
            raise ValueError("vectors and queries differ in length")
        own = np.asarray(column.flatten()).astype(np.float64).reshape(batch.num_rows, -1)
        if lists is None:
            return matrix @ own.T, True
        code, home = (np.searchsorted(numbers, np.asarray(batch.column(i))) for i in (2, 3))
        # a copy in a second list isn't read where the first is
        scores, read = np.full((len(ids), batch.num_rows), -np.inf), wanted[:, code] & ((code == home) | ~wanted[:, home])
        for c in np.unique(code):
            q, v = np.nonzero(wanted[:, c])[0], np.nonzero(code == c)[0]
            scores[np.ix_(q, v)] = matrix[q] @ own[v].T
        scores[~read] = -np.inf
        return scores, read

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the task's best k of each query so far, as numbers of queries, ids and scores; a query's k-th best
        held: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        least, n = np.full(len(ids), -np.inf), 0

        def best() -> None:
            nonlocal held, n
            q, own, s = np.concatenate([x[0] for x in held]), pa.concat_arrays([x[1] for x in held]), np.concatenate([x[2] for x in held])
            # ties go by id, as in top_k
            coded = own.dictionary_encode(null_encoding="encode")
            code = np.argsort(np.asarray(pc.array_sort_indices(coded.dictionary, null_placement="at_start")))[np.asarray(coded.indices)]
            order = np.lexsort((code, np.where(np.isnan(s), -np.inf, -s), q))
            begin = np.nonzero(np.r_[True, q[order][1:] != q[order][:-1]])[0]
            rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.r_[begin, len(order)]))
            last = order[rank == k - 1]
            least[q[last]] = s[last]
            order = order[rank < k]
            held, n = [(q[order], own.take(pa.array(order)), s[order])], len(order)

        for whole in batches if len(ids) else ():
            for a in range(0, whole.num_rows, DEAL_ROWS):
                batch = whole.slice(a, DEAL_ROWS)
                scores, read = scored(batch)
                floor = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k]) if batch.num_rows > k else least
                q, v = np.nonzero(~(scores < floor[:, None]) & read)
                if len(q):
                    held.append((q, batch.column(0).take(pa.array(v)), scores[q, v]))
                    n += len(q)
                if n > max(HELD_SCORES, 2 * k * len(ids)):
                    best()
        if n:
            best()
            q, own, s = held[0]
            for a in range(0, n, HELD_SCORES):
                yield pa.RecordBatch.from_arrays([pa.array(ids[q[a : a + HELD_SCORES]]), own.slice(a, HELD_SCORES), pa.array(s[a : a + HELD_SCORES])], names=["query_id", "id", "score"])

    return vectors.mapInArrow(run, f"query_id long, id {kind}, score double")


def list_count(n: int, least: int = LEAST_LISTS, dimension: int = 0) -> int:
    """The square root of the vectors, ``least`` or more; no more than centroids of ``CENTROID_BYTES`` (lists get longer beyond)."""
    most = CENTROID_BYTES // (8 * dimension) if dimension else n + least
    return max(least, min(math.isqrt(n), most))


@dataclass
class InvertedLists:
    """vectors (id, embedding, list_id, home), written by list_id; home: the list of the nearest centroid; centroids (list_id, centroid)."""

    vectors: DataFrame
    centroids: DataFrame

    def save(self, path: str) -> None:
        self.vectors.write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/vectors")
        self.centroids.write.mode("overwrite").parquet(f"{path}/centroids")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> InvertedLists:
        return cls(spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/centroids"))


def build_lists(vectors: DataFrame, lists: int | None = None, seed: int = 11, iterations: int = 10, train_rows: int = 1_000_000) -> InvertedLists:
    """Train centroids on at most about train_rows vectors; every vector stands in the list of its nearest centroid and in a second one."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    own = vectors.where("embedding is not null").select("id", "embedding")
    n = own.count()
    spark = vectors.sparkSession
    if not n:
        return InvertedLists(own.withColumns({"list_id": F.lit(0), "home": F.lit(0)}), spark.createDataFrame([], "list_id int, centroid array<double>"))
    rows = own.withColumn("features", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))))
    sample = rows if n <= train_rows else rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < int(train_rows / n * (1 << 20)))
    dimension = own.select(F.size("embedding")).first()[0]
    model = KMeans(k=min(lists or list_count(n, dimension=dimension), n), seed=seed, maxIter=iterations, distanceMeasure="cosine", predictionCol="list_id").fit(sample)
    centres = np.array(model.clusterCenters())
    centroids = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "list_id int, centroid array<double>")
    sent = spark.sparkContext.broadcast(centres)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, DEAL_ROWS):
                batch = whole.slice(a, DEAL_ROWS)
                x = np.asarray(batch.column(1).flatten()).astype(np.float64).reshape(batch.num_rows, -1)
                first, second = two_lists(x, sent.value)
                for own in (first, second) if len(sent.value) > 1 else (first,):
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(first.astype(np.int32))], names=["id", "embedding", "list_id", "home"])

    kinds = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in ("id", "embedding"))
    return InvertedLists(own.mapInArrow(deal, f"{kinds}, list_id int, home int"), centroids)


def two_lists(x: np.ndarray, centres: np.ndarray, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each vector, and the other one of the least error, where error along the first one's counts more by ``weight``."""
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    x, c = unit(x), unit(centres)
    near = x @ c.T
    first = near.argmax(1)
    left = unit(x - c[first])
    along = (x * left).sum(1, keepdims=True) - left @ c.T
    error = 2 - 2 * near + weight * along**2
    error[np.arange(len(x)), first] = np.inf
    return first, error.argmin(1)


def probed_top_k(queries: DataFrame, index: InvertedLists, k: int = 1000, probes: int = PROBES) -> DataFrame:
    """(query_id, id, score, rank) over each query's nearest lists only; batches are cut into blocks as in ``exact_top_k``."""
    rows = index.centroids.orderBy("list_id").collect()
    lists = np.array([r["list_id"] for r in rows], np.int64), np.array([r["centroid"] for r in rows], np.float64)
    return reduce(DataFrame.unionByName, [top_k(_products(block, index.vectors, k, lists, probes), k) for block in _blocks(queries)])
