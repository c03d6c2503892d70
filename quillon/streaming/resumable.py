"""Incremental enrichment of arriving rows into a bucketed cache with a log of what has been added."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quillon.sources.folders import Folder

BUCKETS = 64


@dataclass
class ResumableCache:
    """(keys, value) by bucket of the keys and number of the addition: ``path/bucket=../addition=..``.

    An addition counts once the log names it; what a failed one left is removed by the next of its number. So readers see
    whole additions only, and an addition that is made again, under its name, adds nothing.
    """

    spark: SparkSession
    path: str
    schema: StructType
    keys: Sequence[str]
    buckets: int = BUCKETS

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def log(self) -> list[str]:
        """Names of the additions, in order."""
        return [n.partition("-")[2] for n in Folder(f"{self.path}/_log", self.spark).names() if n[:1].isdigit()]

    def rows(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """What has been added, of some buckets only: the others' files aren't read."""
        n = len(self.log())
        if not n:
            return self.spark.createDataFrame([], self.schema)
        found = self.spark.read.schema(StructType([*self.schema.fields]).add("bucket", "integer").add("addition", "integer")).parquet(self.path).where(F.col("addition") < n)
        if buckets is not None:
            found = found.where(F.col("bucket").isin(list(buckets)))
        return found.select(self.schema.fieldNames())

    def add(self, name: str, rows: DataFrame) -> bool:
        """Write an addition and log it; False if the log has it already."""
        done = self.log()
        if name in done:
            return False
        folder = Folder(self.path, self.spark)
        for left in folder.matching(f"bucket=*/addition={len(done)}"):
            folder.remove(left)
        own = rows.select(self.schema.fieldNames()).withColumns({"bucket": self.bucket(), "addition": F.lit(len(done))})
        own.repartition("bucket").write.mode("append").partitionBy("bucket", "addition").parquet(self.path)
        folder.touch(f"_log/{len(done):09d}-{name}")
        return True


def enrich_stream(rows: DataFrame, cache_path: str, keys: Sequence[str], value: str, generate: Callable[[DataFrame], DataFrame], checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Generate values for arriving rows that the cache hasn't, and add them to it; a rerun resumes at the checkpoint.

    generate: rows to (keys, value). A batch reads the buckets of its own keys only. A batch that is run again, after a
    failure halfway, generates anew what wasn't logged, and adds nothing if it was. Rows with a null key are left out.
    """
    schema = StructType([rows.schema[k] for k in keys]).add(value, "string")

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        cache = ResumableCache(spark, cache_path, schema, keys, buckets)
        name = f"{spark.sparkContext.getLocalProperty('sql.streaming.queryId')}-{number}"
        if name in cache.log():
            return
        own = batch.dropna(subset=list(keys)).dropDuplicates(list(keys)).withColumn("__bucket", cache.bucket()).persist()
        try:
            touched = [r[0] for r in own.select("__bucket").distinct().collect()]
            misses = own.drop("__bucket").join(cache.rows(touched), list(keys), "left_anti")
            cache.add(name, generate(misses))
        finally:
            own.unpersist()

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
