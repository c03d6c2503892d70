"""How filters interact: what each removes, in every order, by part of the corpus.

Five filters fail a text: A, under 200 words; B, under half of the words are distinct; C, over 2 % of the code points are
A-Z; D, one of ``#$%&*|`` occurs; E, a smaller id has the same text. Failures don't depend on the order, so one pass gives
every row a mask of five bits, and masks are counted.

* E is sort-based: rows are range-sorted by (sha256 of the text, text, id), and each is compared with the one before it.
  Ranges are cut by hash and id only, so no text is sampled to the driver and a group of copies spreads over many
  partitions. Every partition tells the hash of its first and of its last text and the least id of its last run, a row a
  partition; carried from partition to partition, they give a run that began earlier its least id.
* Masks add up: (part, mask) counts, with those of good and toxic rows, are all that the 120 orders of the five filters
  need; at most 32 rows a part.

Defined results: a null text is empty, a null source is the part ''; a row without id fails E never, and makes no other fail
it; rows that repeat an id and a text fail E together or not at all; of repeated label rows the larger value counts;
an empty table has no parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import checkpoint, column_of

FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COLUMNS = ["pid", "id", "part", "mask", "open", "first_hash", "last_hash", "least"]  # the last three, and open, of a partition: its mask is null
SPACE = " \t\n\x0b\f\r"


def failures(text: Column, words: Column) -> Column:
    """Mask of the filters A to D that fail; words: the text's words."""
    n = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = {"A": n < 200, "B": F.size(F.array_distinct(words)) * 100 < n * 50, "C": capitals.cast("long") * 100 > F.length(text).cast("long") * 2, "D": F.rlike(text, F.lit("[#$%&*|]"))}
    return sum((F.when(fail, F.lit(BIT[f])).otherwise(0) for f, fail in fails.items()), F.lit(0))


def words_of(text: Column) -> Column:
    inner = F.btrim(text, F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[ \t\n\x0B\f\r]+"))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition with E by comparison with the row before; last, what the partition tells the next ones."""
    pid = TaskContext.get().partitionId()
    first_hash, last_hash, last_text, least, opened = None, None, None, None, True
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        hashes, texts, ids = (column_of(batch, c) for c in ("hash", "text", "id"))
        same = np.zeros(n, bool)
        same[0] = hashes[0].as_py() == last_hash and texts[0].as_py() == last_text
        if n > 1:  # texts are compared where hashes are equal
            near = np.nonzero(np.asarray(pc.equal(hashes[1:], hashes[:-1])))[0]
            same[near + 1] = np.asarray(pc.equal(texts.take(pa.array(near + 1)), texts.take(pa.array(near))))
        starts = np.nonzero(~same)[0]
        if first_hash is None:
            first_hash = hashes[0].as_py()
        run = np.cumsum(~same)  # 0: the run that was open before this batch
        heads = pa.concat_arrays([pa.array([least], ids.type), ids.take(pa.array(starts))])
        own = pc.fill_null(pc.greater(ids, heads.take(pa.array(run))), False)
        # a partition's first run begins with its first row, and may go on through several batches
        begun = 0 if last_hash is not None else 1
        still = (run <= begun) if opened else np.zeros(n, bool)
        opened = opened and bool(still[-1])
        last_hash, last_text, least = hashes[n - 1].as_py(), texts[n - 1].as_py(), heads[int(run[-1])].as_py()
        mask = pc.add(column_of(batch, "mask"), pc.if_else(own, pa.scalar(BIT["E"], pa.int32()), pa.scalar(0, pa.int32())))
        kinds = [pa.int32(), ids.type, pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), ids.type]
        blank = [pa.nulls(n, k) for k in kinds[5:]]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, pid), pa.int32()), ids, column_of(batch, "part"), mask, pa.array(still), *blank], names=COLUMNS)
    if first_hash is not None:
        told = [pid, None, None, None, opened, first_hash, last_hash, least]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for k, v in zip(kinds, told)], names=COLUMNS)


def carried(told: list) -> list[tuple[int, object]]:
    """(partition, least id) of the partitions whose first run began earlier; told: a row a partition, in order."""
    out, last, least = [], None, None
    for r in told:
        goes_on = last is not None and r["first_hash"] == last
        if goes_on:
            out.append((r["pid"], least))
        if not (goes_on and r["open"]):  # else the whole partition is one run, which is still open
            least = r["least"]
        last = r["last_hash"]
    return out


def masks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask) of every row: which of the five filters it fails."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.unhex(F.sha2("text", 256)))
    by_id = F.col("id").asc_nulls_last()
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("hash"), by_id).sortWithinPartitions("hash", "text", by_id)
    rows = rows.withColumn("words", words_of(F.col("text"))).select("id", "part", "text", "hash", failures(F.col("text"), F.col("words")).alias("mask"))
    every = checkpoint(rows.mapInArrow(_compared, f"pid int, id {kind}, part string, mask int, open boolean, first_hash binary, last_hash binary, least {kind}"))
    told = every.where("mask is null").select("pid", "open", "first_hash", "last_hash", "least").orderBy("pid").collect()  # a row a partition
    carry = F.broadcast(spark.createDataFrame(carried(told), f"pid int, carried {kind}"))
    late = F.col("open") & (F.col("id") > F.col("carried"))
    full = F.when(late, F.col("mask").bitwiseOR(F.lit(BIT["E"]))).otherwise(F.col("mask"))
    return every.where("mask is not null").select("pid", "id", "part", "mask", "open").join(carry, "pid", "left").select(F.col("id").alias(id_col), "part", full.alias("mask"))


def mask_counts(found: DataFrame, labels: DataFrame, id_col: str = "doc_id", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """(part, mask, n, good, toxic): additive counters."""
    own = found.groupBy(F.col(id_col).alias("id"), "part", "mask").agg(F.count(F.lit(1)).alias("k"))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(good_col) == 1).alias("is_good"), (F.max(toxic_col) == 1).alias("is_toxic"))
    counted = lambda c: F.sum(F.when(F.col(c), F.col("k")).otherwise(F.lit(0).cast("long")))
    return own.join(known, "id", "left").groupBy("part", "mask").agg(F.sum("k").alias("n"), counted("is_good").alias("good"), counted("is_toxic").alias("toxic"))


def audit(counts: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step, from (part, mask, n, good, toxic)."""
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 32 at most
    rows = parts.withColumn("filter_order", F.explode(F.split(F.lit(",".join(ORDERS)), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = lambda at: F.element_at(F.array(*[F.lit(b) for b in BIT.values()]), F.call_function("instr", F.lit(FILTERS), F.substring("filter_order", at, 1)))
    before = F.aggregate(F.filter(F.sequence(F.lit(1), F.lit(len(FILTERS))), lambda j: j < F.col("step")), F.lit(0), lambda a, j: a + bit(j))
    rows = rows.withColumn("own", bit(F.col("step"))).withColumn("before", before)

    def total(where, value) -> Column:
        return F.aggregate(F.filter("masks", where), F.lit(0).cast("long"), lambda a, e: a + value(e))

    has = lambda e, bits: e["mask"].bitwiseAND(bits) != 0
    own, before = F.col("own"), F.col("before")
    removed = lambda e: has(e, own) & ~has(e, before)
    share = F.array(*[F.lit(len(ORDERS) // k).cast("long") for k in range(1, len(FILTERS) + 1)])  # orders in which one of k comes first
    return rows.select(
        "part", "filter_order", "step",
        total(lambda e: ~has(e, own + before), lambda e: e["n"]).alias("kept"),
        total(removed, lambda e: e["n"]).alias("removed"),
        total(lambda e: has(e, own) & has(e, before), lambda e: e["n"]).alias("redundant"),
        total(lambda e: e["mask"] == own, lambda e: e["n"]).alias("unique_fails"),
        total(removed, lambda e: e["good"]).alias("good_lost"),
        total(removed, lambda e: e["toxic"]).alias("toxic_lost"),
        total(lambda e: has(e, own), lambda e: e["n"] * F.element_at(share, F.bit_count(e["mask"]))).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    return audit(mask_counts(masks(docs, id_col=id_col, text_col=text_col, part_col=part_col), labels, id_col))
