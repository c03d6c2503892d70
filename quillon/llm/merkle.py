"""Merkle manifest of a table: a tree of hashes per group, a tree over the groups' roots, and a proof for every row.

1. Leaves (sha256 of the row's fields) are written with their keys, range-sorted by group, key and leaf, and checkpointed:
   the partitions of that table stay what they are. The rows of each (partition, group) are counted; their running sum is
   the place in its group at which a partition begins.
2. Every partition builds the subtrees whose leaves it has all, aligned to powers of two in the group. What it has at the
   edges, two nodes a level at most, is shuffled by coordinate (group, aligned block), and blocks are finished upwards, each
   round joining blocks of many more leaves, until each group has one node.
3. The groups' roots are leaves of a second such tree, of one group, made by the same steps.
4. For proofs, every partition gets the nodes beside its own, two a level at most, builds the levels over its leaves again
   and reads each leaf's siblings from them.

A partition holds about ``LEAVES`` leaves, whatever their number, so no group or row count makes a task larger. What is
broadcast is a row for each partition, edge and level (34 levels are 10^10 leaves): it grows with the number of
partitions, not with the rows of one. Groups' roots are joined by broadcast up to ``BROADCAST_ROWS``, then by shuffle.

Defined results: fields that are null count as ``-``; a null key comes first; a null group is a group, and the first; equal
keys stand in the order of their leaves (equal rows have equal leaves, in any order); a lone node is hashed alone; a lone
leaf is its group's root, and a lone group's root is the root of all; an empty table has no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import checkpoint, column_of, reliable

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves of a partition, about; rows of groups' roots that may be broadcast; rows of a batch of proofs.
LEAVES, BROADCAST_ROWS, BATCH = 1_000_000, 1_000_000, 4096
PROOF = "array<struct<left: boolean, hash: string>>"
D = 32  # bytes of a digest


def row_hash(fields: list[Column]) -> Column:
    """Hex sha256 of the fields one after another: ``-`` for null, else byte count, ``:``, value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf (hex) and its proof give; a null hash is a level at which the node stands alone."""
    both = lambda a, s: F.when(s["left"], F.concat(s["hash"], a)).otherwise(F.concat(a, F.coalesce(s["hash"], F.lit(""))))
    return F.aggregate(proof, leaf, lambda a, s: F.sha2(both(a, s), 256))


def siblings_hash(proof: Column) -> Column:
    """Hex sha256 of all siblings of a proof, from the leaf upwards."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: s["hash"]), ""), 256)


def height(n: int) -> int:
    """Levels above n leaves."""
    return (n - 1).bit_length()


def width(n: int, level: int) -> int:
    return (n + (1 << level) - 1) >> level


def parents(nodes: bytes) -> bytes:
    """Digests of each two nodes' hex text; a last one alone."""
    text = nodes.hex().encode()
    return b"".join([sha256(text[a : a + 4 * D]).digest() for a in range(0, len(text), 4 * D)])


def edges(nodes: bytes, s: int, e: int, n: int) -> Iterator[tuple[int, int, bytes]]:
    """(level, index, node) of the largest subtrees over the leaves s to e of n; all their leaves are among these."""
    k, m = 0, n
    while s < e:
        if m == 1:
            yield k, 0, nodes
            return
        first, last = s + (s & 1), e if e == m else e - (e & 1)
        if first > s:
            yield k, s, nodes[:D]
        if last < e:
            yield k, e - 1, nodes[-D:]
        nodes = parents(nodes[D * (first - s) : D * (last - s)])
        s, e, m, k = first >> 1, (last + 1) >> 1, (m + 1) >> 1, k + 1


def beside(s: int, e: int, n: int) -> Iterator[tuple[int, int]]:
    """(level, index) of the nodes next to those over the leaves s to e that complete a pair."""
    for k in range(height(n)):
        first, last = s >> k, (e - 1) >> k
        if first & 1:
            yield k, first - 1
        if not last & 1 and last + 1 < width(n, k):
            yield k, last + 1


def levels(nodes: bytes, s: int, n: int, outside: dict[tuple[int, int], bytes]) -> tuple[list[tuple[int, bytes]], bytes]:
    """(first index, nodes) of each level over the leaves from s on, in whole pairs, and the root."""
    out = []
    for k in range(height(n)):
        end = s + len(nodes) // D
        if s & 1:
            nodes, s = outside[k, s - 1] + nodes, s - 1
        if end & 1 and end < width(n, k):
            nodes += outside[k, end]
        out.append((s, nodes))
        nodes, s = parents(nodes), s >> 1
    return out, nodes


def finished(nodes: dict[tuple[int, int], bytes], n: int, top: int) -> dict[tuple[int, int], bytes]:
    """The nodes above the given ones up to a level; the given ones cover whole subtrees of it."""
    made: dict[tuple[int, int], bytes] = {}
    at: dict[int, set[int]] = defaultdict(set)
    for k, i in nodes:
        at[k].add(i)
    for k in range(top):
        for p in {i >> 1 for i in at[k]}:
            pair = [(k, i) for i in (2 * p, 2 * p + 1) if i < width(n, k)]
            made[k + 1, p] = parents(b"".join(made.get(x) or nodes[x] for x in pair))
            at[k + 1].add(p)
    return made


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str | None, pa.Table]]:
    """(partition, group, rows) of sorted partitions; a task may have several of them."""
    kept: list[pa.RecordBatch] = []
    name = None
    for batch in batches:
        if not batch.num_rows:
            continue
        pids, groups = np.asarray(column_of(batch, "__pid")), column_of(batch, "grp").dictionary_encode(null_encoding="encode")
        codes = np.asarray(groups.indices)
        cuts = [0, *(np.nonzero((codes[1:] != codes[:-1]) | (pids[1:] != pids[:-1]))[0] + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            own = (int(pids[a]), groups.dictionary[codes[a]].as_py())
            if kept and own != name:
                yield *name, pa.Table.from_batches(kept)
                kept = []
            name = own
            kept.append(batch.slice(a, b - a))
    if kept:
        yield *name, pa.Table.from_batches(kept)


def _flat(column: pa.ChunkedArray) -> bytes:
    return b"".join(column.to_pylist())


def _proofs(rows: pa.Table, s: int, n: int, outside: dict) -> Iterator[pa.RecordBatch]:
    """The rows with their group's root and their siblings."""
    tree, root = levels(_flat(rows["leaf"]), s, n, outside)
    texts = [(a, np.frombuffer(nodes.hex().encode(), f"S{2 * D}")) for a, nodes in tree]
    h = len(texts)
    for batch in rows.to_batches(max_chunksize=BATCH):
        m = batch.num_rows
        x = np.arange(s, s + m)
        hashes, left, there = np.zeros((m, h), f"S{2 * D}"), np.zeros((m, h), bool), np.ones((m, h), bool)
        for k, (a, nodes) in enumerate(texts):
            own = x >> k
            at = (own ^ 1) - a
            there[:, k] = at < len(nodes)
            left[:, k] = own & 1
            hashes[:, k] = nodes[np.minimum(at, len(nodes) - 1)]
        texts_ = pa.array(hashes.ravel(), pa.binary(), mask=~there.ravel()).cast(pa.string())
        pairs = pa.StructArray.from_arrays([pa.array(left.ravel()), texts_], names=["left", "hash"])
        proof = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * h), pairs)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([root] * m, pa.binary()), proof], names=[*batch.schema.names, "top", "proof"])
        s += m


def _block(reach: int):
    """Finish the nodes of an aligned block up to a level."""

    def run(group: pa.Table) -> pa.Table:
        n = group["total"][0].as_py()
        given = {(k, i): x for k, i, x in zip(*(group[c].to_pylist() for c in ("level", "idx", "node")))}
        made = finished(given, n, min(reach, height(n)))
        m = len(made)
        level, index = [k for k, _ in made], [i for _, i in made]
        return pa.table([pa.array([group["grp"][0].as_py()] * m, pa.string()), pa.array([n] * m, pa.int64()), pa.array(level, pa.int32()), pa.array(index, pa.int64()), pa.array(list(made.values()), pa.binary())], names=["grp", "total", "level", "idx", "node"])

    return run


def trees(leaves: DataFrame, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(leaves with ``top``, their group's root, and ``proof``; (grp, leaf) of the groups' roots).

    leaves: grp string, leaf binary, and any others; order: of the leaves in a group.
    """
    spark = leaves.sparkSession
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-leaves.count() // LEAVES))
    keys = [F.col("grp").asc_nulls_first(), *order, F.col("leaf"), F.col("__tie")]
    rows = reliable(leaves.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(n_parts, *keys).sortWithinPartitions(*keys).drop("__tie")).withColumn("__pid", F.spark_partition_id())

    # where each partition begins in its groups; only the first and last group of a partition go on in others
    counts = rows.groupBy(F.col("__pid").alias("pid"), "grp").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("grp")
    places = counts.select("pid", "grp", "n", F.sum("n").over(own).alias("total"), (F.sum("n").over(own.orderBy("pid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("start"))
    shared = places.where("n < total").select("pid", "grp", "start", "n", "total").collect()
    place = spark.sparkContext.broadcast({(r["pid"], r["grp"]): (r["start"], r["total"]) for r in shared})

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pid, group, table in _runs(batches):
            s, n = place.value.get((pid, group), (0, table.num_rows))
            found = list(edges(_flat(table["leaf"]), s, s + table.num_rows, n))
            level, index, node = (list(c) for c in zip(*found))
            m = len(found)
            yield pa.RecordBatch.from_arrays([pa.array([group] * m, pa.string()), pa.array([n] * m, pa.int64()), pa.array(level, pa.int32()), pa.array(index, pa.int64()), pa.array(node, pa.binary())], names=["grp", "total", "level", "idx", "node"])

    kinds = "grp string, total long, level int, idx long, node binary"
    nodes = checkpoint(rows.select("__pid", "grp", "leaf").mapInArrow(local, kinds), narrow=True)
    whole = F.col("level") == F.when(F.col("total") == 1, 0).otherwise(F.length(F.bin(F.col("total") - 1)))
    roots, every = [nodes.where(whole)], [nodes.where(~whole)]
    if shared:
        # blocks of some dozens of partitions first, then of hundreds of such blocks
        last = max(height(r["total"]) for r in shared)
        reach = min(last, max(r["n"] for r in shared).bit_length() + 6)
        still = every[0]
        while True:
            placed = still.withColumn("block", F.shiftright(F.call_function("shiftleft", F.col("idx"), F.col("level")), reach))
            made = checkpoint(placed.groupBy("grp", "block").applyInArrow(_block(reach), kinds), narrow=True)
            every.append(made)
            roots.append(made.where(whole))
            if reach >= last:
                break
            still = made.where((F.col("level") == reach) & ~whole)
            reach = min(last, reach + 8)
    upper = every[0]
    for more in every[1:]:
        upper = upper.unionByName(more)
    top = roots[0]
    for more in roots[1:]:
        top = top.unionByName(more)

    # the nodes beside each partition's own
    asked = [(r["pid"], r["grp"], k, i) for r in shared for k, i in beside(r["start"], r["start"] + r["n"], r["total"])]
    near: dict = defaultdict(dict)
    if asked:
        wanted = spark.createDataFrame(asked, "pid int, g string, k int, i long")
        met = wanted.join(upper, F.col("g").eqNullSafe(F.col("grp")) & (F.col("k") == F.col("level")) & (F.col("i") == F.col("idx")))
        for r in met.select("pid", "g", "k", "i", "node").collect():
            near[r["pid"], r["g"]][r["k"], r["i"]] = bytes(r["node"])
    outside = spark.sparkContext.broadcast(dict(near))

    def proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pid, group, table in _runs(batches):
            yield from _proofs(table, *place.value.get((pid, group), (0, table.num_rows)), outside.value.get((pid, group), {}))

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(proofs, f"{kind}, top binary, proof {PROOF}").drop("__pid"), top.select("grp", F.col("node").alias("leaf"))


def manifest(docs: DataFrame, *, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, changed: Column | None = None) -> DataFrame:
    """(id, leaf, changed, subroot, root, proof) of every row: hex digests; proof: (left, hash) of its siblings, from the leaf upwards.

    changed: another hash of the row (hex, null for the same one), carried along to be held against its proof.
    """
    hex_ = lambda c: F.lower(F.hex(c))
    other = F.lit(None).cast("binary") if changed is None else F.unhex(changed)
    leaves = checkpoint(docs.select(F.col(group_col).cast("string").alias("grp"), F.col(id_col).alias("id"), F.unhex(row_hash([F.col(f) for f in fields])).alias("leaf"), other.alias("changed")))
    found, roots = trees(leaves, [F.col("id").asc_nulls_first()])
    groups, all_ = trees(checkpoint(roots.select(F.lit(None).cast("string").alias("grp"), F.col("grp").alias("name"), "leaf"), narrow=True), [F.col("name").asc_nulls_first()])
    groups = checkpoint(groups.select("name", F.col("top").alias("root"), F.col("proof").alias("more")), narrow=True)
    few = groups.count() <= BROADCAST_ROWS
    met = found.join(F.broadcast(groups) if few else groups, F.col("grp").eqNullSafe(F.col("name")))
    return met.select(F.col("id").alias(id_col), hex_("leaf").alias("leaf"), hex_(F.coalesce("changed", "leaf")).alias("changed"), hex_("top").alias("subroot"), hex_("root").alias("root"), F.concat("proof", "more").alias("proof"))
