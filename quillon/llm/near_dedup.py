"""Near-duplicate documents by HyperMinHash sketches.

1. Every text becomes a set of distinct 5-word shingles, and its HyperMinHash sketch. Equal sets are one class, whose
   representative is its least id; only representatives go on.
2. Bands of compressed registers are hashed; each representative meets the least one of each of its bands. Pairs that
   the collision-corrected estimate can't rule out (a margin of several standard errors) are confirmed on full sets.
3. Bands that still hold several components are compared inside, in cells of blocks, across components only: sketch with
   sketch first, and what passes the estimate on full sets, which a cell gets once for each member. A link that is found
   makes one component of two at once, so a cell emits a spanning forest: no link is lost by comparing with the least
   member only, and no pairs leave a cell, whether they are linked or fall short by little.
4. Components of the confirmed links give each document the least id reachable.

A band of more than ``BLOCK`` members, or of more than ``SHINGLES`` shingles for each block, is dealt into pairs of blocks, one
task's group each, so no group is unbounded.

Defined results: without words or text the set is empty and linked with nothing; rows of equal id are one node, whatever
their texts: the links of each are the links of all, and all have one component; a row without id is linked with nothing,
has no component and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import hyperminhash as hmh
from quillon.llm.common import bytes_of, checkpoint, column_of, drop_caches, map_pieces, pieces
from quillon.llm.components import components

#: Similarity that links, in percent, and the standard errors by which an estimate may fall short before confirmation.
PERCENT, MARGIN = 85, 4.0
#: Members of a band that one group may compare.
BLOCK = 1500
#: Shingles of a block, about.
SHINGLES = 1 << 20
#: Bytes of text that are sketched at a time.
PIECE = 1 << 20
#: Rows of ids that may be broadcast to fetch texts; beyond, it is a shuffled join.
BROADCAST_ROWS = 1_000_000


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, k1, k2, sketch, bands) of every row; sketch and bands are null for empty sets."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        drop_caches()

        def run(piece: pa.RecordBatch) -> pa.RecordBatch:
            offsets, hashes = hmh.shingle_sets(bytes_of(piece, text_col))
            n = np.diff(offsets)
            keys = hmh.set_keys(offsets, hashes)
            regs = hmh.registers(offsets, hashes)
            full = np.nonzero(n)[0]
            sketch: list[bytes | None] = [None] * len(n)
            bands: list[np.ndarray | None] = [None] * len(n)
            if len(full):
                for i, s, b in zip(full, hmh.packed(regs[full]), hmh.band_keys(regs[full])):
                    sketch[i], bands[i] = s, b
            return pa.RecordBatch.from_arrays([column_of(piece, id_col), pa.array(n), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(sketch, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "n", "k1", "k2", "sketch", "bands"])

        return run

    return map_pieces(docs.select(id_col, text_col), text_col, make, f"id {kind}, n long, k1 long, k2 long, sketch binary, bands array<long>", PIECE)


def plausible(pairs: DataFrame, reps: DataFrame, percent: int, margin: float) -> DataFrame:
    """The (a, b) pairs whose estimated similarity may reach the bound."""
    kind = pairs.schema["a"].dataType.simpleString()
    side = lambda c: reps.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, None, 8 << 20):
            sides = [hmh.unpacked(bytes_of(piece, c)) for c in ("s_a", "s_b")]
            j, error = hmh.estimate(*sides, *(np.asarray(column_of(piece, c)).astype(float) for c in ("n_a", "n_b")))
            keep = pa.array(j + margin * error >= percent / 100)
            yield pa.RecordBatch.from_arrays([column_of(piece, c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, f"a {kind}, b {kind}")


def full_sets(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, hashes): the shingle sets of the rows of these ids, as sorted 64-bit hashes."""
    kind = docs.schema[id_col].dataType.simpleString()
    few = wanted.count() <= BROADCAST_ROWS
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(wanted) if few else wanted, "id", "left_semi").distinct()

    def make():
        def run(piece: pa.RecordBatch) -> pa.RecordBatch:
            offsets, hashes = hmh.shingle_sets(bytes_of(piece, "text"))
            return pa.RecordBatch.from_arrays([column_of(piece, "id"), pa.array([hashes[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())], names=["id", "hashes"])

        return run

    return checkpoint(map_pieces(texts, "text", make, f"id {kind}, hashes binary"), narrow=True)


def confirmed(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """The (a, b) pairs whose full shingle sets are similar enough."""
    kind = docs.schema[id_col].dataType.simpleString()
    pairs = checkpoint(pairs.distinct(), narrow=True)
    sets = full_sets(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, None, 16 << 20):
            keep = []
            for x, y in zip(bytes_of(piece, "x"), bytes_of(piece, "y")):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - same
                keep.append(union > 0 and 100 * same >= percent * union)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([column_of(piece, c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    met = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b")
    return checkpoint(met.mapInArrow(run, f"a {kind}, b {kind}").distinct(), narrow=True)


def _across(group: pa.Table, percent: int, margin: float) -> pa.Table:
    """A spanning forest of the links between a cell's members of different components, each pair looked at in the first band that it shares."""
    band = group["band"][0].as_py()
    ids, comps = group["id"].combine_chunks(), np.unique(np.asarray(group["component"].combine_chunks().dictionary_encode().indices), return_inverse=True)[1]
    blocks = np.asarray(group["block"])
    sets = [np.frombuffer(x, np.uint64) for x in group["hashes"].to_pylist()]
    sizes = np.array([len(x) for x in sets])
    offsets = np.r_[0, np.cumsum(sizes)]
    every = np.concatenate(sets)
    regs, code = hmh.registers(offsets, every), np.unique(every, return_inverse=True)[1]
    keys, own = None, np.zeros(int(code.max()) + 1 if len(code) else 1, bool)
    left, right = [], []
    first, last = blocks.min(), blocks.max()
    order = np.argsort(sizes, kind="stable")
    ordered = sizes[order]
    for i in np.nonzero(blocks == first)[0]:
        a, b = np.searchsorted(ordered, [sizes[i] * percent / 100 - 1, sizes[i] * 100 / percent + 1])
        other = order[a:b]
        other = other[(comps[other] != comps[i]) & ((blocks[other] == last) if first != last else (other > i))]
        if len(other):
            j, error = hmh.estimate(regs[i][None], regs[other], float(sizes[i]), sizes[other].astype(float))
            other = other[j + margin * error >= percent / 100]
        if len(other):
            keys = hmh.band_keys(regs) if keys is None else keys
            other = other[keys[i][(keys[i] == keys[other]).argmax(1)] == band]
        if len(other):
            own[code[offsets[i] : offsets[i + 1]]] = True
            # the others' shingles one set after another
            ends = np.cumsum(sizes[other])
            at = np.repeat(offsets[other] - (ends - sizes[other]), sizes[other]) + np.arange(ends[-1])
            same = np.add.reduceat(own[code[at]].astype(np.int64), ends - sizes[other])
            own[code[offsets[i] : offsets[i + 1]]] = False
            for o in other[100 * same >= percent * (sizes[i] + sizes[other] - same)]:
                if comps[o] != comps[i]:
                    left.append(i)
                    right.append(o)
                    comps[comps == comps[o]] = comps[i]
    take = lambda x: ids.take(pa.array(np.array(x, np.int64)))
    return pa.table([take(left), take(right)], names=["a", "b"])


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, margin: float = MARGIN, block: int = BLOCK) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    every = checkpoint(sketches(docs, id_col, text_col))
    linked = every.where("n > 0 and id is not null")
    classes = checkpoint(linked.groupBy("k1", "k2").agg(F.min("id").alias("rep")), narrow=True)
    reps = checkpoint(linked.join(classes, ["k1", "k2"]).where("id = rep").dropDuplicates(["id", "k1", "k2"]).select("id", "n", "sketch", "bands"))

    # ids of rows with different sets tie the classes of these sets together
    key = F.struct("k1", "k2", "n")
    several = checkpoint(every.where("id is not null").groupBy("id").agg(F.min(key).alias("low"), F.max(key).alias("high")).where("low <> high").select("id"), narrow=True)
    torn = several.count()
    own = linked.select("id", "k1", "k2").distinct()
    ties = own.join(F.broadcast(several) if torn <= BROADCAST_ROWS else several, "id", "left_semi").join(classes, ["k1", "k2"]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct()

    bands = reps.select("id", "n", F.explode("bands").alias("band"))
    heads = bands.groupBy("band").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("shingles")).where("k > 1")
    met = checkpoint(bands.join(heads, "band").select("band", "id", "head", "k", "shingles"))
    stars = met.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    links = confirmed(plausible(stars, reps, percent, margin), docs, id_col, text_col, percent)
    if torn:
        links = links.unionByName(checkpoint(ties, narrow=True))
    comps = checkpoint(components(links), narrow=True)

    told = met.join(comps.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = told.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band")
    parts = F.greatest(F.ceil(F.col("k") / block), F.least(F.ceil(F.col("shingles") / SHINGLES), F.col("k"))).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(3)), parts).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    told = checkpoint(told.join(mixed, "band", "left_semi"), narrow=True)
    sets = full_sets(told.select("id").distinct(), docs, id_col, text_col)
    members = told.withColumn("parts", parts).withColumn("own", own).select("band", "id", "component", F.col("own").alias("block"), F.explode(F.array_distinct(cells)).alias("cell"))
    rows = members.join(sets.where(F.length("hashes") > 0), "id").select("band", "cell.i", "cell.j", "id", "component", "block", "hashes")

    def across(group: pa.Table) -> pa.Table:
        return _across(group, percent, margin)

    more = rows.groupBy("band", "i", "j").applyInArrow(across, f"a {kind}, b {kind}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = links.unionByName(checkpoint(more.distinct(), narrow=True))
    final = components(links)

    out = every.select("id", "n", "k1", "k2").join(classes, (every["k1"] == classes["k1"]) & (every["k2"] == classes["k2"]) & (every["n"] > 0) & every["id"].isNotNull(), "left").select("id", "n", "rep")
    out = out.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left")
    out = out.withColumn("component", F.coalesce("component", "rep", "id"))
    if torn:  # a row without words has no class, but another row of its id may have one
        tied = final.select(F.col("node").alias("id"), F.col("component").alias("tied")).join(F.broadcast(several) if torn <= BROADCAST_ROWS else several, "id", "left_semi")
        out = out.join(tied, "id", "left").withColumn("component", F.least("component", "tied"))
    component = F.col("component")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
