"""Near-duplicate documents by SimHash fingerprints, linked at a few differing bits by generalised pigeonhole.

1. A text's fingerprint: the XXH64 of each of its 3-word shingles vote on 64 bits. Equal fingerprints are one class, whose
   representative is its least id; only classes go on.
2. Bits that are correlated, on a sample of fingerprints, are grouped into partitions. For m partitions and distance t,
   thresholds T_i >= -1 that sum to t - m + 1 lose nothing: fingerprints within t bits differ by T_i bits at most in some
   partition. Each fingerprint gets the thresholds of the least cost, by dynamic programming over the partitions: cost is the
   number of its probes, and of the candidates that the sample makes expect there. m is the one of the least mean cost, so
   a large corpus gets wide partitions and more probes, a small one narrow partitions.
3. Fingerprints stand under their value in every partition and probe all values within their thresholds there: the cells in
   which they meet. In a cell all distances are computed on full fingerprints, and a spanning forest of its links is
   emitted, one link a member at most.
4. A cell of more than ``BLOCK`` members is cut by the bits that it doesn't fix yet: t + 1 further partitions, in each of
   which members must agree, and again, until no cell is larger. (t less the bits by which a probe differs already + 1 of
   them are enough.) Cells of under ``FREE`` free bits can't hold many fingerprints and are left.
5. Components of the links give each document the least id reachable.

Defined results: words are compared after A-Z became a-z; fewer words than a shingle has are one shingle; without words or
text the fingerprint is 0, and is linked like any other; rows of equal id are one node, whatever their texts; a row
without id has a fingerprint, is linked with nothing and has no component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bytes_of, checkpoint, column_of, map_pieces, sample_rows
from quillon.llm.components import components
from quillon.llm.hyperminhash import mix

WORDS, SEED, BITS, DISTANCE = 3, 42, 64, 2
#: Fingerprints that correlations and candidates are estimated on, about.
SAMPLE = 2048
#: What a probe costs, in comparisons.
PROBE = 200
#: Members of a cell; free bits of a cell that isn't cut further; rows that may be broadcast to a join.
BLOCK, FREE, BROADCAST_ROWS = 512, 9, 1_000_000
#: A fingerprint is common if it has more than one in so many rows; there can't be more common ones than that.
COMMON = 10_000
_LOWER = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))
_ONE = np.uint64(1)


def fingerprint(text: bytes | None, words: int = WORDS, block: int = 1 << 16) -> int:
    parts = (text or b"").translate(_LOWER).split()
    if not parts:
        return 0
    line = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size + 1) - 1
    starts, n = ends - size, max(1, len(parts) - words + 1)
    stops = ends[min(words, len(parts)) - 1 :]
    votes = np.zeros(BITS, np.int64)
    for a in range(0, n, block):
        own = map(slice, starts[a : min(n, a + block)].tolist(), stops[a : a + block].tolist())
        h = np.fromiter(map(xxhash.xxh64_intdigest, map(line.__getitem__, own), repeat(SEED)), np.uint64)
        votes += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << int(b) for b in np.nonzero(2 * votes > n)[0]))


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp) of every row."""

    def make():
        def run(piece: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint(t) for t in bytes_of(piece, text_col)], np.uint64)
            return pa.RecordBatch.from_arrays([column_of(piece, id_col), pa.array(fps.view(np.int64))], names=["id", "fp"])

        return run

    return map_pieces(docs.select(id_col, text_col), text_col, make, f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


def bit_groups(sample: np.ndarray, parts: int) -> list[np.ndarray]:
    """The bits in groups of equal size, each grown by the bit that is most correlated with those in it."""
    x = (sample[:, None] >> np.arange(BITS, dtype=np.uint64) & _ONE).astype(float)
    x -= x.mean(0) if len(x) else 0
    spread = np.sqrt((x * x).sum(0))
    tied = np.abs(x.T @ x) / np.maximum(np.outer(spread, spread), 1e-9)
    tied[np.ix_(spread < 1e-9, spread < 1e-9)] = 1  # bits that are the same everywhere tell nothing, wherever they are
    left, out = list(range(BITS)), []
    for p in range(parts, 0, -1):
        group = [max(left, key=lambda b: (tied[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < round((len(left) + len(group)) / p):
            group.append(max(left, key=lambda b: (tied[b, group].sum(), -b)))
            left.remove(group[-1])
        out.append(np.array(group, np.uint64))
    return out


def ball(bits: int, radius: int) -> int:
    return sum(comb(bits, r) for r in range(radius + 1))


def mask_of(bits: np.ndarray) -> np.uint64:
    return np.bitwise_or.reduce(_ONE << bits, initial=np.uint64(0))


@dataclass
class Pigeonhole:
    groups: list[np.ndarray]
    sample: np.ndarray
    total: int
    distance: int

    def costs(self, fps: np.ndarray) -> np.ndarray:
        """(fingerprints, partitions, distance + 2): cost of the thresholds -1, 0, .."""
        out = np.zeros((len(fps), len(self.groups), self.distance + 2))
        share = self.total / max(1, len(self.sample))
        for i, g in enumerate(self.groups):
            mask = mask_of(g)
            d = np.bitwise_count((fps & mask)[:, None] ^ (self.sample & mask))
            for t in range(self.distance + 1):
                near = ball(len(g), t)
                out[:, i, t + 1] = near * PROBE + share * (d <= t).sum(1) + self.total * near / 2 ** len(g)
        return out

    def thresholds(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprints, partitions) thresholds of the least cost, and that cost."""
        costs = self.costs(fps)
        n, m, w = costs.shape
        best = np.full((n, w), np.inf)
        best[:, 0] = 0
        chosen = np.zeros((m, n, w), np.int64)
        for i in range(m):  # best[:, s]: the partitions so far have thresholds that sum to s - (their number)
            ways = np.full((n, w, w), np.inf)
            for j in range(w):
                ways[:, j:, j] = best[:, : w - j] + costs[:, i, j, None]
            chosen[i], best = ways.argmin(2), ways.min(2)
        out, s = np.zeros((n, m), np.int64), np.full(n, w - 1)
        for i in reversed(range(m)):
            j = chosen[i][np.arange(n), s]
            out[:, i] = j - 1
            s = s - j
        return out, best[:, w - 1]

    def entries(self, fps: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row of the fingerprint, cell, fixed bits, whether it stands there, and bits by which it may differ elsewhere (-1: it doesn't probe)."""
        limits = self.thresholds(fps)[0]
        rows, cells, fixed, stands, slack = [], [], [], [], []
        for i, g in enumerate(self.groups):
            mask = mask_of(g)
            for r in range(self.distance + 1):
                at = np.arange(len(fps)) if r == 0 else np.nonzero(limits[:, i] >= r)[0]
                if not len(at):
                    continue
                flips = np.array([mask_of(g[list(c)]) for c in combinations(range(len(g)), r)], np.uint64)
                value = (fps[at] & mask)[:, None] ^ flips
                rows.append(np.repeat(at, len(flips)))
                cells.append(cell_of(np.uint64(i), value).ravel())
                stands.append(np.full(value.size, r == 0))
                slack.append(np.repeat(np.where(limits[at, i] >= r, self.distance - r, -1), len(flips)))
                fixed.append(np.full(value.size, mask))
        return tuple(np.concatenate(x) for x in (rows, cells, fixed, stands, slack))


def cell_of(place: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mix(mix(np.atleast_1d(place) + np.uint64(0x9E3779B97F4A7C15)) ^ mix(value))


def plan_for(sample: np.ndarray, total: int, distance: int = DISTANCE, parts: int | None = None) -> Pigeonhole:
    """The partitions of the least mean cost on the sample."""
    plans = [Pigeonhole(bit_groups(sample, m), sample, total, distance) for m in ([parts] if parts else range(1, distance + 3))]
    return min(plans, key=lambda p: p.thresholds(sample[:256])[1].mean() if len(sample) else 0)


def finer(order: np.ndarray, cells: np.ndarray, fixed: np.ndarray, fps: np.ndarray, stands: np.ndarray, slack: np.ndarray, distance: int) -> tuple[np.ndarray, ...]:
    """The entries (row, cell, fixed bits, stands, slack) of cells that are cut by their free bits."""
    out: list[list[np.ndarray]] = [[] for _ in range(5)]
    for f in np.unique(fixed):
        at = np.nonzero(fixed == f)[0]
        free = order[(f >> order & _ONE) == 0]
        for j, g in enumerate(np.array_split(free, distance + 1)):
            mask = mask_of(g)
            probes = slack[at] >= j  # slack + 1 partitions are enough
            own = at[stands[at] | probes]
            for x, v in zip(out, (own, cell_of(cells[own] + np.uint64(j), fps[own] & mask), np.full(len(own), f | mask), stands[own], np.where(slack[own] >= j, slack[own], -1))):
                x.append(v)
    return tuple(np.concatenate(x) for x in out)


def forest(fps: np.ndarray, distance: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Positions (root, member) of a spanning forest of the links between the fingerprints."""
    roots, members = [], []
    left = np.arange(len(fps))
    while len(left) > 1:
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for a in range(0, len(front), block):
                near |= (np.bitwise_count(fps[left][:, None] ^ fps[front[a : a + block]]) <= distance).any(1)
            front, left = left[near], left[~near]
            members.append(front)
            roots.append(np.full(len(front), root))
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(roots), join(members)


def _u64(piece: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(column_of(piece, name)).view(np.uint64)


def _met(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links of the cells of sorted rows; a cell may go on in the next batch."""
    kept: pa.Table | None = None

    def links(rows: pa.Table) -> pa.RecordBatch:
        batch = rows.combine_chunks().to_batches()[0]
        cells, fps = _u64(batch, "cell"), _u64(batch, "fp")
        cuts = np.r_[0, np.nonzero(cells[1:] != cells[:-1])[0] + 1, len(cells)]
        a, b = [], []
        for x, y in zip(cuts[:-1], cuts[1:]):
            if y - x > 1:
                i, j = forest(fps[x:y], distance)
                a.append(i + x)
                b.append(j + x)
        ids = column_of(batch, "id")
        take = lambda x: ids.take(pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)))
        return pa.RecordBatch.from_arrays([take(a), take(b)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
        cells = np.asarray(rows["cell"])
        last = int(np.nonzero(cells != cells[-1])[0][-1]) + 1 if (cells != cells[-1]).any() else 0
        if last:
            yield links(rows.slice(0, last))
        kept = rows.slice(last)
    if kept is not None:
        yield links(kept)


def _entry_batch(rows: np.ndarray, cells: np.ndarray, fixed: np.ndarray, fps: np.ndarray, stands: np.ndarray, slack: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
    signed = lambda x: pa.array(x.view(np.int64))
    return pa.RecordBatch.from_arrays([signed(cells), signed(fixed), signed(fps[rows]), pa.array(stands), pa.array(slack.astype(np.int32)), ids.take(pa.array(rows))], names=["cell", "fixed", "fp", "stands", "slack", "id"])


def links_between(nodes: DataFrame, plan: Pigeonhole, block: int = BLOCK) -> DataFrame:
    """(a, b): links that tie together all (fp, id) nodes of which the fingerprints differ by ``plan.distance`` bits or fewer."""
    kind = nodes.schema["id"].dataType.simpleString()
    spark = nodes.sparkSession
    sent = spark.sparkContext.broadcast(plan)
    schema = f"cell long, fixed long, fp long, stands boolean, slack int, id {kind}"
    order = np.concatenate(plan.groups)
    distance = plan.distance
    fit = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                fps = _u64(batch, "fp")
                rows, cells, fixed, stands, slack = sent.value.entries(fps)
                yield _entry_batch(rows, cells, fixed, fps, stands, slack, column_of(batch, "id"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = _u64(batch, "fp")
            rows, cells, fixed, stands, slack = finer(order, _u64(batch, "cell"), _u64(batch, "fixed"), fps, np.asarray(column_of(batch, "stands").to_numpy(zero_copy_only=False)), np.asarray(column_of(batch, "slack")), distance)
            yield _entry_batch(rows, cells, fixed, fps, stands, slack, column_of(batch, "id"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _met(batches, distance)

    entries = checkpoint(nodes.select("fp", "id").mapInArrow(deal, schema))
    out = None
    while True:
        counts = entries.groupBy("cell").agg(F.count(F.lit(1)).alias("k"), F.max("stands").alias("stood"), F.max("slack").alias("most"), F.max(F.bit_count("fixed")).alias("bits"))
        useful = checkpoint(counts.where("k > 1 and stood and most >= 0").select("cell", ((F.col("k") > block) & (F.col("bits") <= BITS - FREE)).alias("hot")), narrow=True)
        cold = entries.join(fit(useful.where("not hot")), "cell", "left_semi").select("cell", "fp", "id")
        found = checkpoint(cold.repartition("cell").sortWithinPartitions("cell").mapInArrow(meet, f"a {kind}, b {kind}"), narrow=True)
        out = found if out is None else out.unionByName(found)
        hot = useful.where("hot")
        if hot.isEmpty():
            return out
        entries = checkpoint(entries.join(fit(hot), "cell", "left_semi").select("cell", "fixed", "fp", "stands", "slack", "id").mapInArrow(cut, schema))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, sample: int = SAMPLE, block: int = BLOCK, parts: int | None = None) -> DataFrame:
    """(id, fingerprint, component_id) of every row."""
    every = checkpoint(fingerprints(docs, id_col, text_col))
    known = every.where("id is not null")
    nodes = checkpoint(known.groupBy("fp").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("k")))
    some = sorted(r["fp"] for r in sample_rows(nodes, F.col("fp"), sample).select("fp").collect())
    total = nodes.count()
    plan = plan_for(np.array(some, np.int64).view(np.uint64), total, distance, parts)
    links = links_between(nodes, plan, block)

    # fingerprints of rows of one id are tied together
    several = checkpoint(known.groupBy("id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("id"), narrow=True)
    torn = several.count()
    if torn:
        own = known.join(F.broadcast(several) if torn <= BROADCAST_ROWS else several, "id", "left_semi").select("fp", F.col("id").alias("b")).distinct()
        ties = own.join(nodes.select("fp", F.col("id").alias("a")), "fp").where("a <> b").select("a", "b")
        links = links.unionByName(checkpoint(ties, narrow=True))
    comps = components(links)
    classes = checkpoint(nodes.join(comps.withColumnRenamed("node", "id"), "id", "left").select(F.col("fp"), "k", F.coalesce("component", "id").alias("component_id")))

    # rows of common fingerprints, COMMON at most, stay where they are; the others meet their class by hash
    common = F.col("k") * COMMON > (classes.agg(F.sum("k")).first()[0] or 0)
    hot = F.broadcast(classes.where(common).select("fp", "component_id"))
    rest = every.join(hot, "fp", "left_anti").join(classes.where(~common).select("fp", "component_id"), "fp", "left")
    out = every.join(hot, "fp").unionByName(rest)
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
