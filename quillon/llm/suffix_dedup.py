"""Removal of bytes covered by a 400-byte string that also starts elsewhere, by sharded suffix arrays.

A suffix array over a whole corpus fits no machine, so its suffixes are dealt out by cores that equal strings share:

1. Anchors. Of all 200-byte windows within a 400-byte string, the last one with the least hash is its anchor. Equal strings
   have equal anchors at equal distances, so strings that repeat meet under one anchor, with no text in between.
   Anchors that occur once are dropped.
2. Nodes. A node is a core (at first an anchor) and the range of distances at which 400-byte strings lie around it; a place's
   extent is the 600 bytes (less at a text's ends) that hold all these strings. Places of equal extents are counted before
   they move: two stand for any number.
3. Suffix arrays. The different extents of a node meet in a shard, those that occur more often twice. An extent is cut into
   blocks at fixed distances from its core; the blocks are the symbols of a suffix array built by grouping
   (suffix_array.py); one that meets no other is a single symbol. Neighbours of the array that share all symbols are copies: all strings of the extent repeat. Runs of
   neighbours that share as many blocks as must lie within a common 400-byte string are compared byte by byte, each with
   what shares a string with it, which gives the bytes that both lose.
4. Every text meets its spans once; they are merged and cut out.

A node with more than ``MANY`` different extents isn't dealt to a shard: its range is cut into smaller ones, whose cores are
longer and whose extents are shorter, so that more of them are equal and fewer cores are; again, down to single strings, whose
extent is the core. So no shard holds an unbounded node, and all nodes' strings are decided by suffix arrays.

Defined results: a null text is empty; matches don't cross texts; a row that repeats another's id and text is another
place of its strings; texts under 400 bytes lose nothing. Anchors are found by a 64-bit hash, equal extents by 128 bits of a
cryptographic one; spans within different extents are decided by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bytes_of, checkpoint, column_of, drop_caches, map_pieces, pieces
from quillon.llm.suffix_array import suffix_array

LENGTH = 400  # bytes of a string that may not repeat
ANCHOR = 200
SIDE = LENGTH - ANCHOR
#: Widths of the ranges of distances: each is cut into the next.
RANGES = [SIDE, 100, 50, 25, 5, 1, 0]
#: Different extents of a node beyond which its range is cut.
MANY = 1000
#: Extents after which a shard is closed, at the next change of node.
SHARD = 4000
#: Candidate anchors (8 bytes each) that may be broadcast; beyond, it is a shuffled join.
BROADCAST_ROWS = 2_000_000
#: Places (about 100 bytes each) that may be broadcast to fetch their texts; beyond, the texts are shuffled to them.
FEW_PLACES = 200_000

_B = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))
_MAX = np.uint64(2**64 - 1)
#: Bits that hold a place while the least hash of each window is looked for, and how many places are looked at together.
_PLACE = np.uint64(2**28 - 1)
SEGMENT = 1 << 27
#: Bytes of text whose windows are hashed at a time: small enough for a core's cache.
PIECE = 512 << 10


def _table() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    for _ in range(2):
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


_BYTES = _table()


def _powers(n: int, base: np.uint64 = _B) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(31)


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of each window of w values."""
    n = len(x)
    rows = np.concatenate([x, np.full(-n % w, _MAX)]).reshape(-1, w)
    left = np.minimum.accumulate(rows, 1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, anchor hash) of all anchors, ascending."""
    use = [i for i, t in enumerate(texts) if len(t) >= LENGTH]
    none = (np.zeros(0, np.int64),) * 3
    if not use:
        return none
    raw = np.frombuffer(b"".join(texts[i] for i in use), np.uint8)
    size = np.array([len(texts[i]) for i in use])
    ends = np.cumsum(size)
    starts = ends - size
    n = len(raw)
    power, inverse = _powers(n), _powers(n, _INVERSE)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[raw] * power[:n], out=prefix[1:])
    h = _mixed((prefix[ANCHOR:] - prefix[:-ANCHOR]) * inverse[: n - ANCHOR + 1])
    w = LENGTH - ANCHOR + 1
    doc = np.repeat(np.arange(len(use)), size)
    chosen = []
    for a in range(0, n - LENGTH + 1, SEGMENT):
        own = h[a : a + SEGMENT + w - 1]
        # the upper bits of the hash, then the place, later ones first
        keyed = own & ~_PLACE | _PLACE - np.arange(len(own), dtype=np.uint64)
        least = sliding_least(keyed, w)
        at = a + np.arange(len(least))
        least = least[at + LENGTH <= ends[doc[at]]]
        if len(least):
            least = least[np.r_[True, least[1:] != least[:-1]]]
            chosen.append(a + (_PLACE - (least & _PLACE)).astype(np.int64))
    pos = np.unique(np.concatenate(chosen))
    d = doc[pos]
    return np.array(use)[d], pos - starts[d], h[pos].view(np.int64)


def _digest(*parts: bytes) -> bytes:
    """128 bits."""
    return hashlib.blake2b(b"".join(parts), digest_size=16).digest()


def extent(text: bytes, at: int, near: int, far: int) -> tuple[int, bytes]:
    """(bytes before the core, extent) around an anchor at ``at``, for strings that begin ``near`` to ``far`` bytes before it."""
    low = max(0, at - far)
    return at - near - low, text[low : at - near + LENGTH]


def children(near: int, far: int) -> list[tuple[int, int]]:
    """The smaller ranges of distances that a range is cut into; their ends overlap."""
    step = RANGES[RANGES.index(far - near) + 1]
    return [(x, x + step) for x in range(near, far, step)] if step else [(near, near), (far, far)]


def repeated(nodes: np.ndarray, width: int, lefts: np.ndarray, extents: list[bytes], copies: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """(whether all strings of an extent repeat, as copies do; spans from the core's start that others of its node share).

    width: of the range of distances; lefts: bytes before the core; copies: extents that occur twice or more.
    """
    m, core = len(extents), LENGTH - width
    raw = np.zeros((m, LENGTH + width), np.uint8)
    for k, (left, x) in enumerate(zip(lefts.tolist(), extents)):
        raw[k, width - left : width - left + len(x)] = np.frombuffer(x, np.uint8)
    low = width - lefts
    high = low + np.array([len(x) for x in extents])
    blocks = 0 if not width else 1 if width % 2 else 2  # on either side of the core
    size = width // blocks if blocks else 0

    # symbols: blocks before the core, the node, blocks behind it; a block that isn't whole is like no other's
    power = _powers(size)
    hashes = [_mixed((_BYTES[x.reshape(m, blocks, size)] * power[:size]).sum(2, dtype=np.uint64)) for x in (raw[:, :width], raw[:, LENGTH:])]
    node = np.unique(nodes, return_inverse=True)[1].astype(np.uint64)
    symbols = np.concatenate([hashes[0], _mixed(node + np.uint64(5))[:, None], hashes[1]], 1)
    at = np.arange(blocks) * size
    broken = np.concatenate([at < low[:, None], np.zeros((m, 1), bool), at + LENGTH + size > high[:, None]], 1)
    codes = np.unique(symbols, return_inverse=True)[1].reshape(symbols.shape).astype(np.int64) + 1
    codes[broken] = codes.max(initial=0) + 1 + np.arange(broken.sum())
    own = np.concatenate([np.arange(m), np.nonzero(copies)[0]])  # of each row of symbols, its extent
    k = codes.shape[1]
    padded = np.concatenate([codes[own], np.zeros((len(own), 1), np.int64)], 1)
    row, column = np.divmod(suffix_array(padded.ravel()), k + 1)

    whole, runs = np.zeros(m, bool), []
    for c in range(blocks + 1):
        r = row[column == c]
        if not len(r):
            continue
        a, b = padded[r[:-1], c:-1], padded[r[1:], c:-1]
        shared = np.where((a == b).all(1), k - c, (a != b).argmax(1))
        if c == 0:
            same = (shared == k) & (own[r[:-1]] == own[r[1:]])
            whole[own[r[1:]][same]] = True
        else:  # blocks - c before the core, the core, c - 1 behind it
            run = np.cumsum(np.r_[True, shared < blocks])
            runs.append(np.unique(np.stack([np.full(len(r), c), run, own[r]]), axis=1))
    spans: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    if not runs:
        return whole, spans
    c, run, member = np.concatenate(runs, 1)
    run = np.unique(c * (len(own) + 1) + run, return_inverse=True)[1]
    x, y, of, claimed = _pairs(blocks - c, run, member, raw, low, high, width, size)
    (x, y), back = np.unique(np.sort(np.stack([x, y]), axis=0), axis=1, return_inverse=True)
    good = np.zeros(len(x), bool)
    for a in range(0, len(x), 4000):
        p, q = x[a : a + 4000], y[a : a + 4000]
        before, behind, whole_string = matched(raw, low, high, p, q, width)
        good[a : a + 4000] = whole_string
        for k in np.nonzero(whole_string)[0].tolist():
            span = (-int(before[k]), core + int(behind[k]))
            spans[p[k]].append(span)
            spans[q[k]].append(span)
    for one in np.unique(of[claimed & ~good[back.ravel()]]):  # strings of equal hash that differ
        _by_bytes(member[run == one], raw, low, high, width, spans)
    return whole, spans


def _pairs(left: np.ndarray, run: np.ndarray, member: np.ndarray, raw: np.ndarray, low: np.ndarray, high: np.ndarray, width: int, size: int) -> tuple[np.ndarray, ...]:
    """(x, y, run, claimed): pairs of a run's members such that each string that a member shares is shared with a partner.

    Two members are a pair, to be compared (not claimed). Of more, each is paired, for every string that the run's blocks
    (``left`` of them before the core) leave room for, with the first that has the string's hash.
    """
    order = np.lexsort((member, run))
    left, run, member = left[order], run[order], member[order]
    begin = np.nonzero(np.r_[True, run[1:] != run[:-1]])[0]
    count = np.diff(np.r_[begin, len(run)])
    two = begin[count == 2]
    many = np.repeat(count > 2, count)
    found = [np.stack([member[two], member[two + 1], run[two], np.zeros(len(two), np.int64)])]
    left, run, member = left[many], run[many], member[many]
    if len(run):
        own, row = np.unique(member, return_inverse=True)
        power = _powers(raw.shape[1])
        prefix = np.zeros((len(own), raw.shape[1] + 1), np.uint64)
        np.cumsum(_BYTES[raw[own]] * power[:-1], axis=1, out=prefix[:, 1:])
        for t in range(size + 1):
            start = width - left * size - t
            some = np.nonzero((start >= low[member]) & (start + LENGTH <= high[member]))[0]
            start = start[some]
            h = (prefix[row[some], start + LENGTH] - prefix[row[some], start]) * power[raw.shape[1] - start]
            h = _mixed(h ^ _mixed(run[some].astype(np.uint64) + np.uint64(1)))
            _, first, back = np.unique(h, return_index=True, return_inverse=True)
            x, y = member[some], member[some][first[back]]
            pair = np.stack([x, y, run[some], np.ones(len(x), np.int64)])[:, x != y]
            found.append(np.unique(pair, axis=1) if pair.shape[1] else pair)
    every = np.concatenate(found, 1)
    x, y, run, claimed = np.unique(every, axis=1) if every.shape[1] else every
    return x, y, run, claimed.astype(bool)


def matched(raw: np.ndarray, low: np.ndarray, high: np.ndarray, x: np.ndarray, y: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair: equal bytes before the core and behind it, and whether the core is equal and some whole string is."""
    at = np.arange(raw.shape[1])
    equal = (raw[x] == raw[y]) & (at >= np.maximum(low[x], low[y])[:, None]) & (at < np.minimum(high[x], high[y])[:, None])
    first = lambda e: np.where(e.all(1), e.shape[1], e.argmin(1)) if e.shape[1] else np.zeros(len(x), np.int64)
    before, behind = first(equal[:, :width][:, ::-1]), first(equal[:, LENGTH:])
    return before, behind, equal[:, width:LENGTH].all(1) & (before + behind >= width)


def _by_bytes(members: np.ndarray, raw: np.ndarray, low: np.ndarray, high: np.ndarray, width: int, spans: list[list[tuple[int, int]]]) -> None:
    """Add the strings that members share, one start at a time."""
    for start in range(width + 1):
        having: dict[bytes, list[int]] = {}
        for i in members.tolist():
            if low[i] <= start and start + LENGTH <= high[i]:
                having.setdefault(raw[i, start : start + LENGTH].tobytes(), []).append(i)
        for own in having.values():
            for i in own if len(own) > 1 else ():
                spans[i].append((start - width, start - width + LENGTH))


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _anchor_rows(docs: DataFrame, count_only: bool) -> DataFrame:
    """Anchors of every text: (node, k) counted by piece, or (node, e1, e2, id, mark, at, near, far, k) of each place."""
    kind = docs.schema["id"].dataType.simpleString()

    def make():
        drop_caches()

        def run(piece: pa.RecordBatch) -> pa.RecordBatch:
            texts = [x or b"" for x in bytes_of(piece, "text")]
            doc, pos, anchor = anchors(texts)
            if count_only:
                value, k = np.unique(anchor, return_counts=True)
                return pa.RecordBatch.from_arrays([pa.array(value, pa.int64()), pa.array(k, pa.int64())], names=["node", "k"])
            return _places(piece, texts, doc.tolist(), pos.tolist(), anchor, [0] * len(doc), [SIDE] * len(doc), [1] * len(doc))

        return run

    return map_pieces(docs, "text", make, "node long, k long" if count_only else _PLACES.format(kind=kind), PIECE)


_PLACES = "node long, e1 long, e2 long, id {kind}, mark long, at int, near int, far int, k long"


def _places(piece: pa.RecordBatch, texts: list[bytes], doc: list[int], at: list[int], node: np.ndarray, near: list[int], far: list[int], k: list[int]) -> pa.RecordBatch:
    keys = []
    for i, p, a, b in zip(doc, at, near, far):
        left, x = extent(texts[i], p, a, b)
        keys.append(_digest(left.to_bytes(2, "little"), x))
    e = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
    take = pa.array(doc, pa.int64())
    columns = [pa.array(node, pa.int64()), pa.array(e[:, 0]), pa.array(e[:, 1]), column_of(piece, "id").take(take), column_of(piece, "mark").take(take), pa.array(at, pa.int32()), pa.array(near, pa.int32()), pa.array(far, pa.int32()), pa.array(k, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["node", "e1", "e2", "id", "mark", "at", "near", "far", "k"])


def _asked(docs: DataFrame, extents: DataFrame, few: bool = False) -> DataFrame:
    """(id, mark, text, asked) of the texts that have the first place of these extents."""
    asked = extents.select("first.id", "first.mark", F.struct("deal", "node", "e1", "e2", "first.at", "first.near", "first.far", "k").alias("one")).groupBy("id", "mark").agg(F.collect_list("one").alias("asked"))
    asked = asked.withColumnsRenamed({"id": "__id", "mark": "__mark"})
    return docs.join(F.broadcast(asked) if few else asked, docs["id"].eqNullSafe(F.col("__id")) & (docs["mark"] == F.col("__mark"))).dropDuplicates(["id", "mark"]).select("id", "mark", "text", "asked")


def _cut(met: DataFrame) -> DataFrame:
    """The extents themselves, with where their core begins."""
    kind = met.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            texts = bytes_of(piece, "text")
            rows = [(i, x, *extent(texts[i], x["at"], x["near"], x["far"])) for i, asked in enumerate(column_of(piece, "asked").to_pylist()) for x in asked]
            doc, one, left, own = zip(*rows) if rows else ((), (), (), ())
            take = pa.array(doc, pa.int64())
            longs = [pa.array([x[c] for x in one], pa.int64()) for c in ("deal", "node", "e1", "e2")]
            columns = [*longs, pa.array([x["far"] - x["near"] for x in one], pa.int32()), pa.array(left, pa.int32()), pa.array(own, pa.binary()), column_of(piece, "id").take(take), column_of(piece, "mark").take(take), pa.array([x["at"] - x["near"] for x in one], pa.int32()), pa.array([x["k"] > 1 for x in one], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["deal", "node", "e1", "e2", "width", "left", "bytes", "id", "mark", "core", "copies"])

    return met.mapInArrow(run, f"deal long, node long, e1 long, e2 long, width int, left int, bytes binary, id {kind}, mark long, core int, copies boolean")


def _smaller(met: DataFrame) -> DataFrame:
    """The places in smaller ranges: of each, the strings' common core is the node."""
    kind = met.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            texts = bytes_of(piece, "text")
            rows, nodes = [], []
            for i, asked in enumerate(column_of(piece, "asked").to_pylist()):
                for x in asked:
                    p, n = x["at"], len(texts[i])
                    for near, far in children(x["near"], x["far"]):
                        if near <= p and p - far + LENGTH <= n:
                            nodes.append(_digest(near.to_bytes(2, "little"), far.to_bytes(2, "little"), texts[i][p - near : p - far + LENGTH])[:8])
                            rows.append((i, p, near, far, x["k"]))
            if rows:
                doc, at, near, far, k = map(list, zip(*rows))
                yield _places(piece, texts, doc, at, np.frombuffer(b"".join(nodes), "<i8"), near, far, k)

    return met.mapInArrow(run, _PLACES.format(kind=kind))


def _shards(dealt: DataFrame) -> DataFrame:
    """(whole, node, e1, e2, id, mark, low, high): extents whose places all lose it, or the spans that a single place loses."""
    kind = dealt.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, last = 0, None
        for piece in pieces(batches, "bytes", 2 << 20):
            nodes = np.asarray(column_of(piece, "deal"))
            if n >= SHARD:
                change = np.nonzero(nodes != last)[0]
                if len(change):
                    held.append(piece.slice(0, change[0]))
                    yield shard(held)
                    held, n, piece = [], 0, piece.slice(change[0])
            held.append(piece)
            n += piece.num_rows
            last = nodes[-1]
        if held:
            yield shard(held)

    def shard(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        width, copies, core = (np.asarray(t[c]) for c in ("width", "copies", "core"))
        nodes, lefts, own = np.asarray(t["deal"]), np.asarray(t["left"]).astype(np.int64), t["bytes"].to_pylist()
        rows: list[tuple[bool, int, int, int]] = []
        for w in np.unique(width).tolist():
            some = np.nonzero(width == w)[0]
            whole, spans = repeated(nodes[some], w, lefts[some], [own[i] for i in some], copies[some])
            rows += [(True, int(i), 0, 0) for i in some[whole]]
            rows += [(False, int(i), int(core[i]) + a, int(core[i]) + b) for i, found in zip(some, spans) if not copies[i] for a, b in _merge(found)]
        all_, at, low, high = zip(*rows) if rows else ((), (), (), ())
        take = pa.array(at, pa.int64())
        kept = [t[c].combine_chunks().take(take) for c in ("node", "e1", "e2", "id", "mark")]
        return pa.RecordBatch.from_arrays([pa.array(all_, pa.bool_()), *kept, pa.array(low, pa.int32()), pa.array(high, pa.int32())], names=["whole", "node", "e1", "e2", "id", "mark", "low", "high"])

    return dealt.mapInArrow(run, f"whole boolean, node long, e1 long, e2 long, id {kind}, mark long, low int, high int")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(id, mark, spans) of the texts in docs (id, mark, text) that lose bytes; the spans aren't merged yet."""
    shared = checkpoint(_anchor_rows(docs, True).groupBy("node").agg(F.sum("k").alias("k")).where("k > 1").select("node"))
    rows = checkpoint(_anchor_rows(docs, False).join(F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared, "node", "left_semi"))
    places, dealt, few = rows, None, False
    while True:
        extents = checkpoint(rows.groupBy("node", "e1", "e2").agg(F.sum("k").alias("k"), F.min(F.struct("id", "mark", "at", "near", "far")).alias("first")))
        nodes = extents.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        nodes = checkpoint(nodes, narrow=True)  # with several extents
        count, hot_count, several = nodes.agg(F.count(F.lit(1)), F.count_if(F.col("n") > MANY), F.coalesce(F.sum(F.when(F.col("n") > MANY, F.col("n"))), F.lit(0))).first()
        hot, every, met = (nodes.where(c).select("node") for c in (F.col("n") > MANY, F.lit(True), F.col("n") <= MANY))
        if count <= BROADCAST_ROWS:
            hot, every, met = map(F.broadcast, (hot, every, met))
        # copies that meet no other extent, or whose node is cut, are decided by themselves: their text isn't needed
        copies = extents.where("k > 1")
        alone = copies.join(every, "node", "left_anti")
        if hot_count:
            alone = alone.unionByName(copies.join(hot, "node", "left_semi"))
        alone = alone.select(F.xxhash64("node", "e1", "e2").alias("deal"), "node", "e1", "e2", F.lit(0).alias("width"), F.lit(0).alias("left"), F.lit(b"").alias("bytes"), "first.id", "first.mark", F.col("first.at").alias("core"), F.lit(True).alias("copies"))
        own = _cut(_asked(docs, extents.join(met, "node", "left_semi").withColumn("deal", F.col("node")), few)).unionByName(alone)
        dealt = own if dealt is None else dealt.unionByName(own)
        if not hot_count:
            break
        cut = extents.join(hot, "node", "left_semi").withColumn("deal", F.col("node"))
        rows = checkpoint(_smaller(_asked(docs, cut, several <= FEW_PLACES)))
        few = rows.count() <= FEW_PLACES
        places = places.unionByName(rows)
    found = checkpoint(_shards(dealt.repartition("deal").sortWithinPartitions("deal")))
    whole = places.where("k = 1").join(found.where("whole").select("node", "e1", "e2"), ["node", "e1", "e2"])
    whole = whole.select("id", "mark", F.struct((F.col("at") - F.col("far")).alias("low"), (F.col("at") - F.col("near") + LENGTH).alias("high")).alias("span"))
    spans = whole.unionByName(found.where("not whole").select("id", "mark", F.struct("low", "high").alias("span")))
    return spans.groupBy("id", "mark").agg(F.collect_set("span").alias("spans"))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, [kept, spans]) of every row: spans are the maximal removed runs of bytes."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).cast("binary").alias("text"))
    spans = repeated_spans(texts).withColumnsRenamed({"id": "__id", "mark": "__mark"})
    met = texts.join(spans, texts["id"].eqNullSafe(F.col("__id")) & (texts["mark"] == F.col("__mark")), "left").select("id", "text", "spans")
    more = [("kept", pa.binary()), ("removed", pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())])))]

    def make():
        def run(piece: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            for text, found in zip(bytes_of(piece, "text"), column_of(piece, "spans").to_pylist()):
                text = text or b""
                gone = _merge([(max(0, s["low"]), min(len(text), s["high"])) for s in found or ()])
                kept, at = [], 0
                for a, b in gone:
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                left = b"".join(kept)
                out.append((len(text), len(text) - len(left), len(gone), hashlib.sha256(left).hexdigest(), left if with_text else None, [{"low": a, "high": b} for a, b in gone] if with_text else None))
            columns = list(zip(*out))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *(t for _, t in more)]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(n for n, _ in more)]
            keep = len(types) if with_text else 4
            return pa.RecordBatch.from_arrays([column_of(piece, "id"), *(pa.array(c, t) for c, t in list(zip(columns, types))[:keep])], names=[id_col, *names[:keep]])

        return run

    schema = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, removed array<struct<low:int,high:int>>" * with_text
    return map_pieces(met, "text", make, schema)
