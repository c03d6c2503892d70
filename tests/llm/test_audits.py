"""The filter audit, the Merkle manifest and SimHash classes against brute force, and their edge cases."""

from __future__ import annotations

import random
import re
from collections import Counter
from hashlib import sha256
from itertools import permutations, product

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm import filter_audit, merkle, simhash_dedup


def same_rows(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


# 12 filter audit


def fails_by_hand(rows):
    """rows: (id, text, source, ...). The set of failed filters of each."""
    least = {}
    for r in rows:
        if r[0] is not None:
            t = r[1] or ""
            least[t] = min(least.get(t, r[0]), r[0])
    out = []
    for r in rows:
        t = r[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = set()
        if len(w) < 200:
            f.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            f.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t):
            f.add("C")
        if re.search(r"[#$%&*|]", t):
            f.add("D")
        if r[0] is not None and least[t] < r[0]:
            f.add("E")
        out.append(f)
    return out


def audit_by_hand(rows, labels):
    good, toxic = ({i for i, *v in labels if v[k] == 1} for k in (0, 1))
    found = list(zip(rows, fails_by_hand(rows)))
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], f) for r, f in found if (r[2] or "") == part]
        shapley = Counter()
        lines = []
        for order in permutations("ABCDE"):
            for k, letter in enumerate(order):
                before = set(order[:k])
                removed = [i for i, f in own if letter in f and not f & before]
                shapley[letter] += len(removed)
                lines.append(("".join(order), k + 1, letter, sum(not f & {*before, letter} for _, f in own), len(removed), sum(letter in f and bool(f & before) for _, f in own), sum(f == {letter} for _, f in own), sum(i in good for i in removed), sum(i in toxic for i in removed)))
        for order, step, letter, *counts in lines:
            yield (part, order, step, *counts, shapley[letter])


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_filter_audit(spark, parts):
    rng = random.Random(parts)
    pool = ["", "UPPER CASE", "a b " * 150, " ".join(f"w{i}" for i in range(250)), "with # mark", "x\x0by z é😀 \x1f", " ".join(f"W{i}" for i in range(300)) + " 100%", None]
    rows = [(i, rng.choice(pool), rng.choice(["web", "", None, "news"])) for i in range(60)]
    rows += [(i, "the same for many", "web") for i in range(100, 160)] + [(7, "the same for many", "web")] * 3  # over all partitions
    rows += [(None, "the same for many", "news"), (None, None, None), (200, "only once, " + "long " * 20_000, "long")]
    labels = [(i, i % 2, i % 3 == 0 or None) for i in range(0, 150, 2)] + [(100, 1, 0), (None, 1, 1), (4, None, 1)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, source string, part string, mask int, hash int").repartition(3)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = filter_audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    known = {}
    for i, q, t in labels:
        if i is not None:
            a = known.setdefault(i, [None, None])
            known[i] = [max((x for x in (a[0], q) if x is not None), default=None), max((x for x in (a[1], t) if x is not None), default=None)]
    same_rows(map(tuple, got), audit_by_hand(rows, [(i, *v) for i, v in known.items()]))


def test_filter_audit_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert filter_audit.filter_audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_runs_over_partitions():
    """A run of equal texts that fills whole partitions keeps its first least id."""
    told = [dict(pid=p, first_hash=a, last_hash=b, least=i, open=whole) for p, a, b, i, whole in ((0, "x", "y", 3, False), (1, "y", "y", 4, True), (2, "y", "y", 9, True), (5, "y", "z", 11, False), (6, "w", "w", 1, True))]
    assert filter_audit.carried(told) == [(1, 3), (2, 3), (5, 3)]


# 13 Merkle manifest


def h(*texts):
    return sha256("".join(texts).encode()).hexdigest()


def tree_by_hand(leaves):
    """(root, the siblings of each leaf)."""
    rows, at, proofs = [list(leaves)], list(range(len(leaves))), [[] for _ in leaves]
    while len(rows[-1]) > 1:
        level = rows[-1]
        for j, i in enumerate(at):
            if i ^ 1 < len(level):
                proofs[j].append((bool(i & 1), level[i ^ 1]))
            else:
                proofs[j].append((False, None))
            at[j] = i >> 1
        rows.append([h(*level[i : i + 2]) for i in range(0, len(level), 2)])
    return rows[-1][0], proofs


def manifest_by_hand(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    leaf = lambda r: h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in r))
    groups = {}
    for r in rows:
        groups.setdefault((r[2] is not None, (r[2] or "").encode()), []).append(((r[0] is not None, r[0] or 0), leaf(r), r[0]))
    roots, out = [], []
    for g in sorted(groups):
        own = sorted(groups[g], key=lambda x: x[:2])
        root, proofs = tree_by_hand([x[1] for x in own])
        roots.append(root)
        out.append([(x[2], x[1], root, p) for x, p in zip(own, proofs)])
    top, more = tree_by_hand(roots)
    return [(i, leaf_, root, top, p + m) for own, m in zip(out, more) for i, leaf_, root, p in own]


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_manifest(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice([None, *range(-5, 400)]), rng.choice(["web", None, ""]), rng.choice(["hot", "hot", "hot", None, "", "é", "z"]), rng.choice([None, 3, 10**12]), rng.choice([None, "", "é😀", "text " * 50])) for _ in range(500)]
    rows += [(1, "s", f"only{i}", 1, "x") for i in range(40)] + [(9, "same", "hot", 1, "row")] * 70
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, grp string, leaf string, proof string").repartition(4)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = merkle.manifest(docs, changed=F.when(F.col("doc_id") % 2 == 0, F.sha2(F.lit("forged"), 256))).withColumn("folded", merkle.folded(F.col("changed"), F.col("proof")))
        got = found.withColumn("digest", merkle.siblings_hash(F.col("proof"))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    want = manifest_by_hand(rows)
    same_rows([(r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(x) for x in r["proof"]]) for r in got], want)
    for r in got:
        assert r["digest"] == h(*(x["hash"] for x in r["proof"] if x["hash"]))
        forged = r["doc_id"] is not None and r["doc_id"] % 2 == 0
        assert r["changed"] == (h("forged") if forged else r["leaf"]) and (r["folded"] == r["root"]) == (not forged)


def test_manifest_of_few_rows(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert merkle.manifest(spark.createDataFrame([], schema)).count() == 0
    (one,) = merkle.manifest(spark.createDataFrame([(1, None, None, None, None)], schema)).collect()
    assert one["leaf"] == one["subroot"] == one["root"] == h("1:1", "-", "-", "-", "-") and one["proof"] == []


@pytest.mark.parametrize("seed", range(30))
def test_cut_trees(seed):
    """However leaves are cut into ranges, what the ranges tell and are told gives the tree."""
    rng = random.Random(seed)
    n = rng.choice([1, 2, 3, 5, 8, 31, 64, 100, 257])
    leaves = [sha256(str(i).encode()).digest() for i in range(n)]
    cuts = sorted({0, n, *(rng.randrange(n + 1) for _ in range(rng.choice([0, 1, 4, 30])))})
    ranges = list(zip(cuts, cuts[1:]))
    nodes = {(k, i): x for s, e in ranges for k, i, x in merkle.edges(b"".join(leaves[s:e]), s, e, n)}
    assert len(nodes) <= len(ranges) * 2 * (merkle.height(n) + 1)
    reach = 0
    while reach < merkle.height(n):  # in rounds, each on its own blocks
        reach = min(reach + rng.choice([1, 3, 20]), merkle.height(n))
        below = {x: v for x, v in nodes.items() if x[0] <= reach}
        covered = {(k, i) for k, i in below if (k + 1, i >> 1) in nodes}
        blocks = {}
        for k, i in below.keys() - covered:
            blocks.setdefault((i << k) >> reach, {})[k, i] = below[k, i]
        for own in blocks.values():
            nodes |= merkle.finished(own, n, reach)
    root, proofs = tree_by_hand([x.hex() for x in leaves])
    for s, e in ranges:
        outside = {x: nodes[x] for x in merkle.beside(s, e, n)}
        tree, top = merkle.levels(b"".join(leaves[s:e]), s, n, outside)
        assert top.hex() == root and len(tree) == merkle.height(n)


# 11 SimHash classes


def fingerprint_by_hand(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def classes_by_hand(fps, ids, distance=2):
    """Least id reachable of each; equal ids are one node."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in product(range(len(fps)), repeat=2):
        if i < j and ((fps[i] ^ fps[j]).bit_count() <= distance or ids[i] == ids[j]):
            root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(least.get(find(i), x), x)
    return [least[find(i)] for i in range(len(fps))]


def crowd(rng, n, bits, base=0):
    """Fingerprints that differ in some bits only."""
    own = rng.sample(range(64), bits)
    return [base ^ sum(1 << b for b in own if rng.random() < 0.5) for _ in range(n)]


@pytest.mark.parametrize("seed,parts", [(s, p) for s in range(6) for p in (None, 1, 2, 3, 4)])
def test_pigeonhole_loses_nothing(seed, parts):
    """Cells of entries, cut until they are small, hold every pair within the distance."""
    rng = random.Random(seed)
    fps = [rng.getrandbits(64) for _ in range(60)] + crowd(rng, 100, 10, rng.getrandbits(64)) + crowd(rng, 60, 30, rng.getrandbits(64))
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3]))) for f in fps[:60]]
    fps = np.array(sorted(set(fps)), np.uint64)
    plan = simhash_dedup.plan_for(fps[:: 1 + seed], len(fps), parts=parts)
    assert sorted(b for g in plan.groups for b in g.tolist()) == list(range(64)) and (plan.thresholds(fps)[0].sum(1) == 2 - len(plan.groups) + 1).all()
    rows, cells, fixed, stands, slack = plan.entries(fps)
    want = {(a, b) for a, b in product(range(len(fps)), repeat=2) if a != b and int(fps[a] ^ fps[b]).bit_count() <= 2}
    for _ in range(3):
        standing = {}
        for r, c in zip(rows[stands].tolist(), cells[stands].tolist()):
            standing.setdefault(c, []).append(r)
        found = {(r, b) for r, c in zip(rows[slack >= 0].tolist(), cells[slack >= 0].tolist()) for b in standing.get(c, ()) if r != b and int(fps[r] ^ fps[b]).bit_count() <= 2}
        assert {(b, a) for a, b in found} == found == want and want
        more = simhash_dedup.finer(np.concatenate(plan.groups), cells, fixed, fps[rows], stands, slack, 2)
        rows, (cells, fixed, stands, slack) = rows[more[0]], more[1:]


@pytest.mark.parametrize("block,parts", [(512, None), (4, None), (4, 2)])
def test_simhash_links(spark, block, parts):
    """Links within crowds, over many cuts, tie what brute force ties, and there are few of them."""
    rng = random.Random(block)
    fps = sorted({*(rng.getrandbits(64) for _ in range(150)), *crowd(rng, 250, 12), *crowd(rng, 150, 25, rng.getrandbits(64))})
    ids = rng.sample(range(10_000), len(fps))
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for f, i in zip(fps, ids)], "fp long, id long").repartition(5)
    plan = simhash_dedup.plan_for(np.array(fps[::3], np.uint64), len(fps), parts=parts)
    links = simhash_dedup.links_between(nodes, plan, block).collect()
    of = dict(zip(ids, fps))
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[find(a)] = find(b)
    want = classes_by_hand(fps, ids)
    got = {}
    for i in ids:
        got.setdefault(find(i), []).append(i)
    assert {frozenset(x) for x in got.values()} == {frozenset(i for i, w in zip(ids, want) if w == c) for c in set(want)}
    assert all(a in of and b in of for a, b in links)


def test_simhash_dedup(spark):
    rng = random.Random(3)
    words = [f"Word{i}" for i in range(80)] + ["É", "ß", "\x1f", "a\u00a0b"]
    base = [" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 40, 400]))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t.replace("Word7 ", "word8 ", 1)) for i, t in enumerate(base)]
    rows += [(300, None), (301, ""), (302, " \t\x0b"), (5, "another text of the same id"), (None, base[0]), (None, None), (400, base[3]), (400, base[3]), (401, "long " * 70_000), (402, "long " * 70_001)]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, fp int, id int, k int").repartition(4)
    got = simhash_dedup.near_duplicates(docs, block=3).collect()
    fps = [fingerprint_by_hand(t) if len(t or "") < 100_000 else fingerprint_by_hand("long long long") for _, t in rows]
    own = [(f, i) for f, (i, _) in zip(fps, rows) if i is not None]
    want = [(i, f"{f:016x}", c) for (f, i), c in zip(own, classes_by_hand(*zip(*own)))] + [(None, f"{f:016x}", None) for f, (i, _) in zip(fps, rows) if i is None]
    same_rows(map(tuple, got), want)
    assert simhash_dedup.near_duplicates(docs.limit(0)).count() == 0
