"""Dependency graphs over (name, dependencies) rows."""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.storage import stored

#: Layers that are peeled by joins before the rest is dealt by connected part; edges of a part that one task peels.
ROUNDS, PART_EDGES = 6, 1_000_000
#: Edges that one task peels whether they are connected or not.
FEW_EDGES = 100_000


def edges(rows: DataFrame) -> DataFrame:
    """(name, dep): distinct edges between names of the table; outside names and self-references are left out."""
    pairs = rows.select("name", F.explode("dependencies").alias("dep")).where("dep <> name").distinct()
    return pairs.join(rows.select(F.col("name").alias("dep")).distinct(), "dep", "left_semi").select("name", "dep")


def in_degrees(rows: DataFrame) -> DataFrame:
    """(name, waits): on how many names of the table each name depends."""
    found = edges(rows).groupBy("name").agg(F.count(F.lit(1)).alias("waits"))
    return rows.select("name").distinct().join(found, "name", "left").withColumn("waits", F.coalesce("waits", F.lit(0)))


def connected_parts(pairs: DataFrame) -> DataFrame:
    """(name, part) of the names of (name, dep) edges: the least name of the connected part, whatever the edges' direction.

    Each round joins every name's larger neighbours to the least of its neighbourhood, then its smaller ones: the rounds
    grow with the logarithm of a part's size, not with the length of its chains.
    """
    up = stored(pairs.select(F.least("name", "dep").alias("u"), F.greatest("name", "dep").alias("v")).distinct())
    before = None
    while True:
        state = up.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        ways = up.unionByName(up.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = ways.join(ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "u").where("v > u and m <> v").select("m", "v").distinct()
        least = large.groupBy("v").agg(F.min("m").alias("r"))
        small_ = large.join(least, "v").where("m <> r").select(F.col("r").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("r").alias("u"), "v"))
        up = stored(small_.distinct())
    top = up.groupBy(F.col("v").alias("name")).agg(F.min("u").alias("part"))
    return top.unionByName(top.select(F.col("part").alias("name"), "part").distinct())


def _peeled(part: pd.DataFrame, least: int) -> pd.DataFrame:
    """(name, layer) of a part's edges (name, dep, w), peeled in memory, counted from ``least``; 0 for names in or behind a cycle."""
    waits, behind = Counter(part["name"]), defaultdict(list)
    layer = {n: least for n in [*part["name"], *part["dep"]]}
    for name, dep, w in zip(part["name"], part["dep"], part["w"]):
        behind[dep].append((name, w))
    ready = [n for n in layer if not waits[n]]
    while ready:
        n = ready.pop()
        for m, w in behind[n]:
            layer[m] = max(layer[m], layer[n] + w)
            waits[m] -= 1
            if not waits[m]:
                ready.append(m)
    return pd.DataFrame({"name": list(layer), "layer": [0 if waits[n] else k for n, k in layer.items()]}).astype({"layer": "int32"})


def _shorter(left: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(edges, gone) of weighted edges (name, dep, w): about a quarter of the names with one dependency left out, edges to them
    led on to that dependency, which stays; gone (name, dep, w) has the edge that each of them had.

    Whether a name may go is a coin of its own, thrown anew each turn; a name that goes depends on one that may not, so no edge is
    led on twice. Edges never get more; of parallel ones the longest counts.
    """
    coin = lambda c: F.xxhash64(c, F.lit(turn)) % 2 == 0
    one = left.groupBy("name").agg(F.count(F.lit(1)).alias("k"), F.first("dep").alias("dep"), F.first("w").alias("w"))
    gone = stored(one.where((F.col("k") == 1) & coin("name") & ~coin("dep")).select("name", "dep", "w"))
    on = gone.select(F.col("name").alias("dep"), F.col("dep").alias("on"), F.col("w").alias("more"))
    led = left.join(gone.select("name"), "name", "left_anti").join(on, "dep", "left")
    led = led.select("name", F.coalesce("on", "dep").alias("dep"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"))
    return stored(led.groupBy("name", "dep").agg(F.max("w").alias("w"))), gone


def layers(rows: DataFrame, rounds: int = ROUNDS, part_edges: int = PART_EDGES, few_edges: int = FEW_EDGES) -> DataFrame:
    """(name, layer), from 1: a name's dependencies are all in earlier layers; names in or behind a cycle are one last layer.

    A round peels the names that wait for nothing: one job each, its lineage cut in the shared folder. What is left after
    ``rounds`` of them is made shorter: names with one dependency are left out turn by turn, so that a chain of n names takes
    turns by the logarithm of n and work in proportion to n; they get their layer from that dependency's in the end. What stays
    is dealt by connected part, and a part of ``part_edges`` edges or fewer is peeled to its end in one task; only larger
    parts, whose names have several dependencies each, go on by rounds.
    """
    left = stored(edges(rows))
    names = stored(rows.select("name").distinct())
    found: list[DataFrame] = []
    layer, cyclic = 0, None
    while layer < rounds and not names.isEmpty():
        layer += 1
        ready = stored(names.join(left.select("name").distinct(), "name", "left_anti"))
        if ready.isEmpty():
            cyclic = names
            break
        found.append(ready.withColumn("layer", F.lit(layer)))
        names = stored(names.join(ready, "name", "left_anti"))
        left = stored(left.join(ready.select(F.col("name").alias("dep")), "dep", "left_anti").select("name", "dep"))
    if cyclic is None and not names.isEmpty():
        inside = _rest(names, left, layer + 1, part_edges, few_edges)
        found.append(inside.where("layer > 0"))
        cyclic = inside.where("layer = 0").select("name")
    if not found and cyclic is None:
        return names.withColumn("layer", F.lit(1))
    done = reduce(DataFrame.unionByName, found) if found else None
    if cyclic is None or cyclic.isEmpty():
        return done
    last = (done.agg(F.max("layer")).first()[0] or 0) if done is not None else 0
    behind = cyclic.withColumn("layer", F.lit(last + 1))
    return behind if done is None else done.unionByName(behind)


def _rest(names: DataFrame, left: DataFrame, least: int, part_edges: int, few_edges: int) -> DataFrame:
    """(name, layer) of names and the edges between them, counted from ``least``; 0 for names in or behind a cycle."""
    names = names.withColumn("least", F.lit(least))
    left = left.withColumn("w", F.lit(1))
    few = min(few_edges, part_edges)
    gone: list[DataFrame] = []
    while (k := left.count()) > few:
        left, out = _shorter(left, len(gone))
        gone.append(out)
        if out.isEmpty():
            break
    if gone:
        names = stored(names.join(reduce(DataFrame.unionByName, gone).select("name"), "name", "left_anti"))
    # few edges are one part, without looking for connected ones
    every = left.select("name").unionByName(left.select(F.col("dep").alias("name"))).distinct()
    if k <= few:
        parts = stored(every.withColumn("part", F.lit("")))
    else:
        met = stored(connected_parts(left.where("name <> dep")))
        parts = stored(met.unionByName(every.join(met, "name", "left_anti").select("name", F.col("name").alias("part"))))
    tagged = left.join(parts, "name")
    fit = stored(tagged.groupBy("part").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= part_edges).select("part"))
    inside = tagged.join(fit, "part", "left_semi").groupBy("part").applyInPandas(lambda part: _peeled(part, least), "name string, layer int")
    # a name without an edge left waits for nothing
    found = [stored(inside), stored(names.join(parts.select("name"), "name", "left_anti").withColumnRenamed("least", "layer"))]
    large = parts.join(fit, "part", "left_anti").select("name")
    names, left = stored(names.join(large, "name", "left_semi")), stored(left.join(large, "name", "left_semi"))
    while not names.isEmpty():
        ready = stored(names.join(left.select("name").distinct(), "name", "left_anti").withColumnRenamed("least", "layer"))
        if ready.isEmpty():
            found.append(names.select("name", F.lit(0).alias("layer")))
            break
        found.append(ready)
        after = left.join(ready.withColumnRenamed("name", "dep"), "dep").groupBy("name").agg(F.max(F.col("layer") + F.col("w")).alias("after"))
        names = stored(names.join(ready, "name", "left_anti").join(after, "name", "left").select("name", F.greatest("least", "after").alias("least")))
        left = stored(left.join(ready.select(F.col("name").alias("dep")), "dep", "left_anti").select("name", "dep", "w"))
    done = reduce(DataFrame.unionByName, found)
    for out in reversed(gone):  # the dependency of a name that went stayed, or went later
        at = done.select(F.col("name").alias("dep"), F.col("layer").alias("of"))
        done = done.unionByName(stored(out.join(at, "dep").select("name", F.when(F.col("of") > 0, F.col("of") + F.col("w")).otherwise(0).alias("layer"))))
    return done


def topological(names: dict[str, list[str]]) -> list[str]:
    """Driver-side order of a small registry: what a package depends on comes first; unknown names are skipped."""
    out: list[str] = []
    seen: set[str] = set()
    for root in names:
        stack = [(root, False)]
        while stack:
            name, expanded = stack.pop()
            if expanded:
                out.append(name)
            elif name in names and name not in seen:
                seen.add(name)
                stack.append((name, True))
                stack += [(d, False) for d in reversed(names[name])]
    return out
