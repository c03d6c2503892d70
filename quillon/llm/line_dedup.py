"""Line dedup by a deletion-neighbourhood join, with DataFrame functions only.

A line is what stands between line feeds; blank lines are always kept. A line goes if an equal line occurs earlier, or
if a line within one word edit of it (insertion, deletion or substitution of one space-separated word; both lines of
five words or more) first occurs earlier. Earlier: smaller (doc id, line number), null ids first.

* Equal lines meet in one aggregation, partly done before its shuffle; only its one row a line goes on.
* Two lines within one edit have equal first or equal last words (a quarter of the line or more), so lines that share
  neither with another line need no neighbourhood, and others none of the shared side. That leaves out nothing.
* The others emit themselves and every text with one word deleted as hashed keys; of lines of ``LONG`` words or more, a key
  is the xor of the other words' hashes with their places, put together from sums over blocks of words, so no line is built
  for each word: a line of n words costs n times its root. Equal keys join: the same word
  position deleted on both sides is a substitution, a whole line that equals a deletion is an insertion. A group's
  members are each compared with its earliest member only, which is all that "an earlier one exists" needs: no pairs
  within a group are made. The matched texts are then compared, so a hash collision can't remove a line.

Defined results: a null text stays null; a row that repeats another's id and text is one occurrence with it, and both are
treated alike; the text of a document that loses all lines is empty; extra columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import checkpoint

LEAST_WORDS = 5
#: Rows of hashes that may be broadcast to a join; beyond, it is a shuffled one.
BROADCAST_ROWS = 1_000_000
#: A line is common if its occurrences are more than one in so many of all; there can't be more common lines than that.
COMMON = 10_000
#: Lines of so many words or more get their deletions' keys from sums over blocks of words.
LONG = 512


def _words(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _first_words(line: Column, n: Column) -> Column:
    return F.call_function("substring_index", line, F.lit(" "), n)


def _without(line: Column, n: Column, i: Column) -> Column:
    """The line without its word i."""
    head, tail = _first_words(line, i), _first_words(line, i + 1 - n)
    return F.when(i == 0, tail).when(i == n - 1, head).otherwise(F.concat(head, F.lit(" "), tail))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark of the text, line number, line, two hashes) of every line that isn't blank."""
    # outer: a plain explode would add a filter on the number of lines, and with it split twice
    out = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.posexplode_outer(F.split(text_col, "\n")).alias("at", "line"))
    return out.where(F.trim("line") != "").withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def _half(n: Column) -> Column:
    """How many words at either end a line of n words is known by: a power of two, a quarter of them to a half."""
    return F.pow(F.lit(2), F.floor(F.log2(n.cast("double"))) - 1).cast("int")


def half_keys(line: Column, n: Column) -> Column:
    """Hashes of the line's first and last words, with their side (0 first, 1 last).

    Lines whose numbers of words differ by one have one number of words in common: where it changes, both are emitted.
    """
    h = _half(n)
    key = lambda side, k: F.struct(F.xxhash64(F.lit(side), k, _first_words(line, -k if side else k)).alias("half"), F.lit(side).alias("side"))
    both = lambda k: F.array(key(0, k), key(1, k))
    return F.when(h == _half(n - 1), both(h)).otherwise(F.concat(both(h), both(F.floor(h / 2).cast("int"))))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value bound to a variable, computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _xor(hashes: Column) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def _place_hashes(line: Column, moved: int = 0) -> Column:
    """The hash of each word with its place."""
    return F.transform(F.split(line, " "), lambda w, j: F.xxhash64(w, j - F.lit(moved)))


def long_keys(line: Column, n: Column, begin: Column, end: Column) -> Column:
    """(v, i) for each of the line's places i from begin to end: the xor of the other words' hashes with their places without it."""
    size = F.ceil(F.sqrt(n.cast("double"))).cast("int")
    each = lambda f: F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), f)

    def keys(h: Column, sums: Column, reach: Column) -> Column:
        def key(i: Column) -> Column:
            b = F.floor(i / size).cast("int")
            own = _xor(F.slice(h["here"], b * size + 1, i - b * size)).bitwiseXOR(_xor(F.slice(h["moved"], i + 2, (b + 1) * size - i - 1)))
            return F.struct(own.bitwiseXOR(F.get(reach["before"], b)).bitwiseXOR(F.get(reach["behind"], b)).alias("v"), i.alias("i"))

        return F.transform(F.sequence(begin, end), key)

    def reaching(s: Column) -> Column:
        return F.struct(each(lambda b: _xor(F.slice(s["here"], F.lit(1), b))).alias("before"), each(lambda b: _xor(F.slice(s["moved"], b + 2, n))).alias("behind"))

    def blocks(h: Column) -> Column:
        sums = lambda c: each(lambda b: _xor(F.slice(h[c], b * size + 1, size))).alias(c)
        return F.struct(sums("here"), sums("moved"))

    hashes = F.struct(_place_hashes(line).alias("here"), _place_hashes(line, 1).alias("moved"))
    return _let(hashes, lambda h: _let(blocks(h), lambda s: _let(reaching(s), lambda r: keys(h, s, r))))


def _fit(df: DataFrame) -> DataFrame:
    """Broadcast a written table of a bounded number of rows; a larger one is left to a shuffled join."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def near_lines(lines: DataFrame, firsts: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(h1, h2) of the distinct lines that have an earlier line within one word edit."""
    halves = firsts.where("halves is not null").select("h1", "h2", "first", F.explode("halves").alias("x")).select("h1", "h2", "first", "x.half", "x.side")
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("half")
    # an edit lies outside the shared half, so a line that shares one side only needs deletions beyond it only
    some = checkpoint(halves.join(shared, "half", "left_semi").groupBy("h1", "h2").agg(F.min("first").alias("first"), F.min("side").alias("low"), F.max("side").alias("high")), narrow=True)
    # a line's text is fetched at its first place only, so a common line doesn't meet its occurrences
    places = _fit(some.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "first", "low", "high"))
    met = lines.join(places, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & F.col("id").eqNullSafe(F.col("first.id")) & (F.col("at") == F.col("first.at")))
    texts = met.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.min("line").alias("line"), F.min("low").alias("low"), F.max("high").alias("high"))
    # seq numbers lines in the order of their first places, whatever the partitions
    line, n = F.col("line"), F.col("n")
    lines_ = checkpoint(texts.orderBy("first").select("h1", "h2", "line", "low", "high", _words(line).alias("n"), F.monotonically_increasing_id().alias("seq")))

    h = F.floor(_half(n - 1)).cast("int")
    begin, end = F.when(F.col("high") == 0, h).otherwise(0), F.when(F.col("low") == 1, n - h - 1).otherwise(n - 1)
    deleted = F.transform(F.sequence(begin, end), lambda i: F.struct(F.xxhash64(_without(line, n, i)).alias("v"), i.alias("i")))
    whole = F.array(F.struct(F.xxhash64(line).alias("v"), F.lit(-1).alias("i")))
    long_whole = F.array(F.struct(_xor(_place_hashes(line)).alias("v"), F.lit(-1).alias("i")))
    # a line of one word less than a long one can be a deletion of it
    every = F.when(n < LONG - 1, F.concat(whole, deleted)).when(n < LONG, F.concat(whole, long_whole, deleted)).otherwise(F.concat(long_whole, long_keys(line, n, begin, end)))
    keys = checkpoint(lines_.select("seq", F.explode(every).alias("x")).select("seq", "x.v", "x.i"))
    groups = checkpoint(keys.groupBy("v", "i").agg(F.min("seq").alias("e"), F.count(F.lit(1)).alias("k")))
    # substitutions: the same position deleted on both sides
    same = checkpoint(groups.where("k > 1 and i >= 0").select("v", "i", F.col("e").alias("p"), F.col("i").alias("j")), narrow=True)
    # insertions: a whole line on one side, a deletion on the other
    wholes = checkpoint(groups.where("i < 0").select("v", F.struct(F.col("e").alias("p"), F.col("i").alias("j")).alias("whole")), narrow=True)
    parts = groups.where("i >= 0").join(_fit(wholes), "v").groupBy("v").agg(F.min(F.struct(F.col("e").alias("p"), F.col("i").alias("j"))).alias("part"), F.min("whole").alias("whole"))
    swaps = keys.join(_fit(same), ["v", "i"]).where("p < seq").select("seq", "i", "p", "j")
    grown = keys.join(_fit(checkpoint(parts, narrow=True)), "v").withColumn("o", F.when(F.col("i") < 0, F.col("part")).otherwise(F.col("whole"))).select("seq", "i", "o.p", "o.j").where("p < seq")
    # equal words in a row give a pair at many places: one will do
    pairs = swaps.unionByName(grown).groupBy("seq", "p").agg(F.min(F.struct("i", "j")).alias("x")).select("seq", "p", "x.i", "x.j")

    own = lines_.select("seq", "h1", "h2", "line", "n")
    partner = lines_.select(F.col("seq").alias("p"), F.col("line").alias("p_line"), F.col("n").alias("p_n"))
    left = F.when(F.col("i") < 0, line).otherwise(_without(line, n, F.col("i")))
    right = F.when(F.col("j") < 0, F.col("p_line")).otherwise(_without(F.col("p_line"), F.col("p_n"), F.col("j")))
    return pairs.join(own, "seq").join(partner, "p").where(left == right).select("h1", "h2").distinct()


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, removed): sorted numbers of the lines that go, for documents that lose any."""
    lines = lines_of(docs, id_col, text_col)
    known = lines.withColumn("n", _words(F.col("line")))
    # a line's halves are the same wherever it occurs, and few are kept; the minimum is any of them
    known = known.select("id", "at", "h1", "h2", F.when(F.col("n") >= LEAST_WORDS, half_keys(F.col("line"), F.col("n"))).alias("halves"))
    firsts = checkpoint(known.groupBy("h1", "h2").agg(F.min(F.struct("id", "at")).alias("first"), F.count(F.lit(1)).alias("k"), F.min("halves").alias("halves")))
    near = checkpoint(near_lines(lines, firsts).withColumn("near", F.lit(True)), narrow=True)
    # lines that occur once and have no near line can't go: they don't need to meet their occurrences
    told = firsts.select("h1", "h2", "first", "k").join(near, ["h1", "h2"], "left").withColumn("near", F.coalesce("near", F.lit(False))).where("k > 1 or near")
    # common lines, COMMON at most, are broadcast, and their occurrences spread; the others meet theirs by hash
    common = F.col("k") * COMMON > (firsts.agg(F.sum("k")).first()[0] or 0)
    hot = told.where(common).select("h1", "h2", F.col("first").alias("hot_first"), F.col("near").alias("hot_near"))
    salt = F.when(F.col("hot_first").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("id", "at"), F.lit(1 << 20)) + 1).cast("long")
    spread = lines.select("id", "mark", "at", "h1", "h2").join(F.broadcast(hot), ["h1", "h2"], "left").withColumn("salt", salt)
    met = spread.join(told.where(~common).withColumn("salt", F.lit(0).cast("long")), ["h1", "h2", "salt"], "left")
    met = met.withColumns({"first": F.coalesce("hot_first", "first"), "near": F.coalesce("hot_near", "near")}).where("first is not null")
    gone = met.where(F.col("near") | (F.struct("id", "at") > F.col("first")))
    return gone.groupBy("id", "mark").agg(F.array_sort(F.collect_set("at")).alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str = "removed_lines") -> DataFrame:
    """All columns, the text without the lines that go, and ``removed_col``: their numbers from 0. No column may have that name already."""
    if removed_col in docs.columns:
        raise ValueError(f"there is a column {removed_col}: name the numbers of removed lines by removed_col")
    gone = dropped_lines(docs, id_col, text_col)
    # the input's columns go under names of their own, whatever they are called
    own = docs.select(*(docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)))
    key, text = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col))
    met = own.join(gone, key.eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("mark")), "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains("removed", i)), "\n")
    left = F.when(F.col("removed").isNull(), text).otherwise(kept)
    return met.select(*((left if c == text_col else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)), F.coalesce("removed", F.array().cast("array<int>")).alias(removed_col))
