"""Text sources: JSON modules, line ranges of source files, snapshots of earlier runs."""

from __future__ import annotations

import os
import re
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import text
from quillon.operators.storage import small, stored
from quillon.schema import JSON_MODULE
from quillon.sources.folders import Folder
from quillon.sources.sqlite import is_usable

# What shows that a text which began with an attribute has come to its declaration.
DECLARATION_MARKS = [" def ", " theorem ", " lemma ", " instance ", " class ", " structure ", " inductive ", " abbrev ", ":="]

#: Lines of a block, in which ranges of lines meet a file.
BLOCK_LINES = 64


def documentation_format(database: str, modules: str) -> str:
    """'sqlite' for a usable database, else 'bmp' if there are JSON modules, else 'none'."""
    if is_usable(database):
        return "sqlite"
    return "bmp" if os.path.isdir(modules) and any(f.endswith(".bmp") for _, _, names in os.walk(modules) for f in names) else "none"


def json_modules(spark: SparkSession, path: str, include: Callable[[Column], Column] | None = None, pattern: str = "*.bmp") -> DataFrame:
    """(name, module, docstring, source_link, dependencies) of JSON module files, one JSON object each."""
    rows = spark.read.schema(JSON_MODULE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(path)
    found = rows.select(F.col("name").alias("module"), F.explode("declarations").alias("d"))
    if include:
        found = found.where(include(F.col("module")))
    names = text.without_self(text.linked_names(F.coalesce("d.header", F.lit(""))), F.col("d.info.name"))
    out = found.select(F.col("d.info.name").alias("name"), "module", F.col("d.info.doc").alias("docstring"), F.col("d.info.sourceLink").alias("source_link"), names.alias("dependencies"))
    return out.where(~text.is_autogenerated(F.col("name")))


def line_table(files: DataFrame, path: str = "path", content: str = "text") -> DataFrame:
    """(path, number, line): the lines of whole texts, numbered from 1; a line keeps its line feed, and all line ends become one."""
    lines = F.split(F.regexp_replace(content, "\r\n?", "\n"), "(?<=\n)")
    rows = files.select(F.col(path).cast("string").alias("path"), F.posexplode(lines).alias("at", "line")).where("line <> ''")
    return rows.select("path", (F.col("at") + 1).alias("number"), "line")


def source_files(spark: SparkSession, root: str, pattern: str = "*.lean") -> DataFrame:
    """(path below the root, number, line) of source files."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    below = F.substring_index(F.col("_metadata.file_path"), root.rstrip("/") + "/", -1)
    return line_table(files.select(below.alias("path"), F.col("value").alias("text")))


def package_registry(folders: DataFrame, toolchain: str | None = None) -> DataFrame:
    """(package, folder): lower-cased last parts of folders below the root, the last of several by name; the toolchain's source folder under its name."""
    name = F.lower(F.element_at(F.split(F.rtrim(F.col("folder"), F.lit("/")), "/"), -1))
    known = folders.select(name.alias("package"), F.rtrim(F.col("folder"), F.lit("/")).alias("folder"))
    if toolchain is not None:
        spark = folders.sparkSession
        known = known.where(F.col("package") != text.TOOLCHAIN).unionByName(spark.createDataFrame([(text.TOOLCHAIN, toolchain.rstrip("/"))], "package string, folder string"))
    return known.groupBy("package").agg(F.max("folder").alias("folder"))


def spans(ranges: DataFrame, lines: DataFrame, block: int = BLOCK_LINES) -> DataFrame:
    """(all columns of ranges, text): the lines from ``first`` to ``last`` of each (key, path, first, last), joined.

    A range join over blocks of lines: a range meets only the blocks that it touches, so neither a file's lines meet all
    of its ranges, nor do they all come to one task.
    """
    block_of = lambda c: F.floor(F.col(c) / block)
    asked = ranges.select("key", "path", "first", "last", F.explode(F.sequence(block_of("first"), block_of("last"))).alias("block"))
    near = lines.withColumn("block", block_of("number"))
    met = asked.join(near, ["path", "block"]).where("number between first and last")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "line"))), lambda x: x["line"]), "")
    return ranges.join(met.groupBy("key").agg(joined.alias("text")), "key", "left")


def marked_lines(lines: DataFrame) -> DataFrame:
    """The lines with a declaration's mark; no mark goes over a line's end."""
    return lines.where(reduce(Column.__or__, (F.contains("line", F.lit(m)) for m in DECLARATION_MARKS)))


def line_ranges(ranges: DataFrame, lines: DataFrame) -> DataFrame:
    """(key, source_text) of each (key, path, first, last), 1-based; null out of bounds.

    A text that starts with an attribute goes on to the first later line with which it has a declaration's mark (the next
    line, if it has one already), or to the file's end, and loses white space at its end. Of such texts' files only, marked
    lines and ranges are sorted together, and each range takes the next mark: linear in the file.
    """
    sizes = lines.groupBy("path").agg(F.max("number").alias("size"))
    inside = ranges.join(sizes, "path").where("first >= 1 and last >= first and last <= size").select("key", "path", "first", "last", "size")
    own = stored(spans(inside, lines))
    attribute = F.regexp_replace("text", r"(?U)^\s+", "").startswith("@[")
    open_ = own.where(attribute & (F.col("last") < F.col("size")))
    has = reduce(Column.__or__, (F.contains("text", F.lit(m)) for m in DECLARATION_MARKS))
    some = lines.join(open_.select("path").distinct(), "path", "left_semi")
    places = open_.where(~has).select("path", F.col("last").alias("number"), "key").unionByName(marked_lines(some).select("path", "number", F.lit(None).cast(ranges.schema["key"].dataType).alias("key")))
    # from the file's end backwards, ranges before a mark in the line where they end: the last mark seen is the next one
    w = Window.partitionBy("path").orderBy(F.col("number").desc(), F.col("key").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    nexts = places.withColumn("mark", F.last(F.when(F.col("key").isNull(), F.col("number")), ignorenulls=True).over(w)).where("key is not null").select("key", "mark")
    until = open_.join(nexts, "key", "left").select("key", "path", (F.col("last") + 1).alias("first"), F.when(has, F.col("last") + 1).otherwise(F.coalesce("mark", "size")).alias("last"))
    more = spans(until, some).select("key", F.col("text").alias("more"))
    whole = F.concat("text", F.coalesce("more", F.lit("")))
    return own.join(more, "key", "left").select("key", F.when(attribute, F.regexp_replace(whole, r"(?U)\s+$", "")).otherwise(F.col("text")).alias("source_text"))


def resolve_sources(links: DataFrame, packages: DataFrame, files: DataFrame) -> DataFrame:
    """(source_link, path): the first candidate place that exists, by priority.

    links (source_link); packages (package, folder), a ``package_registry``; files (path). Candidates are the package under
    its variants, then the root itself, then any package's folder.
    """
    parts = links.select("source_link").distinct().withColumn("p", text.link_parts(F.col("source_link"))).where("p is not null")
    wanted = parts.select("source_link", F.col("p.path").alias("tail"), F.posexplode(text.package_variants(F.col("p.package"))).alias("priority", "package"))
    named = wanted.join(small(packages), "package").select("source_link", "priority", text.path_in_package(F.col("package"), F.col("folder"), F.col("tail")).alias("path"))
    rest = wanted.select("source_link", "tail").distinct()
    root = rest.select("source_link", F.lit(100).alias("priority"), F.col("tail").alias("path"))
    # any package: each file's folders above it meet the packages' folders, and what is below them the tails
    known = stored(files.select("path").distinct())
    steps = F.split("path", "/")
    cut = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda k: F.struct(F.array_join(F.slice(steps, 1, k), "/").alias("folder"), F.array_join(F.slice(steps, k + 1, F.size(steps)), "/").alias("tail")))
    below = known.where(F.size(steps) > 1).select("path", F.inline(cut)).join(small(packages.select("folder").distinct()), "folder")
    anywhere = rest.join(below, "tail").select("source_link", F.lit(101).alias("priority"), "path")
    found = named.unionByName(root).unionByName(anywhere).join(known, "path", "left_semi")
    return found.groupBy("source_link").agg(F.min_by("path", F.struct("priority", "path")).alias("path"))


def read_sources(links: DataFrame, packages: DataFrame, lines: DataFrame) -> DataFrame:
    """(source_link, source_text); null where the file or its lines aren't there. lines (path, number, line)."""
    places = resolve_sources(links, packages, lines)
    p = text.link_parts(F.col("source_link"))
    ranges = stored(places.select(F.col("source_link").alias("key"), "path", p["line_start"].alias("first"), p["line_end"].alias("last")))
    own = line_ranges(ranges, lines).withColumnRenamed("key", "source_link")
    return links.select("source_link").distinct().join(own, "source_link", "left")


# snapshots, on any file system that Spark reaches

_STAMP = re.compile(r"\d{8}_\d{6}$")
COMPLETE = "_COMPLETE"


def new_snapshot(root: str, now: float | None = None) -> str:
    """The folder of a run that begins now."""
    return f"{root.rstrip('/')}/" + time.strftime("%Y%m%d_%H%M%S", time.localtime(now))


def mark_complete(path: str) -> None:
    Folder(path).touch(COMPLETE)


def latest_snapshot(root: str) -> str | None:
    """The newest complete one."""
    folder = Folder(root)
    names = [n for n in folder.names() if _STAMP.match(n) and folder.exists(f"{n}/{COMPLETE}")]
    return f"{folder.path}/{max(names)}" if names else None


def earlier_snapshots(*roots: str) -> list[str]:
    """Complete snapshots of all roots in order of priority: roots as given, newest first."""
    return [f"{f.path}/{n}" for f in map(Folder, roots) for n in reversed(f.names()) if f.exists(f"{n}/{COMPLETE}")]


def readable(spark: SparkSession, paths: list[str], columns: list[str]) -> list[DataFrame]:
    """The tables that can be read and have the columns; others are left out."""
    out = []
    for p in paths:
        try:
            df = spark.read.parquet(p)
        except Exception as e:  # a broken cache costs its hits, not the run
            print(f"cache {p} left out: {str(e).splitlines()[0][:200]}")
            continue
        if set(columns) <= set(df.columns):
            out.append(df.select(*columns))
    return out
