"""From documentation tables to declaration rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text, udfs
from quillon.operators.storage import small

SKIP_REASONS = ["prefix", "constructor", "no_source"]


def join_tables(names: DataFrame, ranges: DataFrame, markdown: DataFrame, verso: DataFrame, modules: DataFrame) -> DataFrame:
    """Rendered names with their line ranges, either kind of docstring and their module's url, by module and position."""
    key = ["module_name", "position"]
    rows = names.where("render = 1").join(ranges.select(*key, "start_line", "end_line"), key)
    rows = rows.join(markdown.select(*key, F.col("text").alias("docstring")), key, "left").join(verso.select(*key, F.col("content").alias("verso_docstring")), key, "left")
    return rows.join(modules.select(F.col("name").alias("module_name"), "source_url"), "module_name").orderBy(*key)


def with_skip_reason(rows: DataFrame, include: Callable[[Column], Column], version: str | None = None) -> DataFrame:
    """``source_link`` and the first reason to skip a row (null: kept); the source text's absence is judged by the caller."""
    linked = rows.withColumn("source_link", text.source_link(F.col("module_name"), F.col("source_url"), F.col("start_line"), F.col("end_line"), version))
    reason = F.when(~include(F.col("module_name")), "prefix").when(text.is_autogenerated(F.col("name")), "constructor").when(F.col("source_link").isNull(), "no_source")
    return linked.withColumn("skip_reason", reason).withColumn("verso_only", (F.coalesce("docstring", F.lit("")) == "") & F.col("verso_docstring").isNotNull())


def skip_metrics() -> dict[str, Column]:
    """The counts of kept rows, of each reason to skip one and of those with a docstring of the other kind only, as aggregates of ``with_skip_reason``'s rows."""
    reason = F.col("skip_reason")
    return {"kept": F.count_if(reason.isNull())} | {r: F.count_if(reason.eqNullSafe(r)) for r in SKIP_REASONS} | {"verso_only": F.count_if(reason.isNull() & F.col("verso_only"))}


def skip_counts(rows: DataFrame) -> DataFrame:
    return rows.where("skip_reason is not null").groupBy("skip_reason").agg(F.count(F.lit(1)).alias("rows"))


def to_declarations(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Kept rows with their source text (source_link, source_text) and the names of their rendered type."""
    kept = rows.where("skip_reason is null").join(sources, "source_link")
    names = text.without_self(udfs.names_in_rendered_code(F.col("type")), F.col("name"))
    return kept.select("name", F.col("module_name").alias("module"), "docstring", "source_text", "source_link", names.alias("dependencies"))


def split_projections(rows: DataFrame, name: str = "name", source: str = "source_text", strip: Callable[[Column], Column] = udfs.strip_comments) -> DataFrame:
    """Rows with ``generated``: a to-projection's name, and a source that is, comments aside, another row's as well.

    Rows are counted by the source's hash and length first, so a text that many rows share doesn't travel with them.
    """
    plain = F.coalesce(strip(F.col(source)), F.lit(""))
    keyed = rows.withColumns({"__h": F.xxhash64(plain), "__n": F.length(plain)})
    counts = keyed.groupBy("__h", "__n").agg(F.count(F.lit(1)).alias("__k")).where("__k > 1")
    met = keyed.join(counts, ["__h", "__n"], "left")
    return met.withColumn("generated", text.is_projection_name(F.col(name)) & F.col("__k").isNotNull()).drop("__h", "__n", "__k")


def union_packages(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Declarations of several packages, in the packages' order; none at all is an error."""
    out = None
    for i, (name, df) in enumerate(parts):
        own = df.withColumns({"package": F.lit(name), "package_order": F.lit(i)})
        out = own if out is None else out.unionByName(own)
    if out is None or out.isEmpty():
        raise FileNotFoundError("no declarations in any package")
    return out


def latest_tag(tags: DataFrame) -> DataFrame:
    """tags (repo, seq, tag): each repository's newest version-like tag, else its first; ties go by seq, then by the tag itself."""
    like = text.is_version_tag(F.col("tag"))
    w = Window.partitionBy("repo").orderBy(like.desc(), F.when(like, text.version_key(F.col("tag"))).desc(), "seq", "tag")
    return tags.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("repo", "tag")


def with_prefixes(rows: DataFrame, prefixes: DataFrame, name: str = "module") -> DataFrame:
    """Rows whose dotted name is one of the prefixes (prefix), or goes on with a dot after one.

    A name's ancestors, itself included, are met by equality, once for each distinct name: no prefix is compared with every name.
    """
    parts = F.split("__name", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    names = rows.where(F.col(name).isNotNull()).select(F.col(name).alias("__name")).distinct().withColumn("__above", F.explode(above))
    known = prefixes.where("prefix is not null").select("prefix").distinct()
    found = names.join(small(known), F.col("__above") == F.col("prefix"), "left_semi").select("__name").distinct()
    return rows.join(found, F.col(name) == F.col("__name"), "left_semi")
