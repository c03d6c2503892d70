"""The offline pipeline: read, filter, insert, enrich, embed, index; each step writes a snapshot."""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text
from quillon.operators import enrich, ingest
from quillon.operators.storage import stored, stored_observed
from quillon.plans.search import SearchEngine
from quillon.schema import DECLARATION
from quillon.sources import files, sqlite
from quillon.sources.folders import Folder


@dataclass(frozen=True)
class Steps:
    extract: bool = True
    informalize: bool = True
    embed: bool = True
    index: bool = True


def resolve_steps(**flags: bool | None) -> Steps:
    """None given: all steps. Any given: those that are True only."""
    names = [f.name for f in fields(Steps)]
    if all(flags.get(n) is None for n in names):
        return Steps()
    return Steps(**{n: bool(flags.get(n)) for n in names})


def add_declarations(target: DataFrame, extracted: DataFrame) -> tuple[DataFrame, int]:
    """The next snapshot of the declarations and the number of rows inserted: generated projections out, known names ignored."""
    kept = ingest.split_projections(extracted).where("not generated").drop("generated")
    rows = enrich.insert_ignore(target, kept.withColumn("seq", F.struct("module", "name", "source_link"))).drop("seq")
    new, told = stored_observed(rows, inserted=F.count(F.lit(1)))
    n = told.get("inserted", 0)  # nothing is told of a table that is known to be empty
    if not n:
        return target, 0
    last = target.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    numbered = enrich.batches(new, 1, order="name").withColumn("id", F.col("batch") + F.lit(last + 1))
    columns = [F.col(c) if c in numbered.columns else F.lit(None).cast(target.schema[c].dataType).alias(c) for c in target.columns]
    return target.unionByName(numbered.select(columns)), n


def informalize(rows: DataFrame, caches: Sequence[DataFrame], template: str, generate: Callable[[Column], Column], limit: int | None = None) -> DataFrame:
    """Fill texts: first from earlier snapshots by (name, source_text), then by generation, dependencies first."""
    if caches:
        known = enrich.first_wins(caches, ["name", "source_text"], "informalization")
        rows = stored(enrich.apply_values(rows, known, ["name", "source_text"], "informalization", "informalization"))
    if limit:
        chosen = enrich.worklist(rows, "informalization", limit=limit).select("id")
        some = rows.where("informalization is null").join(chosen, "id", "left_semi")
        made = enrich.generate_in_layers(rows.where("informalization is not null").unionByName(some), template, generate)
        return made.unionByName(rows.where("informalization is null").join(chosen, "id", "left_anti"))
    return enrich.generate_in_layers(rows, template, generate)


def embed(rows: DataFrame, caches: Sequence[DataFrame], vector: Callable[[Column], Column], source: str = "informalization", target: str = "informalization_embedding") -> DataFrame:
    """Fill embeddings: first from earlier snapshots by text, then by the model, once a distinct text."""
    if caches:
        known = enrich.first_wins(caches, [source], target)
        rows = stored(enrich.apply_values(rows, known, [source], target, target))
    texts = enrich.to_embed(rows, source, target).select(source).distinct()
    made = texts.select(source, vector(F.col(source)).alias("__made"))
    return enrich.apply_values(rows, made, [source], target, "__made")


def read_documentation(spark: SparkSession, database: str, sources: str, prefixes: Sequence[str] = (), toolchain: str | None = None) -> DataFrame:
    """Declarations of a documentation database and its packages' source files; packages are the folders below ``sources``.

    toolchain: the folder below ``sources`` with the toolchain's sources; its other folders lie beside it.
    """
    names = [sqlite.read_table(spark, database, n) for n in ("name_info", "declaration_ranges", "declaration_markdown_docstrings", "declaration_verso_docstrings", "modules")]
    include = (lambda m: text.has_any_prefix(m, list(prefixes))) if prefixes else (lambda m: F.lit(True))
    rows, told = stored_observed(ingest.with_skip_reason(ingest.join_tables(*names), include), **ingest.skip_metrics())
    print("declarations read:", ", ".join(f"{k} {v}" for k, v in told.items()), file=sys.stderr)
    lines = files.source_files(spark, sources)
    folders = lines.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("folder")).distinct()
    found = files.read_sources(rows.where("skip_reason is null"), files.package_registry(folders, toolchain), lines)
    return ingest.to_declarations(rows, found).where("source_text is not null")


def index_report(vectors: DataFrame) -> DataFrame:
    """(vectors, dimension): how many embeddings there are, and how long (one row)."""
    return vectors.agg(F.count("embedding").alias("vectors"), F.max(F.size("embedding")).alias("dimension"))


def build_index(rows: DataFrame, path: str, inverted: bool = False) -> list[str]:
    """Write the index tables of a snapshot; parts without data are skipped. What was written."""
    engine = SearchEngine.build(rows, lambda q: q, inverted=inverted and not rows.where("informalization_embedding is not null").isEmpty())
    written = []
    if not rows.isEmpty():
        engine.spaced.save(f"{path}/spaced")
        engine.raw.save(f"{path}/raw")
        written += ["spaced", "raw"]
    if not rows.where("informalization_embedding is not null").isEmpty():
        engine.save_vectors(path)
        written.append("lists" if inverted else "flat")
    return written


def run_steps(spark: SparkSession, root: str, steps: Steps, *, extracted: DataFrame | None = None, template: str = "{name}", generate: Callable[[Column], Column] | None = None, vector: Callable[[Column], Column] | None = None, caches: Sequence[str] = (), inverted: bool = False, limit: int | None = None) -> str:
    """Run the steps in order over the newest complete snapshot below ``root``; the new snapshot's folder.

    Each step writes its table, so a failed run leaves what is done; the snapshot is marked complete at its end. Earlier
    snapshots' texts and vectors are taken before any is made anew.
    """
    last, here = files.latest_snapshot(root), files.new_snapshot(root)
    while Folder(here).exists():  # two runs within a second
        here = files.new_snapshot(root, Folder(here).modified() + 1)
    rows = spark.read.parquet(f"{last}/declarations") if last else spark.createDataFrame([], DECLARATION)
    earlier = [f"{p}/declarations" for p in [*files.earlier_snapshots(root), *caches]]
    at = 0

    def keep(df: DataFrame) -> DataFrame:
        nonlocal at
        at += 1
        df.select(DECLARATION.fieldNames()).write.parquet(f"{here}/step_{at}")
        return spark.read.schema(DECLARATION).parquet(f"{here}/step_{at}")

    if steps.extract:
        if extracted is None:
            raise ValueError("nothing to extract from")
        rows = keep(add_declarations(rows, extracted)[0])
    if steps.informalize and generate:
        rows = keep(informalize(rows, files.readable(spark, earlier, ["name", "source_text", "informalization"]), template, generate, limit))
    if steps.embed and vector:
        rows = keep(embed(rows, files.readable(spark, earlier, ["informalization", "informalization_embedding"]), vector))
    rows.select(DECLARATION.fieldNames()).write.parquet(f"{here}/declarations")
    if steps.index:
        build_index(spark.read.parquet(f"{here}/declarations"), f"{here}/index", inverted)
    files.mark_complete(here)
    return here
