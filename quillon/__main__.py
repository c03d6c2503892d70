"""python -m quillon search QUERY --data DIR | serve --data DIR | extract --root DIR ... | clean --root DIR

DIR holds a declarations table (declarations.parquet, or the newest snapshot's) and, if built before, its index tables
(index/). serve answers JSON-RPC lines; with --url it asks a remote service instead.
"""

from __future__ import annotations

import argparse
import os
import sys

from quillon.plans.search import SearchEngine, Service, hashed_vector, hashed_words
from quillon.plans.serve import serve
from quillon.plans.tools import Backend, Tools, rendered
from quillon.sources import files, remote, versions


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("quillon").getOrCreate()


def local(data: str) -> Service:
    spark = session()
    plain = f"{data}/declarations.parquet"
    home = data if os.path.exists(plain) else files.latest_snapshot(data) or data
    rows = spark.read.parquet(plain if home == data else f"{home}/declarations")
    built = os.path.isdir(f"{home}/index")
    return Service(SearchEngine.load(spark, f"{home}/index", rows, hashed_words()) if built else SearchEngine.build(rows, hashed_words()))


def extracted(a: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    from quillon.plans import extract

    spark = session()
    steps = extract.resolve_steps(extract=a.extract, informalize=a.informalize, embed=a.embed, index=a.index)
    rows = extract.read_documentation(spark, a.database, a.sources, a.prefix or ()) if steps.extract else None
    template = open(a.template).read() if a.template else "{name}"
    # without a model, a declaration's text is its docstring or source, as the template puts them
    print(extract.run_steps(spark, a.root, steps, extracted=rows, template=template, generate=lambda p: F.trim(p), vector=hashed_vector, inverted=a.inverted, limit=a.limit))
    return 0


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("quillon")
    commands = parser.add_subparsers(dest="command", required=True)
    search = commands.add_parser("search")
    search.add_argument("query")
    search.add_argument("--limit", type=int, default=5)
    search.add_argument("--package", action="append")
    server = commands.add_parser("serve")
    for c in (search, server):
        c.add_argument("--data")
        c.add_argument("--url")
        c.add_argument("--key")
    pipeline = commands.add_parser("extract")
    pipeline.add_argument("--root", required=True)
    pipeline.add_argument("--database")
    pipeline.add_argument("--sources")
    pipeline.add_argument("--prefix", action="append")
    pipeline.add_argument("--template")
    pipeline.add_argument("--limit", type=int)
    pipeline.add_argument("--inverted", action="store_true")
    for step in ("extract", "informalize", "embed", "index"):
        pipeline.add_argument(f"--{step}", action=argparse.BooleanOptionalAction)
    clean = commands.add_parser("clean")
    clean.add_argument("--root", required=True)
    clean.add_argument("--keep")
    a = parser.parse_args(arguments)
    if a.command == "clean":
        print(*versions.clean(a.root, a.keep), sep="\n")
        return 0
    if a.command == "extract":
        return extracted(a)
    if not (a.data or a.url):
        parser.error("--data or --url")
    backend: Backend = remote.RemoteClient(a.url, a.key) if a.url else local(a.data)
    if a.command == "serve":
        serve(Tools(backend), sys.stdin, sys.stdout)
        return 0
    print(rendered(Tools(backend).search(a.query, a.limit, packages=a.package), a.limit))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
