"""Graph, enrichment, ingest, sources, streaming and the search facade."""

from __future__ import annotations

import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.functions import text
from quillon.operators import enrich, graph, ingest
from quillon.operators.storage import stored, stored_observed
from quillon.plans import extract
from quillon.plans.search import SearchEngine, Service, hashed_vector, hashed_words
from quillon.schema import DECLARATION
from quillon.sources import files, sqlite
from quillon.sources.folders import Folder
from quillon.streaming import rates, resumable, trailing


def names(spark, rows):
    return spark.createDataFrame(rows, "name string, dependencies array<string>")


def test_layers(spark):
    def got(rows):
        return {r["name"]: r["layer"] for r in graph.layers(names(spark, rows)).collect()}

    assert got([("a", []), ("b", ["a", "out"]), ("c", ["a", "b"]), ("d", None)]) == {"a": 1, "d": 1, "b": 2, "c": 3}
    assert got([("a", []), ("x", ["y"]), ("y", ["x"]), ("z", ["x", "a"])]) == {"a": 1, "x": 2, "y": 2, "z": 2}
    assert got([("s", ["s"])]) == {"s": 1}
    assert graph.topological({"b": ["a", "zz"], "a": [], "c": ["b"]}) == ["a", "b", "c"]


def test_first_wins_and_split(spark):
    a = spark.createDataFrame([("k", "1", 2), ("k", "0", 1), (None, "x", 0), ("n", None, 0)], "key string, v string, seq int")
    b = spark.createDataFrame([("k", "9", 0), ("m", "5", 0), ("n", "7", 0)], "key string, v string, seq int")
    cache = enrich.first_wins([a, b], ["key"], "v", "seq")
    assert {r["key"]: r["v"] for r in cache.collect()} == {"k": "0", "m": "5", "n": "7"}
    rows = spark.createDataFrame([(1, "k"), (2, "zz"), (3, None)], "id int, key string")
    hits, misses = enrich.split_by_cache(rows, cache, ["key"], "v")
    assert [(r["id"], r["cached"]) for r in hits.collect()] == [(1, "0")] and [r["id"] for r in misses.collect()] == [2]


def test_insert_ignore_and_batches(spark):
    target = spark.createDataFrame([("a",)], "name string")
    batch = spark.createDataFrame([("a", 0, "x"), ("b", 2, "late"), ("b", 1, "first")], "name string, seq int, v string")
    assert [(r["name"], r["v"]) for r in enrich.insert_ignore(target, batch).collect()] == [("b", "first")]
    numbered = enrich.batches(spark.range(0, 25).toDF("id").repartition(3), 10).collect()
    assert {r["id"]: r["batch"] for r in numbered} == {i: i // 10 for i in range(25)}


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_batches_of_wide_rows(spark, coalesce):
    """No row is lost, and numbers follow the order, however the shuffle is cut."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        rows = spark.range(20_000).select((F.col("id") * 7 % 20_000).alias("id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 30).alias("text"))
        got = enrich.batches(rows, 1000).select("id", "batch", F.length("text").alias("n")).toPandas()
        assert sorted(got["id"]) == list(range(20_000)) and (got["batch"] == got["id"] // 1000).all() and (got["n"] == 1920).all()
        extracted = rows.select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), F.lit("M").alias("module"), F.lit(None).cast("string").alias("docstring"), F.col("text").alias("source_text"), F.lit("l").alias("source_link"), F.lit(None).cast("array<string>").alias("dependencies"))
        out, n = extract.add_declarations(spark.createDataFrame([], DECLARATION), extracted)
        assert n == 20_000 and out.select("id").distinct().count() == 20_000 == out.agg(F.max("id")).first()[0]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_generate_in_layers(spark):
    rows = [(1, "base", "src1", None, None, None), (2, "top", "src2", None, ["base", "known", "gone"], None), (3, "known", "s", None, None, "K text"), (4, "blank", " ", None, None, None)]
    df = spark.createDataFrame(rows, "id long, name string, source_text string, docstring string, dependencies array<string>, informalization string")
    told = {}
    out = enrich.generate_in_layers(df, "{name}|{docstring}|{dependencies}", lambda p: F.when(~p.startswith("blank"), F.concat(F.lit(" <"), p, F.lit("> "))), report=told.__setitem__)
    assert told == {1: {"filled": 1}, 2: {"filled": 1}}
    got = {r["name"]: r["informalization"] for r in out.collect()}
    assert got["base"] == "<base|No docstring available|>" and got["known"] == "K text" and got["blank"] is None
    assert got["top"] == "<top|No docstring available|Dependencies:\n- base: <base|No docstring available|>\n- known: K text>"


def test_keys_that_a_cache_has_twice(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", "own"), (3, None, None), (4, "c", None)], "id long, k string, v string")
    cache = spark.createDataFrame([("a", "y"), ("a", "x"), ("b", "z"), (None, "n")], "k string, v string")
    hits, misses = enrich.split_by_cache(rows.drop("v"), cache, ["k"], "v")
    assert sorted((r["id"], r["cached"]) for r in hits.collect()) == [(1, "x"), (2, "z")] and [r["id"] for r in misses.collect()] == [4]
    assert {r["id"]: r["v"] for r in enrich.apply_values(rows, cache, ["k"], "v", "v").collect()} == {1: "x", 2: "own", 3: None, 4: None}


def test_projections(spark):
    rows = [("A.toB", "structure S -- x"), ("A", "structure   S"), ("C.toD", "own"), ("E.toF", "t"), ("G.toH", "t"), ("x.to", "t")]
    out = ingest.split_projections(spark.createDataFrame(rows, "name string, source_text string"))
    assert {r["name"] for r in out.where("generated").collect()} == {"A.toB", "E.toF", "G.toH"}


@pytest.fixture
def database(tmp_path):
    path = f"{tmp_path}/api.db"
    c = sqlite3.connect(path)
    c.executescript("""
        CREATE TABLE modules (name TEXT, source_url TEXT); CREATE TABLE name_info (module_name TEXT, position INTEGER, kind TEXT, name TEXT, type BLOB, render INTEGER);
        CREATE TABLE declaration_ranges (module_name TEXT, position INTEGER, start_line INTEGER, end_line INTEGER);
        CREATE TABLE declaration_markdown_docstrings (module_name TEXT, position INTEGER, text TEXT); CREATE TABLE declaration_verso_docstrings (module_name TEXT, position INTEGER, content BLOB);""")
    tree = b"\x01\x02\x01\x01\x00\x03Nat\x03add\x00\x01x"
    c.executemany("INSERT INTO modules VALUES (?, ?)", [("M.A", "https://github.com/o/pkg/blob/r/M/A.lean"), ("N.B", None), ("Init.C", None)])
    c.executemany("INSERT INTO name_info VALUES (?, ?, ?, ?, ?, ?)", [("M.A", 2, "def", "f", tree, 1), ("M.A", 1, "def", "g.mk", tree, 1), ("M.A", 3, "def", "h", None, 0), ("N.B", 1, "def", "n", None, 1), ("Init.C", 1, "def", "c", None, 1), ("M.A", 9, "def", "norange", None, 1)])
    c.executemany("INSERT INTO declaration_ranges VALUES (?, ?, ?, ?)", [(m, p, p, p + 1) for m, p in [("M.A", 1), ("M.A", 2), ("M.A", 3), ("N.B", 1), ("Init.C", 1)]])
    c.execute("INSERT INTO declaration_markdown_docstrings VALUES ('M.A', 2, 'doc')")
    c.execute("INSERT INTO declaration_verso_docstrings VALUES ('Init.C', 1, x'00')")
    c.commit()
    c.close()
    return path


def test_sqlite_to_declarations(spark, database, tmp_path):
    assert sqlite.is_usable(database) and not sqlite.is_usable(f"{tmp_path}/none")
    t = [sqlite.read_table(spark, database, n, 2) for n in ("name_info", "declaration_ranges", "declaration_markdown_docstrings", "declaration_verso_docstrings", "modules")]
    joined = ingest.join_tables(*t)
    assert [(r["module_name"], r["position"]) for r in joined.collect()] == [("Init.C", 1), ("M.A", 1), ("M.A", 2), ("N.B", 1)]
    rows = ingest.with_skip_reason(joined, lambda m: text.has_any_prefix(m, ["M", "N", "Init"]))
    assert {r["skip_reason"]: r["rows"] for r in ingest.skip_counts(rows).collect()} == {"constructor": 1, "no_source": 1}
    written, told = stored_observed(rows, **ingest.skip_metrics())
    assert told == {"kept": 2, "prefix": 0, "constructor": 1, "no_source": 1, "verso_only": 1} and written.count() == 4
    assert [r["name"] for r in rows.where("verso_only").collect()] == ["c"]
    root = tmp_path / "src"
    (root / "pkg" / "M").mkdir(parents=True)
    (root / "pkg" / "M" / "A.lean").write_text("one\n@[simp]\nlater\n def f := 1\nend\n")
    source = files.source_files(spark, str(root))
    found = files.read_sources(rows.where("skip_reason is null"), files.package_registry(spark.createDataFrame([("pkg",)], "folder string")), source)
    got = {r["name"]: r for r in ingest.to_declarations(rows, found).collect()}
    assert got["f"]["source_text"] == "@[simp]\nlater\n def f := 1" and got["f"]["dependencies"] == ["Nat.add"] and got["f"]["docstring"] == "doc"
    assert got["c"]["source_text"] is None and got["c"]["source_link"].endswith("/blob/master/src/lean/Init/C.lean#L1-L2")


def test_line_ranges(spark):
    """Against a reading line by line: bounds, attributes, marks before, in and behind the range, and no mark at all."""
    rng = random.Random(2)
    pool = ["@[simp]", "plain", "  @[a, b]", " def f", "x := y", "", "theorem t", "a lemma b ", " lemma c"]
    texts = {f"f{i}": "\n".join(rng.choices(pool, k=rng.choice([0, 1, 2, 5, 300]))) + rng.choice(["", "\n", "\r\n", "\r"]) for i in range(12)}
    lines = files.line_table(spark.createDataFrame(list(texts.items()), "path string, text string"))
    asked = [(k, f"f{rng.randrange(13)}", a := rng.randrange(0, 8) if k % 3 else rng.randrange(0, 310), a + rng.randrange(-1, 3)) for k in range(300)]

    def by_hand(path, first, last):
        own = texts.get(path, "").replace("\r\n", "\n").replace("\r", "\n").splitlines(keepends=True)
        if not 1 <= first <= last <= len(own):
            return None
        out = "".join(own[first - 1 : last])
        if not out.strip().startswith("@["):
            return out
        while last < len(own):
            last += 1
            if any(m in "".join(own[first - 1 : last]) for m in files.DECLARATION_MARKS):
                break
        return "".join(own[first - 1 : last]).rstrip()

    got = {r["key"]: r["source_text"] for r in files.line_ranges(spark.createDataFrame(asked, "key int, path string, first long, last long"), lines).collect()}
    assert {k: got.get(k) for k, *_ in asked} == {k: by_hand(*x) for k, *x in asked}


def test_source_folders(spark, tmp_path):
    """Packages are found whatever their folders' case, before any other package; the toolchain's folders are rebased."""
    for place in ("Aaa/A/B", "Mathlib/A/B", "Mathlib/Only", "pkg4/X", "chain/src/lean/Init/P", "chain/src/lake/Lake/Q", "chain/src/lean/R", "Root", "Aaa/Some"):
        (tmp_path / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f"{place}.lean").write_text(f"{place}\n")
    lines = files.source_files(spark, str(tmp_path))
    registry = files.package_registry(spark.createDataFrame([("Aaa",), ("Mathlib",), ("pkg4",)], "folder string"), "chain/src/lean/")
    assert {r["package"]: r["folder"] for r in registry.collect()} == {"aaa": "Aaa", "mathlib": "Mathlib", "pkg4": "pkg4", "lean4": "chain/src/lean"}
    at = {("Mathlib", "A/B"): "Mathlib/A/B", ("mathlib4", "A/B"): "Mathlib/A/B", ("Aaa", "A/B"): "Aaa/A/B", ("other", "Only"): "Mathlib/Only", ("pkg-4", "X"): "pkg4/X", ("any", "A/B"): "Aaa/A/B", ("any", "Root"): "Root", ("any", "None"): None,
          ("lean4", "src/lean/Init/P"): "chain/src/lean/Init/P", ("Lean4", "src/lake/Lake/Q"): "chain/src/lake/Lake/Q", ("lean4", "src/R"): "chain/src/lean/R", ("lean4", "Some"): "Aaa/Some"}
    link = lambda p, f: f"https://github.com/o/{p}/blob/main/{f}.lean#L1-L1"
    links = spark.createDataFrame([(link(*x),) for x in at], "source_link string")
    got = {r["source_link"]: r["source_text"] for r in files.read_sources(links, registry, lines).collect()}
    assert got == {link(*x): want and f"{want}\n" for x, want in at.items()}


def test_json_modules(spark, tmp_path):
    (tmp_path / "M.bmp").write_text(json.dumps({"name": "M", "declarations": [{"info": {"name": "a", "doc": "d", "sourceLink": "l"}, "header": '<a href="x#b"><a href="x#a">'}, {"info": {"name": "a.mk", "sourceLink": "l"}}, {"info": {"name": "c", "sourceLink": "l"}}]}))
    got = {r["name"]: r for r in files.json_modules(spark, str(tmp_path)).collect()}
    assert set(got) == {"a", "c"} and got["a"]["dependencies"] == ["b"] and got["c"]["dependencies"] is None and got["a"]["module"] == "M"
    assert files.documentation_format(f"{tmp_path}/x.db", str(tmp_path)) == "bmp" and files.documentation_format("", "/nowhere") == "none"


def test_snapshots(spark, tmp_path):
    a, b, c = (tmp_path / n for n in ("20240101_000000", "20250101_000000", "20260101_000000"))
    for p in (a, b, c):
        p.mkdir()
    files.mark_complete(str(a))
    files.mark_complete(str(b))
    assert files.latest_snapshot(str(tmp_path)) == str(b) and files.earlier_snapshots(str(tmp_path), "/none") == [str(b), str(a)]
    assert files.latest_snapshot("/none") is None and len(files.new_snapshot("r").split("/")[-1]) == 15
    spark.range(3).write.parquet(str(tmp_path / "t"))
    assert len(files.readable(spark, [str(tmp_path / "t"), str(tmp_path / "no")], ["id"])) == 1


ROWS = [
    ("Nat.add", "Init.Prelude", "**Addition.** Adds two natural numbers.", None), ("Nat.add_comm", "Init.Data.Nat", "**Commutativity of addition.** Adding is commutative.", ["Nat.add"]),
    ("Nat.add_assoc", "Init.Data.Nat", "**Associativity of addition.** Adding is associative.", ["Nat.add"]), ("Nat.Prime", "Mathlib.Prime", "**Prime number.** A number with no divisors.", None),
    ("Nat.Prime.two_le", "Mathlib.Prime", "**Primes are at least two.** Every prime number is at least two.", ["Nat.Prime"]), ("Nat.Prime.mk", "Mathlib.Prime", "**Prime constructor.** prime", ["Nat.Prime"]),
    ("List.map", "Init.List", None, None),
]


@pytest.fixture(scope="module")
def engine(spark):
    rows = [(i, n, m, None, "src", "link", d, t) for i, (n, m, t, d) in enumerate(ROWS, 1)]
    df = spark.createDataFrame(rows, "id long, name string, module string, docstring string, source_text string, source_link string, dependencies array<string>, informalization string")
    return SearchEngine.build(df.withColumn("informalization_embedding", F.when(F.col("informalization").isNotNull(), hashed_vector(F.col("informalization")))), hashed_words())


def found(engine, spark, q, **options):
    rows = engine.search(spark.createDataFrame([(0, q)], "query_id long, query string"), **options)
    return [r["name"] for r in rows.orderBy("position").collect()]


def test_search(engine, spark, tmp_path):
    assert found(engine, spark, "prime number")[0] in ("Nat.Prime", "Nat.Prime.two_le")
    assert "Nat.Prime.mk" not in found(engine, spark, "prime") and "Nat.Prime.mk" not in found(engine, spark, "prime", rerank_top=0)
    assert found(engine, spark, "Nat.add", rerank_top=0)[0] == "Nat.add"
    assert set(found(engine, spark, "addition", packages=["Mathlib"])) <= {"Nat.Prime", "Nat.Prime.two_le"}
    assert found(engine, spark, "  \n") == [] and len(found(engine, spark, "nat", limit=2)) == 2
    two = engine.search(spark.createDataFrame([(1, "prime"), (2, "associativity")], "query_id long, query string"), limit=1)
    assert {r["query_id"] for r in two.collect()} == {1, 2}
    engine.save(f"{tmp_path}/index")
    again = SearchEngine.load(spark, f"{tmp_path}/index", engine.declarations, hashed_words())
    assert found(again, spark, "prime number") == found(engine, spark, "prime number")


def test_service(engine):
    s = Service(engine)
    answer = s.search("prime", limit=3)
    assert answer["count"] == len(answer["results"]) <= 3 and "informalization_embedding" not in answer["results"][0]
    assert all(set(r) <= {"id", "name", "description"} for r in s.search_summary("prime")["results"])
    assert s.get_by_id(1)["name"] == "Nat.add" and s.get_by_id(77) is None
    assert s.get_field(4, "module") == {"id": 4, "name": "Nat.Prime", "module": "Mathlib.Prime"} and s.get_field(77, "module") is None
    assert engine.get_by_name("List.map").first()["id"] == 7 and engine.get_by_name("list.map").count() == 0


def test_deep_layers(spark):
    """A chain of 1,000 names, a tree and a cycle, by a bounded number of jobs, and the same by rounds only."""
    rng = random.Random(5)
    deps = {f"c{i:04d}": [f"c{i - 1:04d}"] if i else [] for i in range(1000)}
    deps |= {f"t{i:03d}": [f"t{rng.randrange(i):03d}" for _ in range(rng.randrange(3))] if i else [] for i in range(150)}
    deps |= {"x1": ["x3"], "x2": ["x1"], "x3": ["x2", "x0"], "x0": [], "y": ["x3", "c0003"], "alone": ["outside", "alone"]}
    layer = {}
    while more := {n: 1 + max((layer[d] for d in own if d in deps and d != n), default=0) for n, own in deps.items() if n not in layer and all(d in layer or d not in deps or d == n for d in own)}:
        layer |= more
    layer |= {n: max(layer.values()) + 1 for n in deps if n not in layer}
    rows = names(spark, list(deps.items()))
    context = spark.sparkContext
    context.setJobGroup("layers", "counted")
    try:
        got = graph.layers(rows)
        jobs = len(context.statusTracker().getJobIdsForGroup("layers"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert {r["name"]: r["layer"] for r in got.collect()} == layer and got.count() == len(deps) and jobs < 300
    few = names(spark, [x for x in deps.items() if x[0][0] in "txy" or x[0] < "c0008"])
    whole = {r["name"]: r["layer"] for r in graph.layers(few).collect()}
    assert whole == {r["name"]: r["layer"] for r in graph.layers(few, 2, 5).collect()} == {r["name"]: r["layer"] for r in graph.layers(few, 100).collect()}


def test_long_chains_are_made_shorter(spark, monkeypatch):
    """A chain and a cycle of more edges than a task peels take jobs by the logarithm of their length; the same layers as in memory."""
    rng = random.Random(6)
    deps = {f"c{i:03d}": [f"c{i - 1:03d}"] if i else [] for i in range(60)} | {f"r{i:02d}": [f"r{(i + 1) % 20:02d}"] for i in range(20)}
    deps |= {f"t{i:03d}": [f"t{rng.randrange(i):03d}" for _ in range(rng.randrange(1, 4))] if i else [] for i in range(20)}
    deps |= {"u": ["c030", "t015"], "v": ["u"], "w": ["v", "u", "c059"], "y": ["r05", "c010"], "self": ["self"]}
    layer = {}
    while more := {n: 1 + max((layer[d] for d in own if d != n), default=0) for n, own in deps.items() if n not in layer and all(d in layer or d == n for d in own)}:
        layer |= more
    layer |= {n: max(layer.values()) + 1 for n in deps if n not in layer}
    rows = names(spark, list(deps.items()))
    made = []
    monkeypatch.setattr(graph, "stored", lambda df, f=graph.stored: made.append(1) or f(df))
    got = stored(graph.layers(rows, 1, 50, 50))
    assert {r["name"]: r["layer"] for r in got.collect()} == layer and got.count() == len(deps) and len(made) < 60


def test_extract_steps(spark):
    assert extract.resolve_steps() == extract.Steps() and extract.resolve_steps(embed=True) == extract.Steps(False, False, True, False)
    assert extract.resolve_steps(embed=False) == extract.Steps(False, False, False, False)
    target = spark.createDataFrame([], DECLARATION)
    rows = spark.createDataFrame([("b", "M", None, "s b", "l", None), ("a", "M", "d", "s a", "l", ["b"]), ("a", "N", "d", "other", "l", None)], "name string, module string, docstring string, source_text string, source_link string, dependencies array<string>")
    first, n = extract.add_declarations(target, rows)
    assert n == 2 and sorted((r["id"], r["name"], r["module"]) for r in first.collect()) == [(1, "a", "M"), (2, "b", "M")]
    _, n = extract.add_declarations(first, rows)
    assert n == 0
    cache = spark.createDataFrame([("a", "s a", "cached")], "name string, source_text string, informalization string")
    filled = extract.informalize(first, [cache], "{name}", lambda p: F.upper(p))
    assert {r["name"]: r["informalization"] for r in filled.collect()} == {"a": "cached", "b": "B"}
    done = extract.embed(filled, [], lambda c: hashed_vector(c, 4))
    assert all(sum(r["informalization_embedding"]) == 1 for r in done.collect())


def test_killed_enrichment(spark, tmp_path):
    """A batch that fails halfway leaves nothing that counts, and is made again; one that was logged is not."""
    spark.range(40).withColumn("v", F.lit(None).cast("string")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, v string").parquet(f"{tmp_path}/in").drop("v")
    cache = resumable.ResumableCache(spark, f"{tmp_path}/cache", StructType().add("id", "long").add("v", "string"), ["id"], 8)
    asked = []

    def generate(rows):
        asked.append(rows.count())
        return rows.withColumn("v", F.lit(f"run {len(asked)}"))

    def run(fails=False, state="state"):
        touch = Folder.touch
        if fails:  # the rows are written, the log isn't
            Folder.touch = lambda *_: 1 / 0
        try:
            resumable.enrich_stream(stream, cache.path, ["id"], "v", generate, f"{tmp_path}/{state}", 8).awaitTermination()
        finally:
            Folder.touch = touch

    with pytest.raises(Exception):
        run(fails=True)
    left = Folder(cache.path, spark).matching("bucket=*/addition=0")
    assert left and cache.log() == [] and cache.rows().count() == 0
    run()
    assert asked == [40, 40] and len(cache.log()) == 1 and cache.rows().groupBy("v").count().collect() == [("run 2", 40)]
    run()  # nothing arrives
    spark.createDataFrame([(i, None) for i in [*range(30, 50), None, 45]], "id long, v string").write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert asked == [40, 40, 10] and sorted(r["id"] for r in cache.rows().collect()) == list(range(50))
    run(state="other")  # a new stream over the same cache finds all of it
    assert asked[3:] in ([0], [0, 0]) and cache.rows().count() == 50
    assert "bucket" in cache.rows([3])._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1].split("]")[0]
    for f in Folder(cache.path, spark).matching("bucket=3/addition=*/part-*"):  # a file that can't be read is an error, not a first batch
        (tmp_path / f.split(f"{tmp_path}/")[1]).write_bytes(b"broken")
    spark.range(100, 140).withColumn("v", F.lit(None).cast("string")).write.mode("append").parquet(f"{tmp_path}/in")
    with pytest.raises(Exception):
        run()


def test_trailing_stream(spark, tmp_path):
    """In batches that come in order, the batch operator's rows; late rows as the docstring says; state goes with the watermark."""
    rng = random.Random(1)
    times = sorted(rng.sample(range(20_000), 400))
    rows = [(i, rng.choice("ab"), t, "x") for i, t in enumerate(times)]
    schema = "id long, k string, s long, _odd string"
    make = lambda r: spark.createDataFrame(r, schema).withColumn("ts", F.timestamp_seconds("s"))
    was = spark.conf.get(trailing.STATE_STORE[0])
    spark.conf.set(*trailing.STATE_STORE)

    def run():
        source = spark.readStream.schema(make(rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = trailing.trailing_stream(source, 60, ["k"], late=100).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination()
        return q.lastProgress

    try:
        for part in range(4):
            make(rows[part * 100 : part * 100 + 100]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            run()
        got = {r["id"]: (r["in_window"], r["per_second"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
        want = {r["id"]: (r["in_window"], r["per_second"]) for r in rates.trailing_rates(make(rows), 60, ["k"]).collect()}
        assert got == want
        last = times[-1]
        make([(900, "a", last - 50, "x"), (901, "a", last + 10_000, "x"), (902, "a", 5, "x"), (903, "b", None, "x")]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        progress = run()
        got = {r["id"]: r["in_window"] for r in spark.read.parquet(f"{tmp_path}/out").where("id >= 900").collect()}
        assert got == {900: 1 + sum(k == "a" and last - 110 <= t <= last - 50 for _, k, t, _ in rows), 901: 1}
        assert progress["stateOperators"][0]["numRowsTotal"] <= 12  # of some 400 events
    finally:
        spark.conf.set(trailing.STATE_STORE[0], was)


def test_trailing_rates(spark):
    rows = spark.createDataFrame([(0, "a"), (2, "a"), (4, "a"), (100, "a")], "s long, k string").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["s"]: r["per_second"] for r in rates.trailing_rates(rows, 10, ["k"]).collect()}
    assert got == {0: None, 2: 1.0, 4: 0.75, 100: None}


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i % 60:02d}:00", "u", float(i)) for i in range(90)]
    spark.createDataFrame(rows, "id long, ts string, k string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/in")
    batch = spark.read.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    rates.windowed_counts(stream, "10 minutes", "5 minutes", ["k"], late="1 hour").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start().awaitTermination()
    want = rates.windowed_counts(batch, "10 minutes", "5 minutes", ["k"])
    assert sorted(spark.table("w").collect()) == sorted(want.collect()) and want.agg(F.sum("events")).first()[0] == 180
