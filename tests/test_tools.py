from __future__ import annotations

import io
import json
import sqlite3
import time

import pytest
from pyspark.sql import functions as F

from quillon import __main__
from quillon.plans.serve import serve
from quillon.plans.search import hashed_vector
from quillon.plans.tools import Backend, Tools, header, rendered
from quillon.sources import remote, versions

ANSWER = {"results": [{"id": 1, "name": "a", "informalization": "**A.** text", "docstring": None}, {"id": 2, "name": "b", "informalization": None}], "processing_time_ms": 7}


def fake(seen):
    def get(url, headers):
        seen.append((url, headers))
        return ANSWER if "/search" in url else {"id": 1, "name": "a", "module": "M", "docstring": None} if url.endswith("/1") else None

    return get


def test_remote_client_and_tools():
    seen = []
    client = remote.RemoteClient("http://x/", "k", fake(seen))
    assert isinstance(client, Backend)
    assert client.search("p q", packages=["A", "B"])["count"] == 2
    assert seen[0] == ("http://x/search?q=p+q&limit=20&packages=A%2CB", {"Authorization": "Bearer k"})
    tools = Tools(client)
    assert tools.search_summary("q")["results"] == [{"id": 1, "name": "a", "description": "A."}, {"id": 2, "name": "b"}]
    assert tools.get_module(1) == {"id": 1, "name": "a", "module": "M"} and tools.get_docstring(1) == {"id": 1, "name": "a"} and tools.get_module(9) is None
    assert rendered(ANSWER, 1) == "1. a  A.\n... 1 more"
    with pytest.raises(RuntimeError):
        Tools(None)


def test_remote_rows(spark):
    client = remote.RemoteClient("http://x", None, lambda url, headers: ANSWER)
    rows = remote.remote_search(spark.createDataFrame([(4, "q")], "query_id long, query string"), client).collect()
    assert [(r["query_id"], r["position"], r["name"]) for r in rows] == [(4, 1, "a"), (4, 2, "b")]


def test_header():
    assert [header(x) for x in (None, "x", "**a** b", "****", "**a\nb**", "** **")] == [None, None, "a", None, None, " "]


def test_versions(tmp_path, monkeypatch):
    root = str(tmp_path)
    assert versions.active(root, "v0") == "v0"
    versions.set_active(root, "v1")
    assert versions.active(root, "v0") == "v1"
    monkeypatch.setenv("QUILLON_VERSION", "v9")
    assert versions.active(root, "v0") == "v9"

    def download(part, to):
        with open(to, "w") as f:
            f.write(part)

    assert versions.fetch(f"{root}/v1", ["a", "d/b"], download) == ["a", "d/b"] and versions.fetch(f"{root}/v1", ["a", "d/b", "c"], download) == ["c"]
    assert versions.missing(f"{root}/v1", ["a", "z"]) == ["z"]
    (tmp_path / "v2").mkdir()
    assert versions.clean(root, "v1") == ["v2"] and versions.clean(f"{root}/none") == []


def test_command_line(spark, tmp_path, capsys):
    from pyspark.sql import functions as F

    rows = [(1, "Nat.add", "Init", "s", "l", "**Addition.** Adds."), (2, "List.map", "Init", "s", "l", "**Map.** Maps.")]
    df = spark.createDataFrame(rows, "id long, name string, module string, source_text string, source_link string, informalization string")
    df = df.withColumns({"docstring": F.lit(None).cast("string"), "dependencies": F.lit(None).cast("array<string>"), "informalization_embedding": hashed_vector(F.col("informalization"))})
    df.write.parquet(f"{tmp_path}/declarations.parquet")
    assert __main__.main(["search", "map", "--data", str(tmp_path)]) == 0
    assert capsys.readouterr().out.startswith("1. List.map  Map.")


def test_retries():
    calls, waits = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return 5

    assert remote.retried(call, sleep=waits.append) == 5 and waits == [2.0, 2.0]
    with pytest.raises(ZeroDivisionError):
        remote.retried(lambda: 1 / 0, sleep=waits.append)
    assert [remote.doubling(30)(k) for k in range(3)] == [30, 60, 120] and remote.retried(lambda: 1) == 1


def test_remote_vectors_and_texts(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "bcd"), (3, "ef")], "id long, text string")
    got = remote.remote_vectors(texts, "http://x/", batch=2, post=lambda url, body: {"embeddings": [[float(len(t)), float(url.endswith("/api/v2/embed"))] for t in body["texts"]]})
    assert {r["id"]: list(r["embedding"]) for r in got.collect()} == {1: [1, 1], 2: [3, 1], 3: [2, 1]}
    chat = lambda url, body, headers: {"choices": [{"message": {"content": " " if body["messages"][0]["content"] == "a" else body["model"] + headers["Authorization"]}}]}
    answers = remote.remote_texts(texts.withColumnRenamed("text", "prompt"), "http://x", "m", "k", tasks=2, post=chat)
    assert {r["id"]: r["answer"] for r in answers.collect()} == {1: None, 2: "mBearer k", 3: "mBearer k"}


def test_requests_in_flight(spark, tmp_path):
    """A task has so many requests under way at once and no more, and a slow or failing one holds up or loses no other."""
    place = str(tmp_path)

    def slow(url, body, headers):
        text = body["messages"][0]["content"]
        began = time.time()
        time.sleep(2.5 if text == "p0" else 0.05)
        with open(f"{place}/{text}", "w") as f:
            f.write(f"{began} {time.time()}")
        if text == "p7":
            raise ValueError("refused")
        return {"choices": [{"message": {"content": text.upper()}}]}

    prompts = spark.range(60).select("id", F.concat(F.lit("p"), F.col("id")).alias("prompt")).coalesce(1)
    rows = remote.remote_texts(prompts, "http://x", "m", tasks=1, in_flight=4, chunk=5, post=slow).collect()
    assert {r["id"]: r["answer"] for r in rows} == {i: None if i == 7 else f"P{i}" for i in range(60)}
    at = {i: tuple(map(float, (tmp_path / f"p{i}").read_text().split())) for i in range(60)}
    under_way = [sum(a <= t < b for a, b in at.values()) for t, _ in at.values()]
    assert max(under_way) == 4 and [r["id"] for r in rows].index(0) > 20
    with pytest.raises(Exception, match="refused"):
        remote.remote_texts(spark.createDataFrame([("p7",)] * 5, "prompt string"), "http://x", "m", tasks=1, failures=2, in_flight=2, post=slow).collect()


def test_repository_metadata(tmp_path):
    seen = {"https://raw.githubusercontent.com/o/r/v1/lean-toolchain": "lean:v4.2.0\n", "https://api.github.com/repos/o/r/tags?per_page=100": json.dumps([{"name": n} for n in ("nightly", "v1.9.0", "v1.10.0", "v1.10.0-rc1")])}
    assert remote.toolchain("https://github.com/o/r.git", "v1", seen.__getitem__) == "lean:v4.2.0"
    assert remote.newest_tag("git@github.com:o/r", seen.__getitem__) == "v1.10.0-rc1"
    assert remote.newest_tag("https://github.com/o/r", lambda _: '[{"name": "b"}, {"name": "a"}]') == "b"
    for bad in (lambda _: "[]", lambda _: "no"):
        with pytest.raises(RuntimeError):
            remote.newest_tag("https://github.com/o/r", bad)
    with pytest.raises(ValueError):
        remote.toolchain("https://example.com/x")
    f = tmp_path / "build"
    f.write_text('require «docs» from git\n  "https://x/y" @ "v1"\nrequire other from git "z" @ "v1"\n')
    assert remote.pin_version(str(f), "docs", "v2") and not remote.pin_version(str(f), "docs", "v2")
    assert f.read_text() == 'require «docs» from git\n  "https://x/y" @ "v2"\nrequire other from git "z" @ "v1"\n'


def test_serve():
    asked = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "get_module", "arguments": {"declaration_id": 1}}}, {"id": 4, "method": "tools/call", "params": {"name": "search"}}, {"id": 5, "method": "gone"}]
    out = io.StringIO()
    serve(Tools(remote.RemoteClient("http://x", None, fake([]))), [*map(json.dumps, asked), "", "{"], out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [a["id"] for a in got] == [1, 2, 3, 4, 5, None] and len(got[1]["result"]["tools"]) == 8
    assert json.loads(got[2]["result"]["content"][0]["text"]) == {"id": 1, "name": "a", "module": "M"}
    assert ["error" in a for a in got] == [False, False, False, True, True, True]


def test_extract_command(spark, tmp_path, capsys):
    db = sqlite3.connect(f"{tmp_path}/api.db")
    db.executescript("""
        CREATE TABLE modules (name TEXT, source_url TEXT); CREATE TABLE name_info (module_name TEXT, position INTEGER, kind TEXT, name TEXT, type BLOB, render INTEGER);
        CREATE TABLE declaration_ranges (module_name TEXT, position INTEGER, start_line INTEGER, end_line INTEGER);
        CREATE TABLE declaration_markdown_docstrings (module_name TEXT, position INTEGER, text TEXT); CREATE TABLE declaration_verso_docstrings (module_name TEXT, position INTEGER, content BLOB);
        INSERT INTO modules VALUES ('M.A', 'https://github.com/o/pkg/blob/r/M/A.lean');
        INSERT INTO name_info VALUES ('M.A', 1, 'def', 'f', NULL, 1), ('M.A', 2, 'def', 'g', NULL, 1), ('M.A', 3, 'def', 'far', NULL, 1);
        INSERT INTO declaration_ranges VALUES ('M.A', 1, 1, 1), ('M.A', 2, 2, 2), ('M.A', 3, 90, 91);""")
    db.commit()
    (tmp_path / "src" / "pkg" / "M").mkdir(parents=True)
    (tmp_path / "src" / "pkg" / "M" / "A.lean").write_text("def f := 1\ndef g := 2\n")
    (tmp_path / "runs").mkdir()
    run = ["extract", "--root", f"{tmp_path}/runs", "--database", f"{tmp_path}/api.db", "--sources", f"{tmp_path}/src"]
    assert __main__.main(run) == 0
    here = capsys.readouterr().out.strip()
    rows = {r["name"]: r for r in spark.read.parquet(f"{here}/declarations").collect()}
    assert {n: r["source_text"].strip() for n, r in rows.items()} == {"f": "def f := 1", "g": "def g := 2"}
    assert rows["f"]["informalization"] == "f" and len(rows["g"]["informalization_embedding"]) == 64
    assert __main__.main(["search", "g", "--data", f"{tmp_path}/runs"]) == 0
    assert capsys.readouterr().out.startswith("1. g")
    assert __main__.main([*run, "--index"]) == 0  # the index step alone, over the snapshot that is there
    again = capsys.readouterr().out.strip()
    assert again != here and spark.read.parquet(f"{again}/declarations").count() == 2


def test_index_parts(spark, tmp_path):
    from quillon.plans import extract
    from quillon.schema import DECLARATION

    empty = spark.createDataFrame([], DECLARATION)
    assert extract.build_index(empty, f"{tmp_path}/none") == []
    some = spark.createDataFrame([(1, "a.b", "M", None, "s", "l", None, None, None)], DECLARATION)
    assert extract.build_index(some, f"{tmp_path}/names") == ["spaced", "raw"]
    full = spark.createDataFrame([(k, f"a{k}", "M", None, "s", "l", None, "t", [1.0, float(k)]) for k in range(9)], DECLARATION)
    assert extract.build_index(full, f"{tmp_path}/all", inverted=True) == ["spaced", "raw", "lists"]
    report = extract.index_report(full.withColumnRenamed("informalization_embedding", "embedding")).first()
    assert (report["vectors"], report["dimension"]) == (9, 2)
