from __future__ import annotations

import difflib
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import models, scoring, text, udfs
from quillon.functions import vectors as V


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


X = None


@pytest.fixture(autouse=True)
def _column(spark):
    global X
    X = F.col("x")


@pytest.mark.parametrize(("value", "tokens"), [("Nat.addComm_two", ["nat", "add", "comm", "two"]), ("", []), ("HTTPServer", ["httpserver"]), ("Éa.β_1", ["éa", "β", "1"])])
def test_tokenize_spaced(spark, value, tokens):
    assert one(spark, text.tokenize_spaced(X), value) == tokens


def test_tokenize_raw_and_words(spark):
    assert one(spark, text.tokenize_raw(X), "Nat.Add") == ["nat.add"]
    assert one(spark, text.tokenize_raw(X), "") == []
    assert one(spark, text.tokenize_words(X), "a_b camelCase, É1!") == ["a_b", "camelcase", "é1"]


@pytest.mark.parametrize(("value", "header"), [("**Prime.** text", "Prime."), ("no", None), ("x **a**", None), ("****", None), ("**a\nb**", None), ("**a\rb** c", "a\rb"), (None, None)])
def test_bold_header(spark, value, header):
    assert one(spark, text.bold_header(X), value) == header


@pytest.mark.parametrize(("value", "found"), [('["A","B"]', ["A", "B"]), (None, []), ("not json [", []), ('{"A": 1}', []), ("null", []), ("", [])])
def test_parsed_dependencies(spark, value, found):
    assert one(spark, text.parsed_dependencies(X), value) == found


def test_strict_dependencies_fail(spark):
    assert one(spark, text.strict_dependencies(X), '["A"]') == ["A"]
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        one(spark, text.strict_dependencies(X), "not json [")


def test_small_functions(spark):
    assert one(spark, text.has_any_prefix(X, ["A.B", "C"]), "A.B.c") and not one(spark, text.has_any_prefix(X, ["A.B"]), "A.Bc")
    assert one(spark, text.is_projection_name(X), "A.toB") and not one(spark, text.is_projection_name(X), "A.tob") and not one(spark, text.is_projection_name(X), "A.to")
    assert one(spark, text.linked_names(X), '<a href="x#B"><a href="y#A"><a href="#B"><a href="z">') == ["B", "A"]
    p = one(spark, text.link_parts(X), "https://github.com/o/pkg-4/blob/abc/src/lean/A/B.lean#L3-L9")
    assert (p["package"], p["path"], p["line_start"], p["line_end"]) == ("pkg-4", "src/lean/A/B.lean", 3, 9)
    assert one(spark, text.link_parts(X), "nothing") is None
    assert one(spark, text.package_variants(X), "Some-Pkg4") == ["some-pkg4", "some-pkg", "somepkg4"]
    place = lambda p, f: (one(spark, text.path_in_package(F.lit(p), F.lit(f), X), "src/lean/A.lean"), one(spark, text.path_in_package(F.lit(p), F.lit(f), X), "src/lake/A.lean"), one(spark, text.path_in_package(F.lit(p), F.lit(f), X), "src/A.lean"))
    assert place("lean4", "t/src/lean") == ("t/src/lean/A.lean", "t/src/lake/A.lean", "t/src/lean/A.lean")
    assert place("lean4", "lean") == ("lean/A.lean", "lake/A.lean", "lean/A.lean") and place("x", "x") == ("x/src/lean/A.lean", "x/src/lake/A.lean", "x/src/A.lean")
    assert one(spark, text.shortened(X), "x" * 300) == "x" * 253 + "..." and one(spark, text.shortened(X), "x" * 256) == "x" * 256
    assert one(spark, text.trimmed(X), "  \t a b\n") == "a b" and one(spark, text.trimmed(X), " \n") is None
    assert one(spark, text.is_blank(X), "  ") and not one(spark, text.is_blank(X), " a")
    assert one(spark, text.version_of(X), "pkg:v4.29.0-rc6 x") == "v4.29.0-rc6" and one(spark, text.version_of(X), "4.2") is None
    assert one(spark, text.version_key(X), "v1.2.0-rc1") == [1, 2, 0, 1]
    assert one(spark, text.raw_file_url(X, F.lit("main"), F.lit("a/b")), "https://github.com/o/r.git") == "https://raw.githubusercontent.com/o/r/main/a/b"
    assert one(spark, text.fill_template("{{a}} {x}", x=X), "{b}") == "{a} {b}"
    assert one(spark, text.without_self(F.array(F.lit("a"), X), F.lit("a")), "a") is None
    assert one(spark, text.rerank_document(F.lit("n"), X), "") == "n" and one(spark, text.rerank_document(F.lit("n"), X), "t") == "n: t"


@pytest.mark.parametrize(("version", "yes"), [("v4.29.0", True), ("v4.29.0-rc2", True), ("v4.29.0-rc1", False), ("v4.28.9", False), ("v4.30.0-rc1", True), ("v5.0.0", True), ("nightly", False)])
def test_at_least_version(spark, version, yes):
    assert one(spark, text.at_least_version(X), version) is yes


@pytest.mark.parametrize(("source", "plain"), [("a -- b\nc", "a c"), ("a /- x /- y -/ z -/ b", "a b"), ("/- open", ""), ("a /-- doc -/\n  def  x", "a def x"), ("-/-x-/ y", "- y"), ("a--/- b\nc -/", "a c -/"), ("/- -- -/ z", "z")])
def test_uncommented(spark, source, plain):
    assert udfs.uncommented(source) == plain
    assert one(spark, udfs.strip_comments(X), source) == plain


def _by_characters(source):
    kept, depth, i = [], 0, 0
    while i < len(source):
        two = source[i : i + 2]
        if two == "/-":
            depth, i = depth + 1, i + 2
        elif depth and two == "-/":
            depth, i = depth - 1, i + 2
        elif depth:
            i += 1
        elif two == "--":
            i = source.find("\n", i) if "\n" in source[i:] else len(source)
        else:
            kept.append(source[i])
            i += 1
    return " ".join("".join(kept).split())


def test_uncommented_random():
    rng = random.Random(0)
    for _ in range(3000):
        s = "".join(rng.choice("-/-/a \n") for _ in range(rng.randrange(20)))
        assert udfs.uncommented(s) == _by_characters(s), s


def test_fuzzy(spark):
    got = one(spark, udfs.fuzzy_name_score(F.lit("Nat.add comm"), X), "nat_add.Comm")
    assert got == difflib.SequenceMatcher(None, "nat add comm", "nat add comm").ratio() == 1.0
    assert one(spark, udfs.fuzzy_name_score(F.lit("abc"), X), None) is None


def _name(*parts):
    return b"".join(b"\x02" if isinstance(p, int) else b"\x01" for p in reversed(parts)) + b"\x00" + b"".join(bytes([p]) if isinstance(p, int) else bytes([len(p)]) + p.encode() for p in parts)


def test_rendered_names(spark):
    const = lambda *p: b"\x01\x02" + _name(*p) + b"\x00\x01x"
    blob = b"\x02\x05" + const("Nat", "add") + const("Nat") + const("Nat", "add") + const() + b"\x01\x00\x00\x80\x01" + b"y" * 128
    assert udfs.rendered_names(blob) == ["Nat.add", "Nat"]
    assert udfs.rendered_names(const("a", 7)) == ["a.7"]
    assert udfs.rendered_names(blob[:-1]) == [] and udfs.rendered_names(b"\x09") == [] and udfs.rendered_names(None) == []
    assert one(spark, udfs.names_in_rendered_code(X), bytearray(blob), "binary") == ["Nat.add", "Nat"]


def test_vectors(spark):
    assert one(spark, V.unpack_floats(V.pack_floats(X)), [1.5, -2.0], "array<float>") == [1.5, -2.0]
    assert one(spark, V.unit(X), [3.0, 4.0], "array<float>") == pytest.approx([0.6, 0.8])
    assert one(spark, V.inner_product(X, F.array(F.lit(2.0), F.lit(1.0))), [3.0, 4.0], "array<float>") == 10.0


def test_normalized(spark):
    from pyspark.sql import Window

    def norm(values):
        df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(values)], "q int, i int, v double")
        return [r["s"] for r in df.select("i", scoring.normalized(F.col("v"), Window.partitionBy("q")).alias("s")).orderBy("i").collect()]

    assert norm([1, 3, 2]) == [0.0, 1.0, 0.5] and norm([2, 2]) == [1.0, 1.0] and norm([0, 0]) == [0.0, 0.0] and norm([-1, -1]) == [0.0, 0.0]
    df = spark.createDataFrame([(0, 0), (0, 3)], "q int, c long")
    assert [round(r["s"], 6) for r in df.select("c", scoring.log_normalized(F.col("c"), Window.partitionBy("q")).alias("s")).orderBy("c").collect()] == [0.0, 1.0]


def test_models(spark):
    """Batches of like length, prompts for queries only, capped inputs, each distinct text once, nulls."""

    def load():
        return lambda texts: [[len(texts), len(t.split()), t.startswith("Query: ")] for t in texts]

    model = models.TextModel(load, prompt="Query: ", max_tokens=4, batch=2)
    rows = spark.createDataFrame([(0, "a b c d e f"), (1, None), (2, "x"), (3, "x"), (4, ""), (5, "y z")], "query_id long, query string").coalesce(1)
    assert {r["query_id"]: r["v"] for r in rows.select("query_id", model.documents(F.col("query")).alias("v")).collect()} == {0: [2, 4, 0], 1: None, 2: [2, 1, 0], 3: [2, 1, 0], 4: [2, 0, 0], 5: [2, 2, 0]}
    assert {r["query_id"]: r["embedding"] for r in model.query_table(rows).collect()}[0] == [2, 5, 1]
    pairs = models.PairModel(lambda: lambda texts: [len(t.split()) * 100 + len(texts) for t in texts], "Q {query} D {document}", max_tokens=5, batch=3)
    assert pairs.text("one {document}", "a b c d e") == "Q one {document} D a b c" and pairs.text("a b c d e f", "x") == "Q a b c d e D "
    got = rows.select("query_id", pairs.score(F.lit("who"), F.col("query")).alias("s")).collect()
    assert {r["query_id"]: r["s"] for r in got} == {0: 703, 1: None, 2: 403, 3: 403, 4: 301, 5: 503}
    assert models.in_batches([], lambda t: t, 3) == [] and models.in_batches(["b", "aa", "b"], lambda t: [x * 2 for x in t], 1) == ["bb", "aaaa", "bb"]
