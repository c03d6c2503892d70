"""The pipeline against its stages' brute-force versions, and the registered queries."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_in_order(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
        if name != "tokens":
            assert docs.columns == columns
    assert counts == sorted(counts, reverse=True) and 0 < counts[-1] < counts[0]
    kept = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/benchmark").collect()}
    for r in docs.collect():
        assert r["decoded_sha256"] == hashlib.sha256(kept[r["doc_id"]].encode()).hexdigest()


def brute_votes(model, texts):
    """Votes of a fitted model, one text and one labelled vector at a time."""
    import math
    import zlib
    from collections import Counter

    from quillon.llm import quality

    out = []
    for t in texts:
        parts = (t or "").split()
        place = lambda x: zlib.crc32(x.encode()) * 0x9E3779B1 >> 7 & (1 << quality.BITS) - 1
        count = Counter(p for x in parts for p in set(map(place, quality.quality_terms(x))))
        count.update(map(place, quality.repeat_marks(parts)))
        v = sum((math.log1p(n) * model.axes[p].astype(float) for p, n in count.items()), np.zeros(model.axes.shape[1]))
        length = math.sqrt(v @ v)
        near = sorted(((float(x @ v) / length, y) for x, y in zip(model.vectors.astype(float), model.labels)), reverse=True) if length else []
        weight = [(max(s, 0), y) for s, y in near if s >= near[min(model.neighbours, len(near)) - 1][0] - quality.TIE]
        total = sum(w for w, _ in weight)
        out.append(sum(w * y for w, y in weight) / total if total > 1e-9 else model.labels.mean())
    return out


def test_stages_decide_as_brute_force(spark, data, tmp_path):
    """The whole run: the ids and texts that each stage keeps, from what the one before kept, and the tokens at its end."""
    import base64

    import public_tokenizers
    import tiktoken
    from test_operators import brute_components, brute_hits, brute_lines, brute_sets

    from quillon.llm import quality as quality_model

    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = quality_model.fit(docs, spark.read.parquet(f"{data}/labels.parquet"))

    def quality(rows):
        return {i: t for (i, t), vote in zip(rows, brute_votes(model, [t for _, t in rows])) if vote >= 0.3}

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]

    def lines(rows):
        left = brute_lines(rows)
        return {i: left.get(i, t) for i, t in rows if left.get(i) == t or left[i].replace("\n", " ").strip(" ")}

    def near_duplicates(rows):
        least = brute_components([i for i, _ in rows], brute_sets([t for _, t in rows]), 80)
        return {i: t for i, t in rows if least[i] == i}

    def benchmark(rows):
        return {i: t for (i, t), hit in zip(rows, brute_hits([t for _, t in rows], items)) if not hit[-1]}

    stages = dict(corpus_pipeline.STAGES)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert len({i for i, _ in rows}) == len(rows)
    for want in (quality, lines, near_duplicates, benchmark):
        stages[want.__name__](spark, docs, data).write.parquet(f"{tmp_path}/{want.__name__}")
        docs = spark.read.parquet(f"{tmp_path}/{want.__name__}")
        rows = sorted(want(rows).items())
        assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == rows
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    encode = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    got = {r["doc_id"]: list(r["token_ids"]) for r in corpus_pipeline.run(spark, data).collect()}
    assert got == {i: encode(t) for i, t in rows}


def test_near_duplicates_link_from_80(spark, data):
    words = [f"w{i}" for i in range(200)]
    near = [f"x{i}" if i in (20, 70, 120, 170) else w for i, w in enumerate(words)]  # 176 of 216 shingles
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near))], "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert [r["doc_id"] for r in stage(spark, docs, data).collect()] == [1]


def test_clashing_names(spark, data):
    """Columns with the stages' own names come through each stage as they are; n_chars may be missing."""
    names = ["removed_lines", "__gone", "__id", "__mark", "id", "mark", "score", "predicted", "kept", "kept_id", "spans", "items", "component_id", "contaminated"]
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(40).select("doc_id", "text", *(__import__("pyspark.sql.functions", fromlist=["lit"]).lit(f"own {n}").alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, data).collect()
        assert rows, name
        assert all(r[n] == f"own {n}" for r in rows for n in names)


def test_edge_rows(spark, data):
    rows = [(1, None, "en", "s", 0, 1), (2, "", "en", "s", 0, 1), (None, "some words of a text", "en", "s", 20, 1), (3, "a\nb " * 2000, "en", "s", 8000, 1), (3, "a\nb " * 2000, "en", "s", 8000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        n = out.count()
        assert 0 <= n <= 5 and (name == "tokens" or out.columns == docs.columns)
        assert name not in ("near_duplicates", "tokens") or n == 5
        assert stage(spark, docs.limit(0), data).count() == 0


def test_queries_are_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert [any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [True] * 10 and "pipeline" in names
