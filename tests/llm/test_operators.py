"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and its edge cases."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter
from functools import partial

import numpy as np
import public_tokenizers
import pytest

from quillon.llm import byte_bpe, common, components, decontamination, language, line_dedup, media, near_dedup, quality, suffix_dedup, token_files, toxicity
from quillon.llm import hyperminhash as hmh
from quillon.llm.fm_index import FMIndex
from quillon.llm.suffix_array import suffix_array

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
LONG = " ".join(f"word{i}" for i in range(30_000))
EDGE = [(1, "One two three four five six seven.\nSecond line of this text here."), (2, None), (3, ""), (4, LONG), (5, "One two three four five six seven.\nSecond line of this text here."), (5, "One two three four five six seven.\nSecond line of this text here."), (None, "no id at all here"), (7, "\x00 \x1c é́ ΣΑΣ 😀 <|endoftext|> it's 'S"), (8, "  \n\n "), (9, "Ünïcode\twörds\r\nand more. " * 30)]
#: Names that operators use within themselves.
CLASH = ["id", "mark", "at", "k", "n", "block", "component", "label", "score", "predicted", "spans", "removed_lines", "media", "words", "h1"]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, "en", *range(len(CLASH))) for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"{c} int" for c in CLASH)).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, n_chars long")


@pytest.fixture(scope="module")
def small_pieces():
    """Operators that cut their input into many pieces."""
    return partial(_map_small)


def _map_small(df, column, make, schema, _=0):
    return common.map_pieces(df, column, make, schema, 3000)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def texts_of(df):
    return sorted(((r["doc_id"] if r["doc_id"] is not None else -1), (r["text"] or "")) for r in df.select("doc_id", "text").collect())


# 1 language


def test_forward_sums_all_segmentations():
    pieces = language.Pieces(["a", "b", "ab", "ba", "aba"])
    p = np.zeros((pieces.n + 1, 1))
    p[:-1, 0] = np.arange(1, pieces.n + 1) / 20
    model = language.LanguageModel(["x"], pieces, p, np.array([0.001]), np.zeros(1))
    chance = dict(zip(sorted(["a", "b", "ab", "ba", "aba"]), p[:, 0]))

    def brute(w):
        return 1.0 if not w else sum((chance.get(w[:k]) or (0.001 if k == 1 else 0)) * brute(w[k:]) for k in range(1, len(w) + 1))

    for w in ["a", "ab", "aba", "abab", "ac", "bbaab"]:
        assert np.isclose(np.exp(model.word_scores([w])[0, 0]), brute(w))


def segmentation_model(languages=2):
    rng = np.random.default_rng(6)
    pieces = language.Pieces(["a", "b", "ab", "ba", "aba", "bbb", "abababab", "▁", "▁a"])
    p = rng.random((pieces.n + 1, languages)) / 30
    p[-1] = 0
    return language.LanguageModel([f"l{g}" for g in range(languages)], pieces, p, np.array([1e-11, 1e-7])[:languages], np.zeros(languages))


def brute_segmentations(model, word):
    """(logarithms of the sums, expected uses of each piece and language), in exact fractions of whole numbers."""
    from fractions import Fraction

    vocabulary = sorted(["a", "b", "ab", "ba", "aba", "bbb", "abababab", "▁", "▁a"])
    n, out, logs = len(vocabulary), np.zeros((len(vocabulary) + 1, len(model.languages))), []
    for g in range(len(model.languages)):
        chance = {v: Fraction(float(model.p[i, g])) for i, v in enumerate(vocabulary)}
        spans = [(s, e, chance.get(word[s:e], Fraction(float(model.other[g])) if e - s == 1 else 0)) for e in range(1, len(word) + 1) for s in range(max(0, e - 8), e)]
        spans = [x for x in spans if x[2]]
        f = [Fraction(1)] + [Fraction(0)] * len(word)
        b = [Fraction(0)] * len(word) + [Fraction(1)]
        for s, e, c in spans:
            f[e] += f[s] * c
        for s, e, c in sorted(spans, reverse=True):
            b[s] += c * b[e]
        z = f[-1]
        logs.append(np.log(float(z.numerator >> max(0, z.numerator.bit_length() - 60))) + max(0, z.numerator.bit_length() - 60) * np.log(2) - np.log(float(z.denominator >> max(0, z.denominator.bit_length() - 60))) - max(0, z.denominator.bit_length() - 60) * np.log(2))
        for s, e, c in spans:
            i = vocabulary.index(word[s:e]) if word[s:e] in chance else n
            out[i, g] += float(f[s] * c * b[e] / z)
    return np.array(logs), out


@pytest.mark.parametrize("word", ["▁" + "ab" * 40, "日本語" * 30, "▁aあb" + "bba" * 21, "b" * 65, "ж" * 129])
def test_long_words_and_expected_counts(word):
    """Words over 40 letters, unknown scripts and what the fit counts, against exact sums over all segmentations."""
    model = segmentation_model()
    logs, counts = brute_segmentations(model, word)
    assert np.allclose(model.word_scores([word, word])[1], logs, rtol=1e-9)
    weights = np.array([[2.0, 0.5]])
    assert np.allclose(language.expected_counts(model, [word], weights), counts * weights, rtol=1e-8, atol=1e-12)


def test_unknown_scripts_have_scores(spark, docs):
    model = language.fit(docs.limit(80), language.sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model")), rounds=1)
    rows = spark.createDataFrame([(n, "ꙮ" * n) for n in (1, 30, 39, 40, 41, 100, 5000)], "doc_id long, text string")
    for r in language.predict(rows, model).collect():
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in model.languages


def test_language_held_out(docs):
    vocabulary = language.sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    from pyspark.sql import functions as F

    held = common.id_bucket("doc_id", 4) == 2
    out = language.predict(docs.withColumn("held", held), language.fit(docs.where(~held), vocabulary), keep=("held", "lang")).where(F.col("held")).toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() > 0.9
    assert out["score"].between(0, 1).all()


def test_language_edges(edge, empty, docs):
    vocabulary = language.sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    model = language.fit(docs.limit(50), vocabulary, rounds=1)
    rows = {r["doc_id"]: r for r in language.predict(edge, model).collect()}
    assert [rows[i]["lang_pred"] for i in (2, 3, 8)] == ["und"] * 3 and rows[4]["lang_pred"] in model.languages
    assert language.predict(empty, model).count() == 0
    blank = language.fit(empty, vocabulary)
    assert {r["lang_pred"] for r in language.predict(edge, blank).collect()} == {"und"}


# 2 suffix dedup


def test_suffix_array():
    rng = np.random.default_rng(3)
    for _ in range(400):
        s = rng.integers(0, rng.integers(1, 5), rng.integers(0, 50))
        x = s.tolist()
        assert suffix_array(s).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def brute_repeats(texts, length=400):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        hit = np.cumsum(cover)[:-1] > 0 if len(t) else np.zeros(0, bool)
        kept = np.frombuffer(t, np.uint8)[~hit].tobytes()
        out.append((len(t), int(hit.sum()), int((np.diff(np.r_[0, hit.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def planted(seed=1):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    base, passage = word(2500), word(420)
    texts = [word(600), base, base, base[:1100] + "X" + base[1101:], base[:700] + word(3) + base[700:], word(250) + passage + word(300), word(90) + passage, passage[:399] + word(500), word(50) + passage[:405], "ab" * 700, "z" * 900, "short", ""]
    near = [bytearray(base.encode()) for _ in range(25)]
    for x in near:
        for _ in range(6):
            x[rng.randrange(len(x))] = 33
    return [t.encode() for t in texts] + [bytes(x) for x in near]


def check_repeats(spark, texts):
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(df).collect()}
    assert [rows[i] for i in range(len(texts))] == brute_repeats(texts)


@pytest.mark.parametrize("many", [1000, 3])
def test_suffix_dedup_brute_force(spark, monkeypatch, small_pieces, many):
    monkeypatch.setattr(suffix_dedup, "map_pieces", small_pieces)
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    monkeypatch.setattr(suffix_dedup, "SHARD", 7)
    check_repeats(spark, planted())


def test_suffix_array_decides(monkeypatch):
    """Copies and shared strings are found among neighbours of the array's order, or not at all."""
    x = random.Random(1).randbytes(600)
    asked = (np.zeros(2, np.int64), 200, np.array([200, 200]), [x, x[:-30] + b"." * 30], np.array([True, False]))
    whole, spans = suffix_dedup.repeated(*asked)
    assert whole.tolist() == [True, False] and spans[0] == spans[1] == [(-200, 370)]
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda symbols: np.zeros(0, np.int64))
    whole, spans = suffix_dedup.repeated(*asked)
    assert not whole.any() and spans == [[], []]


@pytest.mark.parametrize("length", [360, 390, 399, 450])
def test_suffix_dedup_bounds_shards(spark, monkeypatch, length):
    """A passage that many documents share with different text around it never meets in one shard, and what must go goes."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = word(length)
    texts = [(word(rng.randrange(150, 400)) + passage + word(rng.randrange(150, 400))).encode() for _ in range(60)]
    texts += [(word(rng.randrange(150, 400)) + texts[0][300:300 + rng.randrange(300, 420)].decode() + word(200)).encode() for _ in range(10)]
    monkeypatch.setattr(suffix_dedup, "MANY", 10)
    monkeypatch.setattr(suffix_dedup, "SHARD", 5)
    whole = suffix_dedup.repeated

    def bounded(nodes, *more):
        if max(Counter(nodes.tolist()).values()) > 10:
            raise AssertionError("a shard holds more of a node's extents than MANY")
        return whole(nodes, *more)

    monkeypatch.setattr(suffix_dedup, "repeated", bounded)
    check_repeats(spark, texts)


def test_shared_strings_by_bytes(monkeypatch):
    """What members of a node share, against all pairs; also where every hash is the same, so that bytes alone decide."""
    rng = random.Random(9)
    for width in (0, 1, 5, 25, 200):
        for blunt in (False, True):
            base = bytes(rng.choice(b"ab") for _ in range(400 + width))
            own = [base]
            for _ in range(12):
                x = bytearray(base)
                for _ in range(rng.randrange(3) if width else 0):
                    k = rng.choice([*range(width), *range(400, 400 + width)])
                    x[k] = ord("c") + rng.randrange(2)
                own.append(bytes(x))
            own = list(dict.fromkeys(own))
            cut = [(rng.randrange(width + 1), rng.randrange(width + 1)) if rng.random() < 0.3 else (0, 0) for _ in own]
            cut = [(a, b) if a + b <= width else (0, 0) for a, b in cut]
            lefts = np.array([width - a for a, _ in cut])
            parts = [x[a : len(x) - b] for x, (a, b) in zip(own, cut)]
            if blunt:
                monkeypatch.setattr(suffix_dedup, "_mixed", lambda x: x * np.uint64(0))
            _, spans = suffix_dedup.repeated(np.zeros(len(own), np.int64), width, lefts, parts, np.zeros(len(own), bool))
            monkeypatch.undo()
            for i, x in enumerate(own):
                want, got = set(), set()
                for s in range(width + 1):
                    for j, y in enumerate(own):
                        if i != j and all(c[0] <= s and s + 400 <= 400 + width - c[1] for c in (cut[i], cut[j])) and x[s : s + 400] == y[s : s + 400]:
                            want |= set(range(s - width, s - width + 400))
                for a, b in spans[i]:
                    got |= set(range(a, b))
                assert got == want


def test_suffix_dedup_edges(edge, empty):
    rows = suffix_dedup.remove_repeats(edge)
    got = sorted((r["doc_id"] or -1, r["n_bytes"]) for r in rows.collect())
    assert got == sorted((i or -1, len((t or "").encode())) for i, t in EDGE)
    assert suffix_dedup.remove_repeats(empty).count() == 0


# 3, 9 classifiers


def brute_machine(m, ids):
    f = m.table[ids].astype(float)
    pair = sum(f[i, 2:] @ f[j, 2:] for i in range(len(ids)) for j in range(i))
    return 1 / (1 + np.exp(-(m.bias + f[:, 0].sum() + pair)))


def test_machine_learns_pairs():
    """A label that is 1 for both or neither of two terms can't be told by single weights."""
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2, (2, 2000))
    rows = np.concatenate([np.nonzero(a)[0], np.nonzero(b)[0], np.arange(2000)])
    ids = np.concatenate([np.full(a.sum(), 1), np.full(b.sum(), 2), np.full(2000, 3)])
    order = np.lexsort((ids, rows))
    m = toxicity.fit_machine(rows[order], ids[order], (a == b).astype(float), bits=4, epochs=40, rate=0.3, penalty=0)
    s = m.scores(rows[order], ids[order], 2000)
    assert ((s >= 0.5) == (a == b)).mean() > 0.99
    assert np.isclose(s[0], brute_machine(m, ids[order][rows[order] == 0]), atol=1e-5)


@pytest.mark.parametrize("seed", [0, 1])
def test_machine_finds_a_pair_among_common_terms(seed):
    """320 commoner terms without meaning don't hide the pair, in texts that weren't fitted either."""
    rng = np.random.default_rng(seed)
    n = 2000
    x = np.array([*rng.integers(0, 2, (2, n)), *((rng.random(n) < rng.uniform(0.6, 0.95)).astype(int) for _ in range(320))]).T
    y = (x[:, 0] == x[:, 1]).astype(float)
    rows, ids = np.nonzero(x)
    m = toxicity.fit_machine(rows[rows < n // 2], ids[rows < n // 2], y[: n // 2], bits=9)
    assert ((m.scores(rows, ids, n) >= 0.5) == (y > 0)).mean() > 0.99
    assert np.isclose(m.scores(rows, ids, n)[5], brute_machine(m, ids[rows == 5]), atol=1e-5)


def test_pair_scores_match_brute_force():
    rng = np.random.default_rng(2)
    x, e, var = rng.random((300, 11)) < rng.random(11), rng.normal(size=300), rng.random(300)
    c = x - x.mean(0)
    score = np.abs(np.einsum("n,ni,nj->ij", e, c, c)) / np.sqrt(np.einsum("n,ni,nj->ij", var, c**2, c**2))
    np.fill_diagonal(score, 0)
    for least in (1.0, 1.5, 2.5):
        assert toxicity.paired(x, e, var, least, block=4, texts=70).tolist() == (score >= least).any(0).tolist()


def test_votes_match_brute_force():
    rng = np.random.default_rng(0)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    v, x, y = unit(rng.normal(size=(300, 8))), unit(rng.normal(size=(40, 8))), rng.integers(0, 2, 300).astype(float)
    got = quality.NeighbourModel(np.zeros((1, 8), np.float32), v, y, 9).votes(x, block=7)
    for i in range(40):
        s = v @ x[i]
        near = np.argsort(-s)[:9]
        w = np.maximum(s[near], 0).astype(float)
        assert np.isclose(got[i], (w * y[near]).sum() / w.sum(), atol=1e-5)


def test_leading_vectors():
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(90, 12)) * 2.0 ** -np.arange(12) @ rng.normal(size=(12, 200))).astype(np.float32)
    got, want = quality.leading(x, 6), np.linalg.svd(x)[2][:6].T
    assert np.allclose(np.abs((got * want).sum(0)), 1, atol=1e-3)
    assert quality.leading(np.zeros((3, 0), np.float32), 6).shape == (0, 0) and quality.leading(x[:2], 6).shape == (200, 2)


def test_votes_of_equal_neighbours():
    """All that are as near as the last one vote, in any order of the labelled rows."""
    v = np.array([[1, 0]] * 6 + [[0.6, 0.8]] * 3, np.float32)
    y = np.array([1.0, 1, 1, 0, 0, 0, 1, 1, 0])
    for seed in range(10):
        order = np.random.default_rng(seed).permutation(9)
        m = quality.NeighbourModel(np.zeros((1, 2), np.float32), v[order], y[order], 3)
        assert np.allclose(m.votes(np.array([[1, 0], [0.6, 0.8], [0, 0]], np.float32)), [0.5, 2 / 3, 5 / 9])


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_in_any_partitions(spark, module, label):
    """The same rows, however they are dealt, give the same scores."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    found, was = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n, key in ((3, "doc_id"), (8, "text"), (200, "n_chars")):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            model = module.fit(docs.repartition(n, key), labels.repartition(n, "doc_id"))
            found.append(sorted((r["doc_id"], r["score"]) for r in module.predict(docs, model).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert found[0] == found[1] == found[2]


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(spark, module, label, edge, empty):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = module.fit(docs, labels)
    held = module.predict(docs, model).join(labels, "doc_id").where(common.id_bucket("doc_id", 5) == 0).toPandas()
    assert (held["predicted"] == held[label]).mean() > 0.85
    out = module.predict(edge, model).toPandas()
    assert len(out) == len(EDGE) and out["score"].between(0, 1).all()
    assert module.predict(empty, model).count() == 0
    blank = module.fit(docs, labels.limit(0))
    assert set(module.predict(edge, blank).toPandas()["score"]) == {0.0}


# 4 token files


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, edge, tmp_path, encoding):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    out = f"{tmp_path}/tokens"
    token_files.write_tokens(edge, out, open(path, "rb").read(), encoding=encoding)
    rows = token_files.read_tokens(spark, out).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted((i for i, _ in EDGE), key=lambda i: -1 if i is None else i)
    texts = {i: x for i, x in EDGE}
    start = 0
    for r in rows:
        ids = t.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"], r["token_ids"]) == (start, len(ids), ids)
        start += len(ids)
    digest = {r["doc_id"]: r["ids_crc32"] for r in token_files.token_digest(token_files.read_tokens(spark, out)).collect()}
    assert digest[3] == zlib.crc32((2).to_bytes(4, "little"))


def test_same_bytes():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2, 900).astype(np.uint8)
    y = x.copy()
    y[rng.integers(0, 900, 6)] ^= 1
    a, n = rng.integers(0, 700, (2, 3000)) // np.array([[1], [4]])
    got = token_files.same_bytes(x, a, a + n, y, a, a + n - (n > 170))
    assert got.tolist() == [bool(k <= 170 and np.array_equal(x[i : i + k], y[i : i + k])) for i, k in zip(a, n)]


def test_parts_that_share_a_hash():
    """The Thue-Morse word and its complement have one polynomial hash modulo 2^64, whatever the multiplier."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    x, y = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    raw = np.frombuffer((x + " " + y).encode(), np.uint8)
    power = [token_files.powers(b, len(raw)) for b in (token_files._MULTIPLIER, token_files._INVERSE)]
    assert len(set(token_files.parts_of(raw, np.array([len(raw)]), *power)[2].tolist())) == 1
    for calls in ([[x, y, f"{y} {x} other"]], [[x], [y], [x + " " + y]], [[y + "! " + x], [x]]):
        common.drop_caches()
        encode = token_files.word_encoder(open(path, "rb").read())
        for texts in calls:
            ids, n = encode([k.encode() for k in texts])
            want = [t.encode(k, add_special_tokens=False).ids for k in texts]
            assert ids.tolist() == sum(want, []) and n.tolist() == [len(w) for w in want]
    common.drop_caches()


def test_token_table_survives_clearing():
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    common.drop_caches()
    encode = token_files.word_encoder(open(path, "rb").read(), 50)
    rng = random.Random(0)
    for _ in range(30):
        texts = [" ".join("".join(rng.choice("abcXYZ.,!é1") for _ in range(rng.randrange(9))) for _ in range(20)) for _ in range(4)]
        ids, n = encode([x.encode() for x in texts])
        want = [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert ids.tolist() == sum(want, []) and n.tolist() == [len(w) for w in want]
    common.drop_caches()


def test_token_files_empty(empty):
    assert token_files.round_trip(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0


# 5 media


def test_media_round_trip():
    for n in (0, 1, 63, 64, 65, 999, 1000, 8000, 8001, 130_000):
        p = media.pad(random.Random(n).randbytes(n))
        stored = media.mux(p)
        found = media.demux(stored)
        assert len(p) % 64 == 0 and p and media.payload_of(stored, found) == p
        assert [c[2] for c in found.cues] == found.clusters and found.doc_type == "matroska"
        assert all(a[1] < b[1] for a, b in zip(found.packets, found.packets[1:]))


@pytest.mark.parametrize("lacing", [0, 1, 2, 3])
def test_lacing_and_unknown_sizes(lacing):
    frames = [bytes([k]) * n for k, n in enumerate([300] if lacing == 0 else [200] * 4 if lacing == 2 else [300, 255, 7, 600])]
    block = media.element(media.BLOCK_GROUP, media.element(media.BLOCK, media.block_body(2, -5, frames, lacing)))
    unknown = b"\x01" + b"\xff" * 7
    data = media._HEAD + media.SEGMENT.to_bytes(4, "big") + unknown + media.CLUSTER.to_bytes(4, "big") + unknown + media.uint(media.TIMESTAMP, 100) + block + media.CLUSTER.to_bytes(4, "big") + unknown + media.uint(media.TIMESTAMP, 900) + block
    found = media.demux(data)
    assert [data[o : o + n] for _, _, o, n, *_ in found.packets] == frames * 2
    assert {p[1] for p in found.packets} == {95_000_000, 895_000_000} and len(found.clusters) == 2


def packets_of(data):
    return len(media.demux(data).packets)


def test_media_tables(spark, edge, empty):
    stored = media.encode_media(edge)
    packets = media.packet_table(stored).toPandas()
    assert packets["error"].isna().all() and len(packets) >= len(EDGE)
    bad = spark.createDataFrame([(1, b"\x1a\x45\xdf\xa3\x84ab"), (2, None), (3, b"xx")], "doc_id long, media binary")
    assert media.packet_table(bad).where("error is not null").count() == 3
    cues = media.cue_table(stored).toPandas()
    assert cues["found"].all() and set(cues["doc_id"].dropna()) == {i for i, _ in EDGE if i is not None}
    texts = {i: (t or "").encode() for i, t in EDGE}
    for r in media.media_digest(edge).collect():
        payload = media.pad(texts[r["doc_id"]])
        whole = media.mux(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(texts[r["doc_id"]]), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-64:]), len(whole), hashlib.sha256(whole).hexdigest())
        x = [b - 128 for b in payload]
        packets = int(packets_of(whole))
        assert r["feature"].split()[3] == f"packets={packets}" and r["feature"].endswith(f"peak={max(map(abs, x))}")
    rows = {r["doc_id"]: r for r in media.media_digest(edge).collect()}
    assert rows[2]["payload_sha256"] == hashlib.sha256(bytes(64)).hexdigest() and rows[2]["n_bytes"] == 0
    assert media.media_digest(empty).count() == 0


# 6 near duplicates


def brute_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute_components(ids, sets, percent=85):
    least = {i: i for i in ids}
    for a in range(len(ids)):
        for b in range(a):
            u = len(sets[a] | sets[b])
            if u and 100 * len(sets[a] & sets[b]) >= percent * u:
                x, y = least[ids[a]], least[ids[b]]
                for k, v in least.items():
                    if v == max(x, y):
                        least[k] = min(x, y)
    return least


def near_texts(seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(150)]
    texts = [" ".join(base)] * 3
    for k in range(60):
        x = list(base)
        for _ in range(k % 6):
            x[rng.randrange(len(x))] = word()
        texts.append(" ".join(x))
    short = [word() for _ in range(9)]
    return texts + [" ".join(short), " ".join(short).upper(), " ".join(short[:-1]), "a b c", "A B  c", "a b", "", " \n", *(" ".join(word() for _ in range(40)) for _ in range(10))]


def test_cells_emit_spanning_links_only():
    """Many documents just under the bound leave no pair; linked ones leave one link a member less at most, however many pairs there are."""
    import pyarrow as pa

    rng = np.random.default_rng(0)
    common = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    for own, links in ((50, 0), (40, 119)):  # similarities of 0.833 and 0.862
        sets = [np.sort(np.r_[common, rng.integers(0, 1 << 63, own).astype(np.uint64)]) for _ in range(120)]
        keys = hmh.band_keys(hmh.registers(np.arange(121) * (500 + own), np.concatenate(sets)))
        found = []
        for band in np.unique(keys):
            at = np.nonzero((keys == band).any(1))[0]
            cell = pa.table({"band": [int(band)] * len(at), "id": at, "component": at, "block": [0] * len(at), "hashes": [sets[i].tobytes() for i in at]})
            found += [len(near_dedup._across(cell, 85, 4.0))]
            assert found[-1] < len(at)
        assert (sum(found) == 0) if not links else sum(found) >= links


@pytest.mark.parametrize("block", [1500, 8])
def test_near_duplicates_brute_force(spark, block):
    texts = near_texts()
    df = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    ids, sets = [i * 3 for i in range(len(texts))], brute_sets(texts)
    want = brute_components(ids, sets)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(df, block=block).collect()}
    for i, s in zip(ids, sets):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(s), want[i], want[i] == i)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_near_duplicates_of_repeated_ids(spark, seed):
    """Rows of one id are one node: the links of each of its texts are its own."""
    a, b = (" ".join(f"{x}{k}" for k in range(9)) for x in "ab")
    rows = [(3, a), (5, a), (5, b), (7, b), (5, ""), (8, None)]
    if seed:
        rng = random.Random(seed)
        rows = [(rng.randrange(25), t) for t in near_texts(seed)[::2]]
    ids, sets = [i for i, _ in rows], brute_sets([t for _, t in rows])
    least = brute_components(ids, sets)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect())
    assert got == sorted((i, len(s), least[i], least[i] == i) for i, s in zip(ids, sets))
    if not seed:
        assert {r[2] for r in got if r[0] in (3, 5, 7)} == {3}


def test_estimate_follows_similarity():
    rng = random.Random(0)
    a = [str(rng.random()) for _ in range(2000)]
    b = a[:1700] + [str(rng.random()) for _ in range(300)]
    offsets, hashes = hmh.shingle_sets([" ".join(x).encode() for x in (a, b)])
    x, y = hashes[offsets[0] : offsets[1]], hashes[offsets[1] : offsets[2]]
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    r = hmh.registers(offsets, hashes)
    n = np.diff(offsets).astype(float)
    j, error = hmh.estimate(r[:1], r[1:], n[:1], n[1:])
    assert abs(j[0] - true) < 4 * error[0] and np.array_equal(hmh.unpacked(hmh.packed(r)), r)


def test_near_edges(edge, empty):
    rows = near_dedup.near_duplicates(edge).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(EDGE) and got[5]["component_id"] == 1 and not got[5]["kept"]
    assert got[None]["kept"] and got[None]["component_id"] is None
    assert all(got[i]["n_shingles"] == 0 and got[i]["kept"] and got[i]["component_id"] == i for i in (2, 3, 8))
    assert near_dedup.near_duplicates(empty).count() == 0


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    least = {x: x for p in pairs for x in p}
    for _ in range(400):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: v for k, v in least.items() if k in got} and {k for k, v in least.items() if v != k} <= got.keys()


# 7 byte-level BPE


def test_byte_bpe(spark, edge, empty):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    e = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = byte_bpe.encode_documents(edge, RANKS, PATTERN, block_bytes=500)
    texts = {i: t or "" for i, t in EDGE}
    rows = out.collect()
    assert len(rows) == len(EDGE)
    for r in rows:
        ids = e.encode_ordinary(texts[r["doc_id"]])
        assert (r["token_ids"], r["n_tokens"]) == (ids, len(ids))
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    decoded = {r["doc_id"]: bytes(r["decoded"]) for r in byte_bpe.decode_documents(out, RANKS).collect()}
    assert decoded == {i: t.encode() for i, t in texts.items()}
    assert byte_bpe.encode_documents(empty, RANKS, PATTERN).count() == 0


def test_words_are_encoded_once(spark, tmp_path, monkeypatch):
    """Whatever the number of blocks and of tasks, each distinct word of the corpus reaches the encoder once."""
    rng = random.Random(8)
    words = ["w" + str(k) for k in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    log = str(tmp_path)

    def counting(ranks, pattern):
        import os
        import uuid

        def encode(w):
            with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
                f.write(w)
            return [0]

        return encode

    monkeypatch.setattr(byte_bpe, "piece_encoder", counting)
    blocks = common.checkpoint(byte_bpe.blocks_of(docs, PATTERN, block_bytes=300))
    assert blocks.count() > 20
    coded = byte_bpe.encode_words(blocks, b"", PATTERN, 70).collect()
    seen = Counter((tmp_path / f).read_text() for f in __import__("os").listdir(log))
    assert seen == Counter({w.decode() for b in blocks.collect() for w in byte_bpe._words_of(bytes(b["words"]))[1]})
    assert sum(len(byte_bpe._unpack(bytes(r["coded"]))[0]) for r in coded) == blocks.agg({"n_words": "sum"}).first()[0]


def test_rank_packing():
    x = np.random.default_rng(0).zipf(1.2, 5000).clip(0, 10**7).astype(np.uint32)
    assert np.array_equal(byte_bpe._unpack_ranks(byte_bpe._pack_ranks(x)), x)
    assert [a.tolist() for a in byte_bpe._unpack(byte_bpe._pack(x, x[:0], x[:3]))] == [x.tolist(), [], x[:3].tolist()]


# 8 decontamination


def test_fm_index():
    rng = np.random.default_rng(1)
    for n, kinds in ((1, 2), (2, 2), (60, 2), (400, 5), (400, 300)):
        t = rng.integers(1, kinds + 1, n)
        index = FMIndex(t, 4)
        for k in (1, 2, 3):
            patterns = np.array([t[i : i + k] for i in range(0, n - k + 1, 5)] + [rng.integers(1, kinds + 3, k) for _ in range(4)])
            for p, a, b in zip(patterns, *index.search(patterns)):
                assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(n - k + 1) if (t[i : i + k] == p).all()]


def brute_hits(texts, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = {}
    for item, t in items:
        w = split(t)
        k = min(13, len(w))
        for i in range(len(w) - k + 1) if k else ():
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    out = []
    for t in texts:
        w = split(t)
        hit, found = set(), set()
        for i in range(len(w)):
            for k in {len(x) for x in windows}:
                if tuple(w[i : i + k]) in windows and i + k <= len(w):
                    hit |= set(range(i, i + k))
                    found |= windows[tuple(w[i : i + k])]
        out.append((len(w), len(hit), len(found), decontamination.item_digest(list(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block_bytes", [4 << 20, 200])
def test_decontamination_brute_force(spark, block_bytes):
    rng = random.Random(3)
    words = ["alpha", "Beta", "g1", "élan", "x"]
    text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice([3, 12, 13, 14, 30]))) for i in range(12)] + [(12, None), (13, "..."), (3, text(20))]
    texts = [text(rng.randrange(60)) for _ in range(30)] + [items[4][1] + " tail " + items[4][1], None, "", "!!", items[0][1].upper()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = decontamination.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    rows = {r["doc_id"]: r for r in decontamination.digest(found).collect()}
    want = brute_hits(texts, items)
    for i, w in enumerate(want):
        r = rows[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == w
    for r in found.collect():
        raw = (texts[r["doc_id"]] or "").encode()
        assert sum(len(decontamination.words_of(raw[s["start"] : s["end"]])) for s in r["byte_spans"]) == r["n_hit"]


def test_decontamination_edges(spark, edge, empty):
    bench = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    rows = decontamination.digest(decontamination.decontaminate(edge, bench)).collect()
    assert sorted(r["n_items"] for r in rows) == [0] * 7 + [1] * 3
    assert decontamination.decontaminate(empty, bench).count() == 0
    assert decontamination.decontaminate(edge, bench.limit(0)).where("n_hit > 0").count() == 0


# 10 line dedup


def brute_lines(rows):
    """rows (id, text) of distinct ids, ascending; the texts that are left."""
    first = {}
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if line.strip(" "):
                first.setdefault(line, (i, k))

    def close(a, b):
        a, b = sorted((a.split(" "), b.split(" ")), key=len)
        if len(a) < 5 or len(b) - len(a) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {x for x in first if any(first[y] < first[x] and close(x, y) for y in first)}
    out = {}
    for i, t in rows:
        if t is not None:
            out[i] = "\n".join(x for k, x in enumerate(t.split("\n")) if not x.strip(" ") or (first[x] == (i, k) and x not in near))
    return out


def test_line_dedup_brute_force(spark):
    rng = random.Random(4)
    pool = []
    for n in (3, 5, 6, 7, 8, 9, 15, 16, 17, 33):
        base = [rng.choice("abcd") + str(rng.randrange(3)) for _ in range(n)]
        for _ in range(7):
            x = list(base)
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(x))
                x[k : k + 1] = rng.choice([[], ["zz"], [x[k], x[k]], ["q" + str(rng.randrange(3))]])
            pool.append(" ".join(x))
    rows = [(i, "\n".join(rng.choice([*pool, "", "  "]) for _ in range(rng.randrange(6)))) for i in range(60)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_long_lines(spark):
    """Edits of lines about the length from which keys are running sums, of equal words in a row, and of a very long line."""
    k = line_dedup.LONG
    base = [f"u{i}" for i in range(k + 2)]
    lines = []
    for n in (k - 2, k - 1, k, k + 1):
        own = [f"{n}-{w}" for w in base[:n]]
        lines += [own, own[:7] + own[8:], [*own[:-1], "other"], ["more", *own], [*own[: n // 2], "x", "y", *own[n // 2 :]], own[::-1], ["far", *own[1:-1], "away"]]
    lines += [["same"] * k, ["same"] * (k + 1), ["same"] * (k + 3), ["same"] * (k - 1), ["same"] * 100 + ["odd"] + ["same"] * k]
    lines += [[f"v{i}" for i in range(60_000)], [f"v{i}" for i in range(60_000) if i != 33_333]]

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return any(a[head + x :] == b[head + y :] for x, y in ((1, 1), (0, 1), (1, 0)))

    want = {i for i, b in enumerate(lines) if not any(near(a, b) for a in lines[:i])}
    got = line_dedup.dedup_lines(spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"] for r in got if r["text"]} == want and len(want) < len(lines) - 8


def test_line_dedup_edges(edge, empty):
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(edge)
    named = edge.withColumnsRenamed({"h1": "__id", "h2": "__mark", "k": "__removed"})
    rows = line_dedup.dedup_lines(named, removed_col="gone")
    assert rows.columns == [*named.columns, "gone"] and rows.count() == len(EDGE)
    assert all(r["removed_lines"] == CLASH.index("removed_lines") and r["__id"] == CLASH.index("h1") for r in rows.collect())
    rows = line_dedup.dedup_lines(edge.drop("removed_lines"))
    got = {r["doc_id"]: r for r in rows.collect()}
    assert got[5]["text"] == "" and got[5]["removed_lines"] == [0, 1] and got[1]["removed_lines"] == [] and got[2]["text"] is None
    assert got[8]["text"] == "  \n\n " and got[4]["text"] == LONG
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_is_native(edge):
    plan = line_dedup.dedup_lines(edge.drop("removed_lines"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_quality_fit_is_not_cut():
    """The voters and the least share of a term that the operator was described with."""
    from quillon.llm import quality

    assert quality.FIT_ROWS == 3000 and quality.LEAST_SHARE == 0.01
    assert quality.shape("aB" * 9 + "!" * 20) != quality.shape("aB" * 9 + "!" * 21)
    assert quality.quality_terms("\0many")[0] == "w\0many"  # what a text holds is a word, whatever it begins with
    assert quality.repeat_marks("a a b".split()) == ["r2"] and quality.repeat_marks(["a", "b"]) == quality.repeat_marks([]) == []
