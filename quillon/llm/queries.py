"""The registered queries of this subpackage; each applies its operator to whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import byte_bpe, decontamination, filter_audit, language, line_dedup, media, merkle, near_dedup, quality, simhash_dedup, suffix_dedup, token_files, toxicity
from quillon.llm.common import id_bucket, table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_bucket("doc_id", 4) == 2
    vocabulary = language.sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    model = language.fit(docs.where(~held_out), vocabulary)
    return language.predict(docs.withColumn("held_out", held_out), model, keep=("held_out",))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.predict(docs.withColumn("held_out", id_bucket("doc_id", 5) == 0), model, keep=("held_out",))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontamination.digest(found)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.predict(docs.withColumn("held_out", id_bucket("doc_id", 5) == 0), model, keep=("held_out",))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n")))
    n_removed = F.size("removed_lines").cast("long")
    return out.select("doc_id", lines.cast("long").alias("n_lines"), n_removed.alias("n_removed"), F.array_join("removed_lines", ",").alias("removed_lines"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in merkle.FIELDS]
    tampered = F.when((id_bucket("doc_id", 7) == 0) & F.col("doc_id").isNotNull(), merkle.row_hash(fields))
    found = merkle.manifest(docs, changed=tampered).withColumn("folded_root", merkle.folded(F.col("changed"), F.col("proof")))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.siblings_hash(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_token_files": op4_token_files,
    "op5_media": op5_media,
    "op6_near_dedup": op6_near_dedup,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_decontamination": op8_decontamination,
    "op9_quality": op9_quality,
    "op10_line_dedup": op10_line_dedup,
    "op11_simhash_dedup": op11_simhash_dedup,
    "op12_filter_audit": op12_filter_audit,
    "op13_merkle": op13_merkle,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL: dict[str, str] = {
    "op6_near_dedup": rf"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, CAST(len(w) AS BIGINT) - 3)] END) AS s FROM docs),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sets x JOIN sets y USING (s) WHERE x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, root) AS (SELECT doc_id, doc_id FROM docs UNION SELECT b, root FROM reach JOIN ways ON a = node WHERE root < b),
least AS (SELECT node AS doc_id, min(root) AS component_id FROM reach GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM docs LEFT JOIN sizes USING (doc_id) JOIN least USING (doc_id)
""",
    "op8_decontamination": rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bench AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT item, w, k, unnest(range(1, CAST(len(w) AS BIGINT) - k + 2)) AS i FROM (SELECT *, least(13, CAST(len(w) AS BIGINT)) AS k FROM bench WHERE len(w) > 0))),
grams AS (
  SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT rid, w, k, unnest(range(1, CAST(len(w) AS BIGINT) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows))),
hits AS (SELECT rid, i, k, item FROM grams JOIN windows USING (k, s)),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)
""",
    "op10_line_dedup": """
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, text, string_split(text, chr(10)) AS l FROM documents),
lines AS (SELECT rid, doc_id, i - 1 AS pos, l[i] AS line FROM (SELECT rid, doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM docs) WHERE trim(l[i], ' ') <> ''),
firsts AS (SELECT line, min(row(doc_id, pos)) AS first, string_split(line, ' ') AS w FROM lines GROUP BY line),
keys AS (
  SELECT line, first, -1 AS i, line AS v FROM firsts WHERE len(w) >= 5
  UNION ALL
  SELECT line, first, i, array_to_string(list_concat(w[1:i], w[i + 2:]), ' ') AS v FROM (SELECT *, unnest(range(0, len(w))) AS i FROM firsts WHERE len(w) >= 5)),
near AS (SELECT DISTINCT a.line FROM keys a JOIN keys b ON a.v = b.v AND b.first < a.first AND (a.i = b.i OR a.i = -1 OR b.i = -1)),
gone AS (
  SELECT rid, array_agg(pos ORDER BY pos) AS removed FROM lines JOIN firsts USING (line)
  WHERE row(doc_id, pos) > first OR line IN (SELECT line FROM near) GROUP BY rid),
kept AS (
  SELECT doc_id, coalesce(removed, []) AS removed,
         CASE WHEN removed IS NULL THEN text ELSE array_to_string([l[i] FOR i IN range(1, len(l) + 1) IF NOT list_contains(removed, i - 1)], chr(10)) END AS kept
  FROM docs LEFT JOIN gone USING (rid))
SELECT doc_id, CASE WHEN kept IS NULL THEN 0 ELSE len(string_split(kept, chr(10))) END AS n_lines, CAST(len(removed) AS BIGINT) AS n_removed,
       array_to_string(removed, ',') AS removed_lines, sha256(coalesce(kept, '')) AS kept_sha256
FROM kept
""",
    "op12_filter_audit": r"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
known AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
fails AS (
  SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM docs),
counts AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (coalesce(good, false)) AS g, count(*) FILTER (coalesce(toxic, false)) AS x FROM fails LEFT JOIN known USING (doc_id) GROUP BY part, mask),
filters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(f, b)),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM filters a JOIN filters b ON b.b <> a.b JOIN filters c ON c.b NOT IN (a.b, b.b) JOIN filters d ON d.b NOT IN (a.b, b.b, c.b) JOIN filters e ON e.b NOT IN (a.b, b.b, c.b, d.b)),
steps AS (
  SELECT filter_order, step, bits[step] AS own, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before FROM (SELECT *, unnest(range(1, 6)) AS step FROM orders)),
rows_ AS (
  SELECT part, filter_order, step, own,
         CAST(coalesce(sum(n) FILTER (mask & (own + before) = 0), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before = 0), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before <> 0), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (mask = own), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(g) FILTER (mask & own <> 0 AND mask & before = 0), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(x) FILTER (mask & own <> 0 AND mask & before = 0), 0) AS BIGINT) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM rows_
""",
    "op13_merkle": """
WITH RECURSIVE crc AS (SELECT list(c ORDER BY b) AS tab FROM (SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(b))),
texts AS (
  SELECT row_number() OVER () AS rid, doc_id, CAST(doc_id AS VARCHAR) AS d, source AS s, lang AS l, CAST(n_chars AS VARCHAR) AS c, CAST(n_chars + 1 AS VARCHAR) AS c1, text AS t FROM documents),
hashed AS (
  SELECT rid, doc_id, coalesce('1' || l, '0') AS g, d,
         sha256(concat(coalesce(strlen(d) || ':' || d, '-'), coalesce(strlen(s) || ':' || s, '-'), coalesce(strlen(l) || ':' || l, '-'), coalesce(strlen(c) || ':' || c, '-'), coalesce(strlen(t) || ':' || t, '-'))) AS leaf,
         sha256(concat(coalesce(strlen(d) || ':' || d, '-'), coalesce(strlen(s) || ':' || s, '-'), coalesce(strlen(l) || ':' || l, '-'), coalesce(strlen(c1) || ':' || c1, '-'), coalesce(strlen(t) || ':' || t, '-'))) AS other
  FROM texts),
placed AS (
  SELECT rid, doc_id, g, leaf, CASE WHEN doc_id IS NOT NULL AND xor(list_reduce(list_prepend(4294967295, [CAST(ascii(d[j]) AS BIGINT) FOR j IN range(1, len(d) + 1)]), lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295) % 7 = 0 THEN other ELSE leaf END AS changed,
         row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n
  FROM hashed, crc),
nodes(g, k, i, h, n) AS (
  SELECT g, 0, i, leaf, n FROM placed UNION ALL SELECT g, k + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY g, k, n, i // 2),
subs AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS gi, count(*) OVER () AS gn FROM nodes WHERE n = 1),
tops(k, i, h, n) AS (
  SELECT 0, gi, subroot, gn FROM subs UNION ALL SELECT k + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY k, n, i // 2),
climb(rid, g, k, i, h, p, n) AS (
  SELECT rid, g, 0, i, changed, '', n FROM placed
  UNION ALL
  SELECT f.rid, f.g, f.k + 1, f.i // 2, sha256(CASE WHEN f.i % 2 = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END), f.p || coalesce(s.h, ''), (f.n + 1) // 2
  FROM climb f LEFT JOIN nodes s ON s.g = f.g AND s.k = f.k AND s.i = xor(f.i, 1) WHERE f.n > 1),
last(rid, k, i, h, p, n) AS (
  SELECT rid, 0, gi, h, p, gn FROM climb JOIN subs USING (g) WHERE n = 1
  UNION ALL
  SELECT f.rid, f.k + 1, f.i // 2, sha256(CASE WHEN f.i % 2 = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END), f.p || coalesce(s.h, ''), (f.n + 1) // 2
  FROM last f LEFT JOIN tops s ON s.k = f.k AND s.i = xor(f.i, 1) WHERE f.n > 1)
SELECT doc_id, leaf, subroot, t.h AS root, sha256(last.p) AS proof_sha256, last.h AS folded_root, last.h = t.h AS verified
FROM placed JOIN subs USING (g) JOIN last USING (rid), tops t WHERE last.n = 1 AND t.n = 1
""",
}
