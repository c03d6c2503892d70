"""The registered queries over the driver's tables, and the same in DuckDB's SQL.

Tables stand in for the engine's own: documents and pages for declarations and their texts, orders and lineitem for
dependency lists, embeddings for vectors, labels for what has been enriched before. Floats are rounded to 6 places.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.functions import scoring, text, udfs
from quillon.functions import vectors as V
from quillon.operators import enrich, graph, ingest, lexical, ranking, semantic
from quillon.operators.storage import checkpoint_root, kept_path, stored
from quillon.plans import extract
from quillon.plans.search import SearchEngine
from quillon.schema import DECLARATION
from quillon.sources import files
from quillon.streaming import rates, resumable, trailing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c):
    return F.round(c, 6)


def _declared(rows: DataFrame, **columns) -> DataFrame:
    """The table as declarations: columns are names or Columns, others null."""
    of = {k: F.col(v) if isinstance(v, str) else v for k, v in columns.items()}
    return rows.select(*(of.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in DECLARATION))


# scans, lookups, worklists


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def scan_project(spark, d):
    return read(spark, d, "documents").join(read(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "lang", "source")


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 42")
def lookup_by_id(spark, d):
    rows = _declared(read(spark, d, "documents"), id="doc_id", module="lang", name="source", docstring="n_chars")
    return SearchEngine(rows).get_by_id([42]).select(F.col("id").alias("doc_id"), F.col("module").alias("lang"), F.col("name").alias("source"), F.col("docstring").alias("n_chars"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_name = 'Customer#000000007'")
def lookup_by_name(spark, d):
    rows = _declared(read(spark, d, "customer"), id="c_custkey", name="c_name", docstring="c_acctbal")
    return SearchEngine(rows).get_by_name("Customer#000000007").select(F.col("id").alias("c_custkey"), F.col("name").alias("c_name"), F.col("docstring").alias("c_acctbal"))


@query("SELECT page_id AS id, url AS name, html AS field FROM pages WHERE page_id = 3")
def field_getter(spark, d):
    return SearchEngine(_declared(read(spark, d, "pages"), id="page_id", name="url", source_text="html")).get_field(3, "source_text")


@query("SELECT doc_id, n_chars FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL")
def worklist_null(spark, d):
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    return enrich.worklist(rows, "quality", id_col="doc_id").select("doc_id", "n_chars")


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE text IS NOT NULL AND text <> '' AND quality IS NULL")
def embed_worklist(spark, d):
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    return enrich.to_embed(enrich.worklist(rows, "quality", "text", id_col="doc_id"), "text", "quality").select("doc_id")


@query("SELECT source, count(*) AS n FROM documents WHERE split_part(source || '.x', '.', 1) IN ('src1', 'src3') GROUP BY source")
def package_filter(spark, d):
    rows = read(spark, d, "documents").withColumn("module", F.concat("source", F.lit(".x")))
    return ranking.in_packages(rows, ["src1", "src3"]).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


_MODULES = "replace(p_name, ' ', '.') || '.' || p_type || '.' || p_brand"


@query(f"""
WITH m AS (SELECT p_partkey, p_size, replace(p_name, ' ', '.') AS name, {_MODULES} AS m FROM part),
p AS (SELECT DISTINCT m AS prefix FROM m WHERE p_size = 50 UNION SELECT DISTINCT name FROM m WHERE p_size = 1 UNION SELECT min(split_part(name, '.', 1)) FROM m)
SELECT p_partkey, m FROM m WHERE EXISTS (SELECT 1 FROM p WHERE m = prefix OR starts_with(m, prefix || '.'))""")
def prefix_join(spark, d):
    """Modules below any of a table of prefixes: whole modules, names of two parts, and one of a single part."""
    rows = read(spark, d, "part").select("p_partkey", "p_size", F.replace("p_name", F.lit(" "), F.lit(".")).alias("name"), F.expr(_MODULES).alias("m"))
    firsts = rows.agg(F.min(F.split_part("name", F.lit("."), F.lit(1))).alias("prefix"))
    prefixes = rows.where("p_size = 50").select(F.col("m").alias("prefix")).unionByName(rows.where("p_size = 1").select(F.col("name").alias("prefix"))).unionByName(firsts)
    return ingest.with_prefixes(rows, prefixes, "m").select("p_partkey", "m")


@query("SELECT p_partkey FROM part WHERE NOT suffix(CASE WHEN p_size % 7 = 0 THEN p_name || '.mk' ELSE p_name END, '.mk')")
def suffix_filter(spark, d):
    name = F.when(F.col("p_size") % 7 == 0, F.concat("p_name", F.lit(".mk"))).otherwise(F.col("p_name"))
    return read(spark, d, "part").where(~text.is_autogenerated(name)).select("p_partkey")


@query("""
WITH n AS (SELECT l_orderkey AS module_name, l_linenumber AS position, l_partkey AS part, CAST(l_quantity > 10 AS INT) AS render FROM lineitem),
r AS (SELECT l_orderkey AS module_name, l_linenumber AS position, min(l_suppkey) AS start_line, max(l_suppkey) AS end_line FROM lineitem GROUP BY ALL),
md AS (SELECT module_name, position, start_line || 'm' AS docstring FROM r WHERE start_line % 3 = 0),
vs AS (SELECT module_name, position, start_line || 'v' AS verso_docstring FROM r WHERE start_line % 3 = 1)
SELECT module_name, position, part, start_line, end_line, docstring, verso_docstring, o_orderpriority AS source_url
FROM n JOIN r USING (module_name, position) LEFT JOIN md USING (module_name, position) LEFT JOIN vs USING (module_name, position) JOIN orders ON o_orderkey = module_name
WHERE render = 1""")
def docgen_join(spark, d):
    lines = read(spark, d, "lineitem")
    names = lines.selectExpr("l_orderkey AS module_name", "l_linenumber AS position", "l_partkey AS part", "int(l_quantity > 10) AS render")
    ranges = lines.groupBy(F.col("l_orderkey").alias("module_name"), F.col("l_linenumber").alias("position")).agg(F.min("l_suppkey").alias("start_line"), F.max("l_suppkey").alias("end_line"))
    markdown = ranges.where("start_line % 3 = 0").selectExpr("module_name", "position", "concat(start_line, 'm') AS text")
    verso = ranges.where("start_line % 3 = 1").selectExpr("module_name", "position", "concat(start_line, 'v') AS content")
    modules = read(spark, d, "orders").selectExpr("o_orderkey AS name", "o_orderpriority AS source_url")
    return ingest.join_tables(names, ranges, markdown, verso, modules).drop("render")


# tokens and lexical search

_W = r"[\p{L}\p{N}_]+"
_SPACED = rf"regexp_extract_all(lower(regexp_replace(translate(%s, '._', '  '), '([a-z])([A-Z])', '\1 \2', 'g')), '{_W}')"
_WORDS = rf"regexp_extract_all(lower(%s), '{_W}')"


@query(f"SELECT page_id, array_to_string({_SPACED % 'url'}, ' ') AS tokens FROM pages")
def tokenize_spaced(spark, d):
    return read(spark, d, "pages").select("page_id", F.array_join(text.tokenize_spaced(F.col("url")), " ").alias("tokens"))


@query("SELECT page_id, lower(url) AS token, CAST(1 AS BIGINT) AS n FROM pages WHERE url <> ''")
def tokenize_raw(spark, d):
    tokens = text.tokenize_raw(F.col("url"))
    return read(spark, d, "pages").select("page_id", tokens[0].alias("token"), F.size(tokens).cast("long").alias("n"))


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(t, ' ')) AS tokens FROM (SELECT doc_id, {_WORDS % 'text'} AS t FROM documents)")
def tokenize_words(spark, d):
    rows = read(spark, d, "documents").select("doc_id", text.tokenize_words(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens"))


def _bm25_sql(rows: str, asked: list[str]) -> str:
    """CTEs ending in bm25(id, score); rows: SELECT id, tokens."""
    return f"""
rows AS ({rows}),
corpus AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM rows),
postings AS (SELECT term, id, dl, count(*) AS tf FROM (SELECT id, len(tokens) AS dl, unnest(tokens) AS term FROM rows) GROUP BY ALL),
asked AS (SELECT term, count(*) AS qf FROM (VALUES {', '.join(f"('{t}')" for t in asked)}) v(term) GROUP BY term),
known AS (SELECT term, qf * ln((n + 1) / df) AS idf, avgdl FROM asked JOIN (SELECT term, count(*) AS df FROM postings GROUP BY term) USING (term), corpus),
bm25 AS (SELECT id, sum(idf * 2.5 * tf / (1.5 * (1 - 0.75 + 0.75 * dl / avgdl) + tf)) + (SELECT 0.5 * sum(idf) FROM known) AS score FROM postings JOIN known USING (term) GROUP BY id)"""


_TERMS = ["the", "thea", "onre", "inged"]


def _text_index(spark, d) -> lexical.LexicalIndex:
    """The documents' index: built and saved by the first query of a session that asks for it, then read, sorted by term."""
    docs = read(spark, d, "documents")
    return lexical.LexicalIndex.load(spark, kept_path("documents by words", docs, lambda p: lexical.build_index(docs, text.tokenize_words(F.col("text")), "doc_id").save(p)))


@query(f"WITH {_bm25_sql(f'SELECT doc_id AS id, {_WORDS % "text"} AS tokens FROM documents', _TERMS)} SELECT id, rank, round(score, 6) AS score FROM (SELECT id, score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM bm25) WHERE rank <= 100")
def bm25_text(spark, d):
    asked = spark.createDataFrame([(0, _TERMS)], "query_id long, tokens array<string>")
    scores = lexical.score_matches(asked, _text_index(spark, d)).withColumn("score", F.round("score", 9))
    return lexical.top_k(scores, 100).select("id", F.col("rank").cast("long").alias("rank"), r6("score").alias("score"))


@query(f"""
WITH {_bm25_sql(f'SELECT page_id AS id, list_distinct({_SPACED % "url"}) AS tokens FROM pages', ['http', 'example', 'fr', 'page'])},
spaced AS (SELECT id, score FROM (SELECT id, score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM bm25) WHERE rank <= 200)
SELECT id, round(greatest(score, 0), 6) AS score FROM spaced""")
def bm25_names(spark, d):
    pages = read(spark, d, "pages")
    spaced, raw = (lexical.build_index(pages, f(F.col("url")), "page_id", distinct=True) for f in (text.tokenize_spaced, text.tokenize_raw))
    asked = spark.createDataFrame([(0, "http.example.fr page")], "query_id long, query string")
    tokens = asked.select("query_id", text.tokenize_spaced(F.col("query")).alias("spaced_tokens"), text.tokenize_raw(F.col("query")).alias("raw_tokens"))
    rounded = lexical.score_matches(tokens.select("query_id", F.col("spaced_tokens").alias("tokens")), spaced).withColumn("score", F.round("score", 9))
    named = lexical.top_k(lexical.score_matches(tokens.select("query_id", F.col("raw_tokens").alias("tokens")), raw), 200)
    return lexical.best_of(lexical.top_k(rounded, 200), named).select("id", r6("score").alias("score"))


# vectors

_DOT = "list_sum([CAST(a[i] AS DOUBLE) * b[i] FOR i IN range(1, len(a) + 1)])"
_KNN = f"""
q AS (SELECT [x / sqrt(list_sum([CAST(y AS DOUBLE) * y FOR y IN embedding])) FOR x IN embedding] AS b FROM embeddings WHERE vec_id = 7),
dots AS (SELECT vec_id AS id, {_DOT} AS score FROM (SELECT vec_id, embedding AS a, b FROM embeddings, q))"""


def _vector_query(spark, d):
    return read(spark, d, "embeddings").where("vec_id = 7").select(F.lit(0).cast("long").alias("query_id"), "embedding")


def _vectors(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


@query(f"WITH {_KNN} SELECT id, rank, round(score, 6) AS score FROM (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM dots) WHERE rank <= 100")
def knn_exact(spark, d):
    return semantic.exact_top_k(_vector_query(spark, d), _vectors(spark, d), 100).select("id", F.col("rank").cast("long").alias("rank"), r6("score").alias("score"))


@query()
def knn_ivf_recall(spark, d):
    """The share of the exact 20 and 100 nearest that the default lists and probes give, over every id divisible by 20."""
    vectors = _vectors(spark, d)
    asked = vectors.where("id % 20 = 0").select(F.col("id").cast("long").alias("query_id"), "embedding")
    index = semantic.build_lists(vectors)
    index.vectors = stored(index.vectors)
    near = semantic.probed_top_k(asked, index, 100).select("query_id", "id", F.col("rank").alias("found"))
    met = semantic.exact_top_k(asked, vectors, 100).join(near, ["query_id", "id"], "left")
    hit = lambda k: F.avg(F.when(F.col("rank") <= k, F.coalesce((F.col("found") <= k).cast("int"), F.lit(0))))
    return met.agg(F.count_distinct("query_id").alias("queries"), hit(20).alias("recall"), hit(100).alias("recall_100"))


@query("SELECT vec_id, round(sqrt(list_sum([CAST(x AS DOUBLE) * x FOR x IN embedding])), 6) AS norm FROM embeddings")
def vector_codec(spark, d):
    rows = read(spark, d, "embeddings").withColumn("embedding", V.unpack_floats(V.pack_floats("embedding")))
    return rows.select("vec_id", r6(V.norm(F.col("embedding"))).alias("norm"))


# ranking

_SIDES = f"""
WITH {_bm25_sql(f'SELECT doc_id AS id, {_WORDS % "text"} AS tokens FROM documents', _TERMS)}, {_KNN},
l AS (SELECT id, rank FROM (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM bm25) WHERE rank <= 100),
r AS (SELECT id, row_number() OVER (ORDER BY greatest(score, 0) DESC, id) AS rank FROM (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS k FROM dots) WHERE k <= 100),
fused AS (SELECT id, 1 / coalesce(l.rank, (SELECT count(*) FROM l) + 1) + 1 / coalesce(r.rank, (SELECT count(*) FROM r) + 1) AS fused FROM l FULL JOIN r USING (id)),
ranked AS (SELECT id, fused, row_number() OVER (ORDER BY fused DESC, id) AS fused_rank FROM fused)"""


def _fused(spark, d):
    index = _text_index(spark, d)
    asked = spark.createDataFrame([(0, _TERMS)], "query_id long, tokens array<string>")
    left = lexical.top_k(lexical.score_matches(asked, index).withColumn("score", F.round("score", 9)), 100)
    right = semantic.exact_top_k(_vector_query(spark, d), _vectors(spark, d), 100)
    return ranking.fuse(left, lexical.best_of(right))


@query(f"{_SIDES} SELECT id, fused_rank, round(fused, 6) AS fused FROM ranked")
def rrf_fuse(spark, d):
    return _fused(spark, d).select("id", F.col("fused_rank").cast("long").alias("fused_rank"), r6("fused").alias("fused"))


@query(f"{_SIDES} SELECT doc_id, lang, source, rank AS position FROM (SELECT doc_id, lang, source, row_number() OVER (ORDER BY fused_rank) AS rank FROM ranked JOIN documents ON id = doc_id) WHERE rank <= 10")
def hybrid_search(spark, d):
    """The flagship: lexical and semantic candidates, fused, joined to their documents; the ten best."""
    met = _fused(spark, d).join(read(spark, d, "documents").select(F.col("doc_id").alias("id"), "doc_id", "lang", "source"), "id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("fused_rank"))
    return met.withColumn("position", place.cast("long")).where("position <= 10").select("doc_id", "lang", "source", "position")


_POOL = """
WITH pool AS (SELECT o_orderkey AS id, o_orderkey % 500 AS name FROM orders),
deps AS (SELECT l_orderkey AS id, l_partkey % 500 AS dep FROM lineitem),
named AS (SELECT dep AS name, count(*) AS n FROM deps JOIN pool USING (id) GROUP BY dep),
counts AS (SELECT name, coalesce(n, 0) AS n FROM (SELECT DISTINCT name FROM pool) LEFT JOIN named USING (name))"""


def _pool(spark, d):
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 500).cast("string").alias("name"))
    deps = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list((F.col("l_partkey") % 500).cast("string"))).alias("dependencies"))
    return orders.join(deps, "id", "left")


@query(f"{_POOL} SELECT CAST(name AS VARCHAR) AS name, n AS dependents FROM counts")
def dependents_count(spark, d):
    return ranking.dependents(_pool(spark, d).withColumn("query_id", F.lit(0))).select("name", "dependents")


@query(f"""{_POOL},
fused AS (SELECT id, row_number() OVER (ORDER BY id % 97 DESC, id) AS fused_rank FROM pool),
p AS (SELECT id, fused_rank, name FROM fused JOIN pool USING (id) WHERE fused_rank <= 500),
named2 AS (SELECT dep AS name, count(*) AS n FROM deps JOIN p USING (id) GROUP BY dep),
c AS (SELECT id, fused_rank, coalesce(n, 0) AS n FROM p LEFT JOIN named2 USING (name)),
m AS (SELECT max(n) AS most FROM c)
SELECT id, fused_rank, n AS dependents, round(1 / fused_rank + 1 / CASE WHEN n > 0 THEN most - n + 1 WHEN most > 0 THEN most + 1 ELSE 501 END, 6) AS boosted FROM c, m""")
def dependency_boost(spark, d):
    rows = _pool(spark, d)
    fused = rows.select(F.lit(0).alias("query_id"), "id", (F.col("id") % 97).alias("fused"))
    fused = fused.withColumn("fused_rank", scoring.rank_by(F.col("fused"), "id"))
    out = ranking.boost(fused, rows, few=True)  # one query
    return out.select("id", F.col("fused_rank").cast("long").alias("fused_rank"), F.col("pool_dependents").alias("dependents"), r6("boosted").alias("boosted"))


@query("""
WITH w AS (SELECT p_partkey, p_retailprice AS s, min(p_retailprice) OVER (PARTITION BY p_brand) AS lo, max(p_retailprice) OVER (PARTITION BY p_brand) AS hi FROM part)
SELECT p_partkey, round(CASE WHEN hi - lo < 1e-9 THEN CASE WHEN hi > 1e-9 THEN 1.0 ELSE 0.0 END ELSE (s - lo) / (hi - lo) END, 6) AS score FROM w""")
def minmax_normalize(spark, d):
    return read(spark, d, "part").select("p_partkey", r6(scoring.normalized(F.col("p_retailprice"), Window.partitionBy("p_brand"))).alias("score"))


@query("""
WITH c AS (SELECT s_nationkey, s_suppkey, s_suppkey % 13 AS n FROM supplier), m AS (SELECT *, max(n) OVER (PARTITION BY s_nationkey) AS most FROM c)
SELECT s_suppkey, round(CASE WHEN most > 0 THEN ln(1 + n) / ln(1 + most) ELSE 0.0 END, 6) AS score FROM m""")
def log_normalize(spark, d):
    rows = read(spark, d, "supplier").withColumn("n", F.col("s_suppkey") % 13)
    return rows.select("s_suppkey", r6(scoring.log_normalized(F.col("n"), Window.partitionBy("s_nationkey"))).alias("score"))


_RERANK_QUERY = "the onre thea"
_EDIT = "1 - levenshtein({0}, {1}) / greatest(length({0}), length({1}))"


def edit_similarity(query, name):
    """A name similarity that DuckDB has as well; the engine's default is fuzzy_name_score."""
    return 1 - F.levenshtein(query, name) / F.greatest(F.length(query), F.length(name))


def _rerank_sql(pool: str, query: str, words: list[str]) -> str:
    """CTEs ending in reranked(q, id, final) over a pool (q, id, name, text, dep: the one dependency)."""
    flat = lambda x: f"CASE WHEN max({x}) OVER w - min({x}) OVER w < 1e-9 THEN CASE WHEN max({x}) OVER w > 1e-9 THEN 1.0 ELSE 0.0 END ELSE ({x} - min({x}) OVER w) / (max({x}) OVER w - min({x}) OVER w) END"
    asked = ", ".join(f"'{x}'" for x in words)
    return f"""
seen AS (SELECT *, {_WORDS % "CASE WHEN coalesce(text, '') <> '' THEN text ELSE name END"} AS t, {_WORDS % "name || ': ' || coalesce(text, '')"} AS shown FROM {pool}),
words AS (SELECT unnest([{asked}]) AS term),
c AS (SELECT q, count(*) AS n, avg(len(t)) AS avgdl FROM seen GROUP BY q),
tf AS (SELECT q, id, term, len(list_filter(t, lambda x: x = term)) AS tf, len(t) AS dl FROM seen, words),
df AS (SELECT q, term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY q, term),
b AS (SELECT q, id, sum(CASE WHEN df = 0 THEN 0 ELSE ln((n + 1) / df) * (0.5 + CASE WHEN tf > 0 THEN 2.5 * tf / (1.5 * (0.25 + 0.75 * dl / avgdl) + tf) ELSE 0 END) END) AS bm FROM tf JOIN df USING (q, term) JOIN c USING (q) GROUP BY q, id),
dn AS (SELECT q, dep AS name, count(*) AS dependents FROM seen GROUP BY q, dep),
s AS (SELECT q, id, bm, len(list_filter([{asked}], lambda x: list_contains(shown, x))) / {len(words)} AS pair, coalesce(dependents, 0) AS dp, {_EDIT.format(f"'{query}'", 'name')} AS fz
      FROM seen JOIN b USING (q, id) LEFT JOIN dn USING (q, name)),
reranked AS (SELECT q, id, {flat('pair')} + 0.4 * ({flat('bm')}) + 0.2 * CASE WHEN max(dp) OVER w > 0 THEN ln(1 + dp) / ln(1 + max(dp) OVER w) ELSE 0.0 END
  + CASE WHEN fz >= 0.7 THEN {flat('fz')} ELSE 0.0 END AS final FROM s WINDOW w AS (PARTITION BY q))"""


@query(f"""
WITH pool AS (SELECT lang AS q, doc_id AS id, 'onre the d' || doc_id % 40 AS name, text, 'onre the d' || doc_id * 7 % 10 AS dep FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS k FROM documents) WHERE k <= 50),
{_rerank_sql('pool', _RERANK_QUERY, ['the', 'onre', 'thea'])}
SELECT q, id, round(final, 6) AS final FROM reranked""")
def rerank_combine(spark, d):
    """Every part of the final score: pair, text, dependency and name similarity. A language's pool is its 50 shortest documents."""
    number = lambda k: F.concat(F.lit("onre the d"), k.cast("string"))
    ranked = read(spark, d, "documents").withColumn("boosted_rank", F.row_number().over(Window.partitionBy("lang").orderBy("n_chars", "doc_id"))).where("boosted_rank <= 50")
    pool = stored(ranked.select(
        F.col("lang").alias("query_id"), F.lit(_RERANK_QUERY).alias("query"), F.col("doc_id").alias("id"), number(F.col("doc_id") % 40).alias("name"),
        F.col("text").alias("informalization"), F.array(number(F.col("doc_id") * 7 % 10)).alias("dependencies"), "boosted_rank"))
    return ranking.rerank(pool, fuzzy=edit_similarity).select(F.col("query_id").alias("q"), "id", r6("final").alias("final"))


_DEPTH = 50


@query(f"""{_SIDES},
top AS (SELECT id, fused_rank, 'doc' || doc_id AS name, text FROM (SELECT * FROM ranked WHERE fused_rank <= {_DEPTH}) JOIN documents ON id = doc_id),
seen AS (SELECT id, {_WORDS % "CASE WHEN coalesce(text, '') <> '' THEN text ELSE name END"} AS t, {_WORDS % "name || ': ' || coalesce(text, '')"} AS shown FROM top),
words AS (SELECT unnest(['the', 'onre', 'thea']) AS term),
c AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM seen),
tf AS (SELECT id, term, len(list_filter(t, lambda x: x = term)) AS tf, len(t) AS dl FROM seen, words),
df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY term),
b AS (SELECT id, sum(CASE WHEN df = 0 THEN 0 ELSE ln((n + 1) / df) * (0.5 + CASE WHEN tf > 0 THEN 2.5 * tf / (1.5 * (0.25 + 0.75 * dl / avgdl) + tf) ELSE 0 END) END) AS bm FROM tf JOIN df USING (term), c GROUP BY id),
p AS (SELECT id, len(list_filter(['the', 'onre', 'thea'], lambda x: list_contains(shown, x))) / 3 AS pair FROM seen),
s AS (SELECT id, bm, pair, min(bm) OVER () AS b0, max(bm) OVER () AS b1, min(pair) OVER () AS p0, max(pair) OVER () AS p1 FROM b JOIN p USING (id))
SELECT id, fused_rank, round(CASE WHEN p1 - p0 < 1e-9 THEN CASE WHEN p1 > 1e-9 THEN 1.0 ELSE 0.0 END ELSE (pair - p0) / (p1 - p0) END
  + 0.4 * CASE WHEN b1 - b0 < 1e-9 THEN CASE WHEN b1 > 1e-9 THEN 1.0 ELSE 0.0 END ELSE (bm - b0) / (b1 - b0) END, 6) AS final FROM s JOIN ranked USING (id)""")
def rerank_fused(spark, d):
    """The rerank of what the fused ranking of all documents has on top, dependency boost between them as in the engine."""
    docs = read(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), F.col("text").alias("informalization"), F.array().cast("array<string>").alias("dependencies"))
    # the rerank reads its pool several times, and the boost its fused rows: each is made once
    pool = stored(ranking.candidates(ranking.boost(stored(_fused(spark, d)), docs, few=True), _DEPTH).withColumn("query", F.lit(_RERANK_QUERY)))
    return ranking.rerank(pool).select("id", F.col("fused_rank").cast("long").alias("fused_rank"), r6("final").alias("final"))


_DECLARED = """
WITH decl AS (SELECT p.p_partkey AS id, replace(p.p_name, ' ', '.') || '.' || p.p_partkey AS name, p.p_type || '.' || p.p_brand AS module, lower(p.p_type) || ' ' || p.p_name AS text,
  replace(q.p_name, ' ', '.') || '.' || q.p_partkey AS dep FROM part p JOIN part q ON q.p_partkey = p.p_partkey * 7 % 11)"""
_SEARCHED = "small ring 35"
_PACKAGES = ["ECONOMY", "SMALL"]


@query(f"""{_DECLARED}, {_bm25_sql(f'SELECT id, list_distinct({_SPACED % "name"}) AS tokens FROM decl', _SEARCHED.split())},
l AS (SELECT id, rank FROM (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM bm25) WHERE rank <= 1000),
qv AS (SELECT [x / sqrt(list_sum([CAST(y AS DOUBLE) * y FOR y IN embedding])) FOR x IN embedding] AS b FROM embeddings WHERE vec_id = 7),
dots AS (SELECT vec_id AS id, {_DOT} AS score FROM (SELECT vec_id, embedding AS a, b FROM embeddings JOIN decl ON vec_id = id, qv)),
r AS (SELECT id, row_number() OVER (ORDER BY greatest(score, 0) DESC, id) AS rank FROM (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS k FROM dots) WHERE k <= 1000),
fused AS (SELECT id, row_number() OVER (ORDER BY fused DESC, id) AS fused_rank FROM (SELECT id, 1 / coalesce(l.rank, (SELECT count(*) FROM l) + 1) + 1 / coalesce(r.rank, (SELECT count(*) FROM r) + 1) AS fused FROM l FULL JOIN r USING (id))),
p AS (SELECT * FROM fused JOIN decl USING (id) WHERE fused_rank <= 500),
n AS (SELECT p.*, coalesce(k, 0) AS n FROM p LEFT JOIN (SELECT dep AS name, count(*) AS k FROM p GROUP BY dep) USING (name)),
boosted AS (SELECT *, row_number() OVER (ORDER BY 1 / fused_rank + 1 / CASE WHEN n > 0 THEN most - n + 1 WHEN most > 0 THEN most + 1 ELSE 501 END DESC, fused_rank) AS boosted_rank FROM n, (SELECT max(n) AS most FROM n)),
top AS (SELECT 0 AS q, * FROM (SELECT *, row_number() OVER (ORDER BY boosted_rank) AS place FROM boosted WHERE split_part(module, '.', 1) IN ({', '.join(f"'{x}'" for x in _PACKAGES)})) WHERE place <= 25),
{_rerank_sql('top', _SEARCHED, _SEARCHED.split())}
SELECT CAST(row_number() OVER (ORDER BY final DESC, boosted_rank) AS BIGINT) AS position, id, name, module, text AS informalization FROM reranked JOIN top USING (id) QUALIFY position <= 20""")
def full_search(spark, d):
    """The engine's whole search: names and vectors, fusion, boost, package filter, candidates, rerank with all its parts, over saved indices."""
    parts = read(spark, d, "part")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("."), F.col("p_partkey").cast("string"))
    named = parts.select(F.col("p_partkey").alias("base"), name.alias("dep"))
    vectors = read(spark, d, "embeddings").select(F.col("vec_id").alias("p_partkey"), "embedding")
    rows = parts.join(vectors, "p_partkey", "left").join(named, F.col("base") == F.col("p_partkey") * 7 % 11)
    declared = _declared(rows, id="p_partkey", name=name, module=F.concat_ws(".", "p_type", "p_brand"), informalization=F.concat_ws(" ", F.lower("p_type"), "p_name"), dependencies=F.array("dep"), informalization_embedding="embedding")
    asked = spark.createDataFrame([(0, _SEARCHED)], "query_id long, query string")
    wanted = vectors.where("p_partkey = 7").select(F.lit(0).cast("long").alias("query_id"), "embedding")
    path = kept_path("parts", parts, lambda p: SearchEngine.build(declared, lambda q: wanted).save(p))
    engine = SearchEngine.load(spark, path, declared, lambda q: wanted, fuzzy=edit_similarity)
    found = engine.search(asked, limit=20, packages=_PACKAGES)
    return found.select(F.col("position").cast("long").alias("position"), "id", "name", "module", "informalization")


@query()
def fuzzy_name(spark, d):
    return read(spark, d, "part").select("p_partkey", F.round(udfs.fuzzy_name_score(F.lit("small_ring"), F.col("p_name")), 6).alias("score"))


@query("""
WITH a AS (SELECT vec_id AS id, label - 4.0 AS s FROM embeddings), b AS (SELECT doc_id AS id, quality * 7.0 - 3 AS s FROM labels)
SELECT id, greatest(max(s), 0.0) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id""")
def max_merge(spark, d):
    rows = read(spark, d, "embeddings").select(F.lit(0).alias("query_id"), F.col("vec_id").alias("id"), (F.col("label") - F.lit(4.0)).alias("score"))
    other = read(spark, d, "labels").select(F.lit(0).alias("query_id"), F.col("doc_id").alias("id"), (F.col("quality") * 7.0 - 3).alias("score"))
    return lexical.best_of(rows, other).select("id", "score")


# text functions


@query(r"""
WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '/-(.|\n)*?-/|/-(.|\n)*$|--[^\n]*', '', 'g'), '\s+', ' ', 'g')) AS s, CASE WHEN doc_id % 2 = 0 THEN 'a.toB' ELSE 'a.to' END AS name FROM documents)
SELECT doc_id, name = 'a.toB' AND count(*) OVER (PARTITION BY s) > 1 AS generated FROM t""")
def projection_filter(spark, d):
    """Every text with nested comments that differ from row to row: what is counted are the texts without them."""
    noted = F.replace("text", F.lit(". "), F.concat(F.lit(". /- note /- of -/ "), F.col("doc_id"), F.lit(" -/")))
    rows = read(spark, d, "documents").withColumn("name", F.when(F.col("doc_id") % 2 == 0, "a.toB").otherwise("a.to")).withColumn("noted", noted)
    return ingest.split_projections(rows, source="noted").select("doc_id", "generated")


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(html, '<!--', '/-'), '-->', '-/') || ' -- end', '/-(.|\n)*?-/|/-(.|\n)*$|--[^\n]*', '', 'g'), '\s+', ' ', 'g')) AS stripped FROM pages""")
def strip_comments(spark, d):
    """Pages' own comments as block comments, after a nested one, before one to the line's end."""
    html = F.replace(F.replace("html", F.lit("<!--"), F.lit("/-")), F.lit("-->"), F.lit("-/"))
    source = F.concat(F.lit("/- a /- b -/ c -/"), html, F.lit(" -- end"))
    return read(spark, d, "pages").select("page_id", udfs.strip_comments(source).alias("stripped"))


@query("""SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS href FROM pages""")
def href_extract(spark, d):
    return read(spark, d, "pages").select("page_id", F.explode(text.linked_names(F.col("html"), 'href="([^"]*)"')).alias("href"))


_LINK = "'https://github.com/o' || page_id || '/r-' || page_id || '/blob/main/src/lean/A/' || page_id || '.lean#L' || page_id || '-L' || (page_id + 3)"


@query(rf"""WITH l AS (SELECT page_id, {_LINK} AS url, 'github\.com/([^/]+)/([^/]+)/blob/[^/]+/(.+\.lean)#L(\d+)-L(\d+)' AS p FROM pages)
SELECT page_id, regexp_extract(url, p, 2) AS package, regexp_extract(url, p, 3) AS path, CAST(regexp_extract(url, p, 4) AS BIGINT) AS line_start, CAST(regexp_extract(url, p, 5) AS BIGINT) AS line_end FROM l""")
def link_parse(spark, d):
    p = text.link_parts(F.expr(_LINK))
    return read(spark, d, "pages").select("page_id", *(p[c].alias(c) for c in ("package", "path", "line_start", "line_end")))


_TAG_LINES = "replace(replace(replace(html, '><', '>' || chr(10) || '<'), '<p>', '@[simp]' || chr(10)), 'class=', ' class :=')"
_PAGE_HOST = r"regexp_extract(url, '//([^/]+)', 1)"


@query(rf"""
WITH p AS (SELECT page_id, {_PAGE_HOST} AS host, string_split({_TAG_LINES}, chr(10)) AS l FROM pages),
asked AS (
  SELECT page_id, 'https://github.com/o/' || host || '/blob/main/p/' || page_id || '.lean#L' || a || '-L' || b AS source_link, a, b, l
  FROM (SELECT *, 3 AS a, 6 AS b FROM p UNION ALL SELECT *, list_position(l, '@[simp]'), list_position(l, '@[simp]') FROM p WHERE list_contains(l, '@[simp]'))),
lines AS (SELECT page_id, i AS number, l[i] || CASE WHEN i < len(l) THEN chr(10) ELSE '' END AS line FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM p)),
own AS (SELECT source_link, page_id, a, b, len(l) AS size, array_to_string(l[a:b], chr(10)) || CASE WHEN b < len(l) THEN chr(10) ELSE '' END AS t FROM asked WHERE b <= len(l)),
marks AS (SELECT page_id, number FROM lines WHERE regexp_matches(line, ' (def|theorem|lemma|instance|class|structure|inductive|abbrev) |:=')),
ends AS (
  SELECT source_link, page_id, a, CASE WHEN b >= size THEN b WHEN regexp_matches(t, ' (def|theorem|lemma|instance|class|structure|inductive|abbrev) |:=') THEN b + 1
         ELSE coalesce((SELECT min(number) FROM marks m WHERE m.page_id = own.page_id AND number > b), size) END AS e
  FROM own WHERE starts_with(ltrim(t, ' ' || chr(9) || chr(10)), '@[')),
longer AS (SELECT source_link, rtrim(string_agg(line, '' ORDER BY number), ' ' || chr(9) || chr(10)) AS t FROM ends JOIN lines USING (page_id) WHERE number BETWEEN a AND e GROUP BY source_link)
SELECT source_link, CASE WHEN l.t IS NOT NULL THEN l.t ELSE o.t END AS source_text FROM (SELECT DISTINCT source_link FROM asked) LEFT JOIN own o USING (source_link) LEFT JOIN longer l USING (source_link)""")
def source_lines(spark, d):
    """Lines of files by their links: folders of mixed case, ranges, and texts that begin with an attribute."""
    pages = read(spark, d, "pages").select("page_id", F.expr(_PAGE_HOST).alias("host"), F.expr(_TAG_LINES).alias("text"))
    lines = files.line_table(pages.withColumn("path", F.concat(F.upper("host"), F.lit("/p/"), F.col("page_id"), F.lit(".lean"))))
    first = F.array_position(F.split("text", "\n"), "@[simp]")
    link = lambda a, b: F.concat(F.lit("https://github.com/o/"), "host", F.lit("/blob/main/p/"), "page_id", F.lit(".lean#L"), a, F.lit("-L"), b)
    links = pages.select(link(F.lit(3), F.lit(6)).alias("source_link")).unionByName(pages.where(first > 0).select(link(first, first).alias("source_link")))
    return files.read_sources(links, files.package_registry(pages.select(F.upper("host").alias("folder")).distinct()), lines)


_MODULE = "CASE page_id % 4 WHEN 0 THEN 'Init.A' WHEN 1 THEN 'Lake.B.C' WHEN 2 THEN 'Other.D' ELSE 'Std' END"


@query(f"""WITH m AS (SELECT page_id, {_MODULE} AS m, CASE WHEN page_id % 5 = 0 THEN url END AS u FROM pages)
SELECT page_id, CASE WHEN u <> '' THEN u || '#L1-L9'
  WHEN split_part(m, '.', 1) IN ('Init', 'Lean', 'Std') THEN 'https://github.com/leanprover/lean4/blob/v4.1.0/src/lean/' || replace(m, '.', '/') || '.lean#L1-L9'
  WHEN split_part(m, '.', 1) = 'Lake' THEN 'https://github.com/leanprover/lean4/blob/v4.1.0/src/lake/' || replace(m, '.', '/') || '.lean#L1-L9' END AS link FROM m""")
def link_construct(spark, d):
    url = F.when(F.col("page_id") % 5 == 0, F.col("url"))
    return read(spark, d, "pages").select("page_id", text.source_link(F.expr(_MODULE), url, F.lit(1), F.lit(9), "v4.1.0").alias("link"))


_BOLD = "CASE WHEN doc_id % 3 = 0 THEN concat('**', left(text, 12), '** rest') ELSE text END"


@query(rf"SELECT doc_id, nullif(regexp_extract({_BOLD}, '^\*\*(.+?)\*\*', 1), '') AS header FROM documents")
def bold_header(spark, d):
    return read(spark, d, "documents").select("doc_id", text.bold_header(F.expr(_BOLD)).alias("header"))


@query(rf"""SELECT doc_id, CASE WHEN h IS NULL THEN json_object('id', doc_id, 'name', source) ELSE json_object('id', doc_id, 'name', source, 'description', h) END AS summary
FROM (SELECT *, nullif(regexp_extract({_BOLD}, '^\*\*(.+?)\*\*', 1), '') AS h FROM documents)""")
def summary_projection(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.col("doc_id").alias("id"), F.col("source").alias("name"), text.bold_header(F.expr(_BOLD)).alias("description"))
    return rows.select("doc_id", text.compact_json("id", "name", "description").alias("summary"))


@query("SELECT doc_id, CASE WHEN length(text) > 256 THEN left(text, 253) || '...' ELSE text END AS short FROM documents")
def truncate_ellipsis(spark, d):
    return read(spark, d, "documents").select("doc_id", text.shortened(F.col("text")).alias("short"))


_TEMPLATE = "Name {name}\n{docstring}\n{source_text}\n{dependencies}"


@query("""
WITH r AS (SELECT doc_id, 'doc' || doc_id AS name, source, lang FROM documents),
e AS (SELECT doc_id, k, 'doc' || (doc_id - k) AS dep FROM r, range(1, 4) t(k)),
x AS (SELECT doc_id, string_agg('- ' || dep || ': ' || CASE WHEN length(d.text) > 256 THEN left(d.text, 253) || '...' ELSE d.text END, chr(10) ORDER BY k) AS deps
      FROM e JOIN (SELECT 'doc' || doc_id AS dep, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) d USING (dep) GROUP BY doc_id)
SELECT doc_id, md5('Name ' || name || chr(10) || CASE WHEN doc_id % 5 = 0 THEN 'No docstring available' ELSE lang END || chr(10) || source || chr(10) || coalesce('Dependencies:' || chr(10) || deps, '')) AS prompt
FROM r LEFT JOIN x USING (doc_id)""")
def prompt_build(spark, d):
    docs = read(spark, d, "documents")
    name = lambda c: F.concat(F.lit("doc"), c.cast("string"))
    rows = docs.select("doc_id", name(F.col("doc_id")).alias("name"), F.col("source").alias("source_text"), F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("docstring"), F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda k: name(F.col("doc_id") - k)).alias("dependencies"))
    # texts that have been made so far: those of labelled documents
    texts = docs.join(read(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select(name(F.col("doc_id")).alias("name"), "text")
    return enrich.prompts(rows, texts, _TEMPLATE).select("doc_id", F.md5("prompt").alias("prompt"))


_DEPS = """CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '["a","b"]' WHEN 2 THEN 'not json [' ELSE '["' || event_type || '","a"]' END"""


@query(f"""WITH j AS (SELECT event_id, event_type, {_DEPS} AS j FROM events),
l AS (SELECT event_id, event_type, CASE WHEN json_valid(j) AND json_type(TRY_CAST(j AS JSON)) = 'ARRAY' THEN from_json(CASE WHEN json_valid(j) THEN j ELSE '[]' END, '["VARCHAR"]') ELSE [] END AS l FROM j)
SELECT event_id, CAST(len(l) AS BIGINT) AS n, CASE WHEN len(list_filter(l, lambda x: x <> event_type)) > 0 THEN to_json(list_filter(l, lambda x: x <> event_type)) END AS deps FROM l""")
def json_deps(spark, d):
    names = text.parsed_dependencies(F.expr(_DEPS))
    rows = read(spark, d, "events").select("event_id", "event_type", names.alias("l"))
    return rows.select("event_id", F.size("l").cast("long").alias("n"), text.dependencies_json(text.without_self(F.col("l"), F.col("event_type"))).alias("deps"))


# ingest and enrichment


@query("""
WITH r AS (SELECT page_id, 'M.' || split_part(split_part(url, '/', 3), '.', 1) AS m, CASE WHEN page_id % 11 = 0 THEN 'x.mk' ELSE 'x' END AS name, CASE WHEN page_id % 7 <> 0 THEN url END AS u FROM pages)
SELECT reason AS skip_reason, count(*) AS rows FROM (SELECT CASE WHEN page_id % 3 = 0 THEN 'prefix' WHEN name = 'x.mk' THEN 'constructor' WHEN u IS NULL THEN 'no_source' END AS reason FROM r) WHERE reason IS NOT NULL GROUP BY reason""")
def skip_reasons(spark, d):
    rows = read(spark, d, "pages").select(
        F.when(F.col("page_id") % 3 == 0, "Out.a").otherwise("In.a").alias("module_name"), F.when(F.col("page_id") % 11 == 0, "x.mk").otherwise("x").alias("name"),
        F.when(F.col("page_id") % 7 != 0, F.col("url")).alias("source_url"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.lit(None).cast("string").alias("docstring"), F.lit(None).cast("binary").alias("verso_docstring"))
    return ingest.skip_counts(ingest.with_skip_reason(rows, lambda m: text.has_any_prefix(m, ["In"])))


@query("SELECT doc_id FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1 AND text NOT IN (SELECT text FROM benchmark)")
def insert_ignore(spark, d):
    return enrich.insert_ignore(read(spark, d, "benchmark"), read(spark, d, "documents"), key="text", order="doc_id").select("doc_id")


@query("""
WITH s AS (SELECT text, source, 0 AS p, doc_id FROM documents WHERE lang = 'de' UNION ALL SELECT text, source, 1, doc_id FROM documents)
SELECT md5(text) AS key, arg_min(source, row(p, doc_id)) AS source FROM s GROUP BY text""")
def cache_first_wins(spark, d):
    docs = read(spark, d, "documents")
    return enrich.first_wins([docs.where("lang = 'de'"), docs], ["text"], "source", "doc_id").select(F.md5("text").alias("key"), "source")


@query("SELECT doc_id, CAST(quality AS DOUBLE) AS cached FROM documents LEFT JOIN labels USING (doc_id)")
def cache_split(spark, d):
    hits, misses = enrich.split_by_cache(read(spark, d, "documents"), read(spark, d, "labels"), ["doc_id"], "quality")
    return hits.select("doc_id", F.col("cached").cast("double").alias("cached")).unionByName(misses.select("doc_id", F.lit(None).cast("double").alias("cached")))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN CAST(quality AS VARCHAR) ELSE lang END AS lang FROM documents LEFT JOIN labels USING (doc_id)")
def apply_cached(spark, d):
    rows = read(spark, d, "documents").withColumn("lang", F.when(F.col("doc_id") % 4 != 0, F.col("lang")))
    values = read(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    return enrich.apply_values(rows, values, ["doc_id"], "lang", "quality").select("doc_id", "lang")


@query("SELECT doc_id, text, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 100) AS BIGINT) AS batch FROM documents")
def chunk_batches(spark, d):
    return enrich.batches(read(spark, d, "documents").select("doc_id", "text"), 100, "doc_id")


@query("""
WITH e AS (SELECT 'doc' || doc_id || CASE WHEN lang = 'de' THEN '.toB' ELSE '' END AS name, source AS module, md5(text) AS source_text FROM documents),
kept AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY source_text) AS k FROM e) WHERE NOT (suffix(name, '.toB') AND k > 1)),
known AS (SELECT doc_id + 1 AS id, 'doc' || doc_id AS name, 'known' AS module, 'x' AS source_text FROM labels)
SELECT * FROM known UNION ALL
SELECT row_number() OVER (ORDER BY name) + (SELECT max(id) FROM known), name, module, source_text FROM kept WHERE name NOT IN (SELECT name FROM known)""")
def add_declarations(spark, d):
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    known = _declared(read(spark, d, "labels"), id=F.col("doc_id") + 1, name=name, module=F.lit("known"), source_text=F.lit("x"))
    found = _declared(read(spark, d, "documents"), name=F.concat(name, F.when(F.col("lang") == "de", ".toB").otherwise("")), module="source", source_text=F.md5("text"), source_link=F.lit("l"))
    return extract.add_declarations(known, found.drop("id"))[0].select("id", "name", "module", "source_text")


def _graph(spark, d):
    k = F.col("s_suppkey")
    return read(spark, d, "supplier").select(k.cast("string").alias("name"), F.array((k % 6).cast("string"), F.floor(k / 7).cast("string"), F.lit("outside")).alias("dependencies"))


@query("""
WITH RECURSIVE n AS (SELECT s_suppkey AS k FROM supplier), e AS (SELECT DISTINCT k, d FROM (SELECT k, k % 6 AS d FROM n UNION ALL SELECT k, k // 7 FROM n) WHERE d <> k AND d IN (SELECT k FROM n)),
w AS (SELECT k, 1 AS layer FROM n UNION SELECT e.k, w.layer + 1 FROM w JOIN e ON e.d = w.k WHERE w.layer < 100)
SELECT CAST(k AS VARCHAR) AS name, max(layer) AS layer FROM w GROUP BY k""")
def dependency_layers(spark, d):
    return graph.layers(_graph(spark, d))


@query("""
WITH c AS (SELECT 'p' || p_partkey AS name, row_number() OVER (ORDER BY p_partkey) AS layer FROM part)
SELECT name, CAST(layer AS INT) AS layer FROM c UNION ALL SELECT 's' || s_suppkey, CAST((SELECT max(layer) + 1 FROM c) AS INT) FROM supplier""")
def deep_layers(spark, d):
    """One chain of all parts, and one cycle of all suppliers: as many layers as parts, by a bounded number of jobs."""
    parts, suppliers = read(spark, d, "part").select("p_partkey"), read(spark, d, "supplier").select("s_suppkey")
    first, last = suppliers.agg(F.min("s_suppkey"), F.max("s_suppkey")).first()
    chain = parts.select(F.concat(F.lit("p"), "p_partkey").alias("name"), F.array(F.concat(F.lit("p"), F.col("p_partkey") - 1)).alias("dependencies"))
    after = F.when(F.col("s_suppkey") == last, F.lit(first)).otherwise(F.col("s_suppkey") + 1)
    cycle = suppliers.select(F.concat(F.lit("s"), "s_suppkey").alias("name"), F.array(F.concat(F.lit("s"), after)).alias("dependencies"))
    return graph.layers(chain.unionByName(cycle))


@query("""WITH n AS (SELECT s_suppkey AS k FROM supplier), e AS (SELECT DISTINCT k, d FROM (SELECT k, k % 6 AS d FROM n UNION ALL SELECT k, k // 7 FROM n) WHERE d <> k AND d IN (SELECT k FROM n))
SELECT CAST(n.k AS VARCHAR) AS name, count(d) AS waits FROM n LEFT JOIN e ON n.k = e.k GROUP BY n.k""")
def in_degrees(spark, d):
    return graph.in_degrees(_graph(spark, d))


_TAG = "CASE WHEN l_returnflag = 'A' THEN 'nightly-' || l_linenumber ELSE CASE WHEN l_tax > 0.01 THEN 'v' ELSE '' END || CAST(l_quantity AS INT) || '.' || l_suppkey || '.' || l_linenumber || CASE WHEN l_linestatus = 'F' THEN '-rc' || l_linenumber ELSE '' END END"


@query(rf"""WITH t AS (SELECT l_partkey AS repo, l_orderkey * 10 + l_linenumber AS seq, {_TAG} AS tag FROM lineitem),
k AS (SELECT *, regexp_matches(tag, '^v?\d+\.\d+\.\d+') AS ok, [CAST(x AS BIGINT) FOR x IN regexp_extract_all(tag, '\d+')] AS key FROM t)
SELECT repo, tag FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ok DESC, CASE WHEN ok THEN key END DESC, seq, tag) AS n FROM k) WHERE n = 1""")
def semver_argmax(spark, d):
    """Each part's newest tag, of those that its lines give."""
    return ingest.latest_tag(read(spark, d, "lineitem").select(F.col("l_partkey").alias("repo"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.expr(_TAG).alias("tag")))


# events over time


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS in_window FROM events")
def rolling_rate(spark, d):
    return rates.trailing_counts(read(spark, d, "events"), 60, ["event_type"]).select("event_id", "in_window")


@query("""
SELECT event_id, round(count(*) OVER w / nullif(epoch_us(ts) - min(epoch_us(ts)) OVER w, 0) * 1000000, 6) AS per_second
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 300 SECONDS PRECEDING AND CURRENT ROW)""")
def rolling_per_second(spark, d):
    return rates.trailing_rates(read(spark, d, "events"), 300, ["event_type"]).select("event_id", r6("per_second").alias("per_second"))


_HOURS = "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS events, round(sum(value), 6) AS total FROM events GROUP BY ALL"


def _hours(rows):
    return rows.select(F.unix_timestamp("start").alias("start"), "event_type", "events", r6("total").alias("total"))


@query(_HOURS)
def window_counts(spark, d):
    return _hours(rates.windowed_counts(read(spark, d, "events"), "1 hour", keys=["event_type"], value="value"))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS events FROM s GROUP BY user_id, k""")
def session_counts(spark, d):
    rows = rates.sessions(read(spark, d, "events"), "30 minutes", ["user_id"])
    return rows.select("user_id", F.unix_micros("start").alias("start"), "events")


def _arriving(spark, d, name):
    """A table's files as a stream."""
    schema = read(spark, d, name).schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parquet*")


def _streamed(rows, keep=None):
    """What a stream writes of all that is there: files in the shared folder, read back."""
    spark = rows.sparkSession
    path = f"{checkpoint_root(rows)}/{uuid.uuid4().hex}"
    out = rows.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    if keep is None:
        out.format("parquet").start(f"{path}/out").awaitTermination()
    else:  # the last state of complete results
        out.outputMode("complete").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/out")).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/out")


@query(_HOURS)
def stream_windows(spark, d):
    """The same counts by a stream that reads what is there and stops."""
    counts = rates.windowed_counts(_arriving(spark, d, "events"), "1 hour", keys=["event_type"], value="value")
    return _hours(_streamed(counts, "all"))


@query("""
SELECT event_id, count(*) OVER w AS in_window, round(count(*) OVER w / nullif(epoch_us(ts) - min(epoch_us(ts)) OVER w, 0) * 1000000, 6) AS per_second
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW)""")
def stream_rolling_rate(spark, d):
    """The trailing window's count and rate by a stream with keyed state and timers."""
    was = spark.conf.get(trailing.STATE_STORE[0])
    spark.conf.set(*trailing.STATE_STORE)
    try:
        found = _streamed(trailing.trailing_stream(_arriving(spark, d, "events"), 60, ["event_type"]))
    finally:
        spark.conf.set(trailing.STATE_STORE[0], was)
    return found.select("event_id", "in_window", r6("per_second").alias("per_second"))


@query("SELECT event_type, user_id, 'v' || event_type || '-' || user_id AS value FROM (SELECT DISTINCT event_type, user_id FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL)")
def stream_enrich(spark, d):
    """Values for all arriving keys, each generated once, though the second run of the stream reads everything again."""
    events = _arriving(spark, d, "events").select("event_type", "user_id")
    path = f"{checkpoint_root(events)}/{uuid.uuid4().hex}"
    made = lambda rows: rows.withColumn("value", F.concat(F.lit("v"), "event_type", F.lit("-"), "user_id"))
    for run in ("a", "b"):
        resumable.enrich_stream(events, f"{path}/cache", ["event_type", "user_id"], "value", made, f"{path}/{run}").awaitTermination()
    schema = StructType([events.schema["event_type"], events.schema["user_id"]]).add("value", "string")
    return resumable.ResumableCache(spark, f"{path}/cache", schema, ["event_type", "user_id"]).rows()

