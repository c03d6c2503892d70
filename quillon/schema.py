"""Schemas of the declaration table, its index tables and the service's answers."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _l = T.StringType(), T.LongType()

#: One row per declaration. Names are unique (the writer sees to it); dependencies are names, in order.
DECLARATION = T.StructType(
    [
        T.StructField("id", _l, False),
        T.StructField("name", _s, False),
        T.StructField("module", _s, False),
        T.StructField("docstring", _s),
        T.StructField("source_text", _s, False),
        T.StructField("source_link", _s, False),
        T.StructField("dependencies", T.ArrayType(_s)),
        T.StructField("informalization", _s),
        T.StructField("informalization_embedding", T.ArrayType(T.FloatType())),
    ]
)
#: What a search returns: a declaration without its embedding.
RESULT_COLUMNS = [f.name for f in DECLARATION.fields if f.name != "informalization_embedding"]
#: A declaration as a reader gives it, before it has an id.
EXTRACTED = T.StructType([f for f in DECLARATION.fields if f.name in ("name", "module", "docstring", "source_text", "source_link", "dependencies")])
QUERY = T.StructType([T.StructField("query_id", _l, False), T.StructField("query", _s, False)])
POSTINGS = "term string, id long, tf long, dl long"
VECTORS = "id long, embedding array<float>, list_id int"
#: Modules of JSON documentation files.
JSON_MODULE = T.StructType(
    [
        T.StructField("name", _s),
        T.StructField(
            "declarations",
            T.ArrayType(T.StructType([T.StructField("info", T.StructType([T.StructField("name", _s), T.StructField("doc", _s), T.StructField("sourceLink", _s)])), T.StructField("header", _s)])),
        ),
    ]
)
