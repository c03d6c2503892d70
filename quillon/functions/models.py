"""Models over text columns: loaded once a task, asked in batches of texts of like length, with capped inputs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_words(text: str, most: int) -> str:
    """The text to its ``most``-th word: a cap where no tokenizer is given."""
    parts = text.split(maxsplit=most)
    return text if len(parts) <= most else " ".join(parts[:most])


def in_batches(texts: Sequence[str | None], ask: Callable[[list[str]], Sequence], batch: int) -> list:
    """The answers in the texts' order, None for None; texts of like length share a batch, each distinct text is asked once."""
    distinct = sorted({t for t in texts if t is not None}, key=lambda t: (-len(t), t))
    known = {}
    for a in range(0, len(distinct), batch):
        part = distinct[a : a + batch]
        answers = ask(part)
        if len(answers) != len(part):
            raise ValueError("the model gave another number of answers")
        known.update(zip(part, answers))
    return [None if t is None else known[t] for t in texts]


@dataclass(frozen=True)
class TextModel:
    """Embeddings of documents and of queries, which have a prompt before them.

    load: gives the model, a function of a list of texts to a list of vectors, on the worker that asks it. cap: a text and a
    number of tokens to a text of no more than so many, by the model's own tokenizer. Null texts have null vectors.
    """

    load: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]]
    prompt: str = ""
    max_tokens: int | None = 512
    batch: int = 32
    cap: Callable[[str, int], str] = first_words

    def documents(self, column: Column) -> Column:
        return self._asked("")(column)

    def queries(self, column: Column) -> Column:
        return self._asked(self.prompt)(column)

    def query_table(self, queries: DataFrame) -> DataFrame:
        """(query_id, query) to (query_id, embedding), as the search engine asks for."""
        return queries.select("query_id", self.queries(F.col("query")).alias("embedding"))

    def _asked(self, prompt: str):
        own = self

        def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = own.load()
            for s in series:
                texts = [None if t is None else prompt + (t if own.max_tokens is None else own.cap(t, own.max_tokens)) for t in s]
                yield pd.Series([None if v is None else np.asarray(v, np.float32) for v in in_batches(texts, model, own.batch)], dtype=object)

        return F.pandas_udf(run, "array<float>")


@dataclass(frozen=True)
class PairModel:
    """Scores of (query, document) pairs by a model that reads both as one text.

    load: gives a function of a list of texts to a list of scores. template has {query} and {document}; the document is
    capped so that the pair keeps within ``max_tokens`` by ``cap``'s measure, the query first. Pairs with a null have no score.
    """

    load: Callable[[], Callable[[list[str]], Sequence[float]]]
    template: str = "{query}\n{document}"
    max_tokens: int | None = 256
    batch: int = 16
    cap: Callable[[str, int], str] = first_words
    count: Callable[[str], int] = lambda t: len(t.split())

    def text(self, query: str, document: str) -> str:
        if self.max_tokens is not None:
            query = self.cap(query, self.max_tokens)
            document = self.cap(document, left) if (left := self.max_tokens - self.count(query)) > 0 else ""
        parts = {"{query}": query, "{document}": document}
        return re.sub(r"\{query\}|\{document\}", lambda m: parts[m[0]], self.template)

    def score(self, query: Column, document: Column) -> Column:
        own = self

        def run(series: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = own.load()
            for queries, documents in series:
                texts = [None if q is None or d is None else own.text(q, d) for q, d in zip(queries, documents)]
                yield pd.Series([None if v is None else float(v) for v in in_batches(texts, model, own.batch)], dtype="float64")

        return F.pandas_udf(run, "double")(query, document)
