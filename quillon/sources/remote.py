"""A remote search service as a source of rows, over HTTP with the standard library."""

from __future__ import annotations

import itertools
import json
import os
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

import pandas as pd
from pyspark.sql import DataFrame

from quillon.schema import RESULT_COLUMNS

_RESULT = "query_id long, position int, id long, name string, module string, docstring string, source_text string, source_link string, dependencies string, informalization string"


def retried(call: Callable, attempts: int = 3, waits: Callable[[int], float] = lambda k: min(10.0, max(2.0, 2.0**k)), sleep: Callable[[float], None] = time.sleep):
    """What ``call`` gives; after a failure it waits (2 to 10 s, doubling) and tries again; the last failure is raised."""
    for k in range(attempts):
        try:
            return call()
        except Exception:
            if k == attempts - 1:
                raise
            sleep(waits(k))


def doubling(base: float) -> Callable[[int], float]:
    """Waits of base, 2 base, 4 base, ... seconds, for long downloads."""
    return lambda k: base * 2**k


def read_url(url: str, headers: dict[str, str] | None = None, timeout: float = 30.0) -> str:
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=timeout) as r:
        return r.read().decode("utf-8")


def http_post(url: str, body: dict, timeout: float = 120.0, headers: dict[str, str] | None = None) -> dict:
    data = json.dumps(body).encode()
    with urllib.request.urlopen(urllib.request.Request(url, data, {"Content-Type": "application/json"} | (headers or {})), timeout=timeout) as r:
        return json.load(r)


def http_get(url: str, headers: dict[str, str], timeout: float = 10.0) -> dict | None:
    """The JSON answer; None for 404, other errors are raised."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
            return json.load(r)
    except urllib.error.HTTPError as e:
        if e.code == 404:
            return None
        raise


class RemoteClient:
    """search and get_by_id as the local service has them; reranking is the server's."""

    def __init__(self, base_url: str, key: str | None = None, get: Callable[[str, dict], dict | None] = http_get) -> None:
        self.base_url, self.get = base_url.rstrip("/"), get
        self.headers = {"Authorization": f"Bearer {key}"} if key else {}

    def search(self, query: str, limit: int = 20, rerank_top: int | None = None, packages: Sequence[str] | None = None) -> dict:
        asked = {"q": query, "limit": limit} | ({"packages": ",".join(packages)} if packages else {})
        answer = self.get(f"{self.base_url}/search?{urllib.parse.urlencode(asked)}", self.headers) or {}
        results = answer.get("results", [])
        return {"query": query, "results": results, "count": len(results), "processing_time_ms": answer.get("processing_time_ms")}

    def get_by_id(self, declaration_id: int) -> dict | None:
        return self.get(f"{self.base_url}/declarations/{int(declaration_id)}", self.headers)


def remote_search(queries: DataFrame, client: RemoteClient, limit: int = 20, packages: Sequence[str] | None = None, tasks: int = 2) -> DataFrame:
    """Results of a query table (query_id, query); ``tasks`` bounds how many requests run at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for q in batch.itertuples():
                for k, r in enumerate(client.search(q.query, limit, packages=packages)["results"], 1):
                    rows.append({"query_id": q.query_id, "position": k} | {c: r.get(c) for c in RESULT_COLUMNS})
            yield pd.DataFrame(rows, columns=["query_id", "position", *RESULT_COLUMNS])

    return queries.select("query_id", "query").repartition(tasks).mapInPandas(run, _RESULT)


def remote_vectors(texts: DataFrame, url: str, text_col: str = "text", batch: int = 256, tasks: int = 2, post: Callable[[str, dict], dict] = http_post) -> DataFrame:
    """All columns and ``embedding``: a server's vector of each text, asked for in batches; ``tasks`` bounds how many requests run at once."""
    endpoint = f"{url.rstrip('/')}/api/v2/embed"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for a in range(0, len(rows), batch):
                some = rows.iloc[a : a + batch]
                found = retried(lambda: post(endpoint, {"texts": list(some[text_col])}))["embeddings"]  # noqa: B023
                if len(found) != len(some):
                    raise ValueError("the server gave another number of vectors")
                yield some.assign(embedding=found)

    return texts.repartition(tasks).mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in texts.dtypes) + ", embedding array<float>")


def as_completed(ask: Callable[[str], str | None], rows: Iterator[tuple], bound: int) -> Iterator[tuple]:
    """(row, answer, error) of rows whose first item is asked for, in the order of completion, ``bound`` requests at a time.

    A new row is taken when a request has ended, so neither threads nor rows that wait grow with the input.
    """
    with ThreadPoolExecutor(bound) as pool:
        waiting: dict[Future, tuple] = {}
        try:
            while True:
                for row in itertools.islice(rows, bound - len(waiting)):
                    waiting[pool.submit(ask, row[0])] = row
                if not waiting:
                    return
                for done in wait(waiting, return_when=FIRST_COMPLETED).done:
                    row = waiting.pop(done)
                    yield (row, None, done.exception()) if done.exception() else (row, done.result(), None)
        finally:
            for f in waiting:
                f.cancel()


def remote_texts(prompts: DataFrame, url: str, model: str, key: str | None = None, temperature: float = 0.7, tasks: int = 2, in_flight: int = 10, chunk: int = 100, failures: int = 20, post: Callable[..., dict] = http_post) -> DataFrame:
    """All columns and ``answer``: a chat model's text for each ``prompt``; a blank answer is null. In any order.

    Each of ``tasks`` tasks has ``in_flight`` requests under way and gives out answers ``chunk`` at a time as they come, so a
    slow one holds up none. A request that fails for good leaves null, to be asked for by a later run, and what others gave
    is kept; after more than ``failures`` in a row a task fails.
    """
    headers = {"Authorization": f"Bearer {key}"} if key else {}
    names = prompts.columns
    place = names.index("prompt")

    def ask(prompt: str) -> str | None:
        body = {"model": model, "temperature": temperature, "messages": [{"role": "user", "content": prompt}]}
        return retried(lambda: post(f"{url.rstrip('/')}/chat/completions", body, headers=headers))["choices"][0]["message"]["content"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((r[place], r) for b in batches for r in b.itertuples(index=False, name=None))
        frame = lambda done: pd.DataFrame(done, columns=[*names, "answer"])
        done, failed = [], 0
        for (_, row), answer, error in as_completed(ask, rows, in_flight):
            failed = failed + 1 if error else 0
            if failed > failures:
                raise error
            done.append((*row, (answer or "").strip() or None))
            if len(done) >= chunk:
                yield frame(done)
                done = []
        if done:
            yield frame(done)

    return prompts.repartition(tasks).mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in prompts.dtypes) + ", answer string")


# what is read of a source repository before its documentation is

_REPOSITORY = re.compile(r"github\.com[/:]([^/]+)/([^/]+?)(?:\.git)?/?$")


def _repository(url: str) -> tuple[str, str]:
    m = _REPOSITORY.search(url)
    if not m:
        raise ValueError(f"not a repository's address: {url}")
    return m[1], m[2]


def toolchain(url: str, ref: str = "main", read: Callable[[str], str] = read_url) -> str:
    """The content of a repository's toolchain file at a branch or tag."""
    owner, name = _repository(url)
    place = f"https://raw.githubusercontent.com/{owner}/{name}/{ref}/lean-toolchain"
    try:
        return read(place).strip()
    except Exception as e:
        raise RuntimeError(f"no toolchain at {place}: {e}") from e


def newest_tag(url: str, read: Callable[[str], str] = read_url) -> str:
    """The newest version-like one of a repository's first hundred tags, else its first; candidates of a release sort after it."""
    owner, name = _repository(url)
    place = f"https://api.github.com/repos/{owner}/{name}/tags?per_page=100"
    try:
        tags = [t["name"] for t in json.loads(read(place))]
    except Exception as e:
        raise RuntimeError(f"no tags at {place}: {e}") from e
    if not tags:
        raise RuntimeError(f"{url} has no tags")
    like = [t for t in tags if re.match(r"v?\d+\.\d+\.\d+", t)]
    return max(like, key=lambda t: [int(x) for x in re.findall(r"\d+", t)]) if like else tags[0]


def pin_version(path: str, requirement: str, version: str) -> bool:
    """Set the version after ``@`` in a build file's requirement of a package; whether the file changed (it is written only then)."""
    with open(path) as f:
        old = f.read()
    new = re.sub(rf'(require\s+«?{re.escape(requirement)}»?\s+from\s+git\s+"[^"]*"\s*@\s*)"[^"]*"', lambda m: f'{m[1]}"{version}"', old)
    if new == old:
        return False
    with open(f"{path}.part", "w") as f:
        f.write(new)
    os.replace(f"{path}.part", path)
    return True
