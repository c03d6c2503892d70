"""The tools that an assistant or a command line calls: thin functions over a backend with search and get_by_id."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol, runtime_checkable

FIELDS = ("source_text", "source_link", "docstring", "informalization", "module", "dependencies")


@runtime_checkable
class Backend(Protocol):
    def search(self, query: str, limit: int = 20, rerank_top: int | None = 50, packages: Sequence[str] | None = None) -> dict: ...

    def get_by_id(self, declaration_id: int) -> dict | None: ...


def _full(value):
    """Without null fields, at any depth."""
    if isinstance(value, dict):
        return {k: _full(v) for k, v in value.items() if v is not None}
    return [_full(v) for v in value] if isinstance(value, list) else value


class Tools:
    """search, search_summary and one getter for each field."""

    def __init__(self, backend: Backend | None) -> None:
        if backend is None:
            raise RuntimeError("no search backend is there")
        self.backend = backend

    def search(self, query: str, limit: int = 10, rerank_top: int | None = 50, packages: Sequence[str] | None = None) -> dict:
        return _full(self.backend.search(query, limit, rerank_top, packages))

    def search_summary(self, query: str, limit: int = 10, rerank_top: int | None = 50, packages: Sequence[str] | None = None) -> dict:
        """Names and bold headers only: a small part of the full answer's size."""
        found = self.search(query, limit, rerank_top, packages)
        return found | {"results": [_full({"id": r["id"], "name": r["name"], "description": header(r.get("informalization"))}) for r in found["results"]]}

    def get_field(self, declaration_id: int, name: str) -> dict | None:
        row = self.backend.get_by_id(declaration_id)
        return None if row is None else _full({"id": row["id"], "name": row["name"], name: row.get(name)})

    def get_source_code(self, declaration_id: int) -> dict | None:
        return self.get_field(declaration_id, "source_text")

    def get_source_link(self, declaration_id: int) -> dict | None:
        return self.get_field(declaration_id, "source_link")

    def get_docstring(self, declaration_id: int) -> dict | None:
        return self.get_field(declaration_id, "docstring")

    def get_description(self, declaration_id: int) -> dict | None:
        return self.get_field(declaration_id, "informalization")

    def get_module(self, declaration_id: int) -> dict | None:
        return self.get_field(declaration_id, "module")

    def get_dependencies(self, declaration_id: int) -> dict | None:
        return self.get_field(declaration_id, "dependencies")


def header(text: str | None) -> str | None:
    """The driver's twin of functions.text.bold_header, for one value."""
    if not text or not text.startswith("**"):
        return None
    end = text.find("**", 3)
    found = text[2:end] if end > 0 else ""
    return found if found and "\n" not in found else None


def rendered(answer: dict, shown: int = 5) -> str:
    """An answer as lines for a terminal, with the number of results that aren't shown."""
    rows = answer["results"]
    lines = [f"{k}. {r['name']}  {header(r.get('informalization')) or ''}".rstrip() for k, r in enumerate(rows[:shown], 1)]
    return "\n".join(lines + ([f"... {len(rows) - shown} more"] if len(rows) > shown else []) or ["no results"])
