"""The tools as a JSON-RPC service over lines (standard input and output), as assistants call it."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from typing import TextIO

from quillon.plans.tools import Tools

_SEARCH = {"query": {"type": "string"}, "limit": {"type": "integer"}, "rerank_top": {"type": "integer"}, "packages": {"type": "array", "items": {"type": "string"}}}
_ID = {"declaration_id": {"type": "integer"}}
#: name: (what it does, arguments, those that must be there)
TOOLS: dict[str, tuple[str, dict, list[str]]] = {
    "search": ("Search declarations; all fields.", _SEARCH, ["query"]),
    "search_summary": ("Search declarations; ids, names and headers.", _SEARCH, ["query"]),
    "get_source_code": ("A declaration's source text.", _ID, ["declaration_id"]),
    "get_source_link": ("A declaration's link.", _ID, ["declaration_id"]),
    "get_docstring": ("A declaration's docstring.", _ID, ["declaration_id"]),
    "get_description": ("A declaration's description.", _ID, ["declaration_id"]),
    "get_module": ("A declaration's module.", _ID, ["declaration_id"]),
    "get_dependencies": ("What a declaration depends on.", _ID, ["declaration_id"]),
}


def _called(tools: Tools, params: dict) -> dict:
    name, arguments = params.get("name"), params.get("arguments") or {}
    if name not in TOOLS:
        raise KeyError(f"no tool {name}")
    _, known, needed = TOOLS[name]
    if set(arguments) - set(known) or set(needed) - set(arguments):
        raise ValueError(f"{name} takes {', '.join(known)}")
    return {"content": [{"type": "text", "text": json.dumps(getattr(tools, name)(**arguments))}]}


def _listed(tools: Tools, params: dict) -> dict:
    return {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]}


def _begun(tools: Tools, params: dict) -> dict:
    return {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "quillon", "version": "1"}}


METHODS: dict[str, Callable[[Tools, dict], dict]] = {"initialize": _begun, "tools/list": _listed, "tools/call": _called, "ping": lambda tools, params: {}}


def answer(tools: Tools, line: str) -> dict | None:
    """The answer to one request; None to a notification."""
    try:
        asked = json.loads(line)
    except ValueError:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
    if "id" not in asked:
        return None
    head = {"jsonrpc": "2.0", "id": asked["id"]}
    if asked.get("method") not in METHODS:
        return head | {"error": {"code": -32601, "message": f"no method {asked.get('method')}"}}
    try:
        return head | {"result": METHODS[asked["method"]](tools, asked.get("params") or {})}
    except Exception as e:  # a failed call is an answer, not the service's end
        return head | {"error": {"code": -32000, "message": str(e).splitlines()[0] if str(e) else type(e).__name__}}


def serve(tools: Tools, lines: Iterable[str], out: TextIO) -> None:
    for line in lines:
        if line.strip() and (a := answer(tools, line)) is not None:
            out.write(json.dumps(a) + "\n")
            out.flush()
