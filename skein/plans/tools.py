"""The four tools of an index as plain functions over JSON-like arguments: search, list_indexes, reindex, health.

`serve` offers them as JSON-RPC messages, one a line. Each gives {"content": text, "structured": value, "is_error": bool}; wrong arguments and failures are error results, not exceptions."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import functions as F

from skein.functions.analysis import breadcrumb
from skein.functions.render import hit_lines, index_lines, reindex_line
from skein.plans.search import DEFAULT_TOP, SearchIndex


def _ok(content: str, structured=None) -> dict:
    return {"content": content, "structured": structured, "is_error": False}


def _error(content: str) -> dict:
    return {"content": content, "structured": None, "is_error": True}


def search(index: SearchIndex, arguments: dict) -> dict:
    name, query = arguments.get("index"), arguments.get("query")
    if not name or not query:
        return _error("index and query are required")
    top = arguments.get("top_n")
    hits = index.search(name, query, DEFAULT_TOP if top is None else int(top), arguments.get("syntax"), arguments.get("path_prefix"), bool(arguments.get("full_text", False)))
    hits = hits.persist()  # at most top_n rows, rendered twice
    try:
        lines = [r["rendered"] for r in hit_lines(hits, scores=False).orderBy("rank").collect()]
        rows = hits.select("location", breadcrumb(F.col("heading_path")).alias("heading"), "score", "text", "truncated", "frontmatter_json", "rank").orderBy("rank").collect()
    finally:
        hits.unpersist()
    structured = [{k: r[k] for k in ("location", "heading", "score", "text", "truncated")} | ({"frontmatter": json.loads(r["frontmatter_json"])} if r["frontmatter_json"] else {}) for r in rows]
    return _ok("\n\n".join(lines) or "no matches", {"hits": structured})


def list_indexes(index: SearchIndex, arguments: dict) -> dict:
    lines = [r["line"] for r in index_lines(index.list_indexes()).collect()]
    return _ok("\n".join(lines) or "no indexes configured")


def reindex(index: SearchIndex, arguments: dict) -> dict:
    """The named index, or all in the order of their names."""
    names = [arguments["index"]] if arguments.get("index") else sorted(index.stores)
    return _ok("\n".join(reindex_line(n, index.reindex(n)) for n in names) or "no indexes configured")


TOOLS = {"search": search, "list_indexes": list_indexes, "reindex": reindex, "health": list_indexes}


def call(index: SearchIndex, tool: str, arguments: dict | None = None) -> dict:
    if tool not in TOOLS:
        return _error(f"unknown tool: {tool}")
    try:
        return TOOLS[tool](index, arguments or {})
    except Exception as e:  # noqa: BLE001
        return _error(str(e).split("\n")[0])


_TEXT, _FLAG, _NUMBER = {"type": "string"}, {"type": "boolean"}, {"type": "integer", "minimum": 1}
ARGUMENTS = {
    "search": ({"index": _TEXT, "query": _TEXT, "top_n": _NUMBER, "syntax": {"type": "string", "enum": ["text", "raw", "vector", "hybrid"]}, "path_prefix": _TEXT, "full_text": _FLAG}, ["index", "query"]),
    "list_indexes": ({}, []),
    "reindex": ({"index": _TEXT}, []),
    "health": ({}, []),
}


def _answer(index: SearchIndex, method: str, params: dict) -> dict | None:
    if method == "initialize":
        return {"protocolVersion": params.get("protocolVersion") or "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "skein", "version": "1"}}
    if method == "ping":
        return {}
    if method == "tools/list":
        return {"tools": [{"name": n, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (p, r) in ARGUMENTS.items()]}
    if method == "tools/call":
        got = call(index, str(params.get("name")), params.get("arguments"))
        out = {"content": [{"type": "text", "text": got["content"]}], "isError": got["is_error"]}
        return out if got["structured"] is None else out | {"structuredContent": got["structured"]}
    return None


def serve(index: SearchIndex, lines: Iterable[str]) -> Iterator[str]:
    """The answers to JSON-RPC messages, in their order; notifications have none."""
    for line in lines:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
            method, params, key = message["method"], message.get("params") or {}, message.get("id")
        except (ValueError, KeyError, TypeError, AttributeError):
            yield json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not a request"}})
            continue
        if key is None:
            continue
        result = _answer(index, method, params)
        body = {"result": result} if result is not None else {"error": {"code": -32601, "message": f"unknown method: {method}"}}
        yield json.dumps({"jsonrpc": "2.0", "id": key} | body)
