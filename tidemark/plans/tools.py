"""The questions as tools of a JSON-RPC server over lines: six tools that only read, each with a schema of its parameters."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

from . import answers, impact
from .answers import BadQuestion
from .session import PARAMETERS, VERSION

PROTOCOLS = ("2025-06-18", "2025-03-26", "2024-11-05")
COMPARISON = {"repository": "a path inside the repository; the server's folder if left out", "base": "the revision to compare from", "target": "the revision to compare to"}
GRAPH = ("file", "function_id", "direction", "relations", "depth", "view", "max_nodes", "max_edges", "render")
#: Tool, what it answers, its own parameters, and those that it can't do without.
TOOLS = (
    ("get_change_summary", "Counts, areas and the functions of a comparison that are worth a first look.", (), ()),
    ("get_impact_graph", "What a comparison reaches: modules, tests and calls around a changed file, a function or all that changed.", GRAPH, ()),
    ("list_changed_files", "Changed files, ranked, a page at a time.", (*answers.FILE_PARAMETERS, "cursor"), ()),
    ("list_changed_functions", "Changed functions, ranked, a page at a time.", (*answers.FUNCTION_PARAMETERS, "cursor"), ()),
    ("get_function_change", "One changed function in full, by the identity that a list gave.", ("function_id",), ("function_id",)),
    ("get_analysis_diagnostics", "What of a comparison could not be analysed.", ("file",), ()),
)
_KINDS = {str: "string", int: "integer", bool: "boolean", list: "array"}
_ACCEPTED = {"status": answers.STATUSES, "classification": answers.CLASSES, "minimum_risk": answers.LEVELS, "direction": impact.DIRECTIONS, "view": impact.VIEWS}
_ITEMS = {"relations": impact.ops.SUPPORTED, "render": impact.RENDERINGS}


def schema(parameters: tuple[str, ...], required: tuple[str, ...]) -> dict:
    """A JSON schema of the comparison and a tool's parameters; others are refused."""
    fields = {k: {"type": "string", "description": v} for k, v in COMPARISON.items()}
    for name in parameters:
        fields[name] = {"type": _KINDS[PARAMETERS[name]]}
        if name in _ACCEPTED:
            fields[name]["enum"] = list(_ACCEPTED[name])
        if name in _ITEMS:
            fields[name]["items"] = {"type": "string", "enum": list(_ITEMS[name])}
    return {"type": "object", "properties": fields, "required": ["base", "target", *required], "additionalProperties": False}


def listed() -> list[dict]:
    hints = {"readOnlyHint": True, "destructiveHint": False, "idempotentHint": True}
    return [{"name": n, "description": d, "inputSchema": schema(p, r), "annotations": hints} for n, d, p, r in TOOLS]


class ToolServer:
    """Answers requests one by one; ``answer`` takes method, repository, base, target and parameters."""

    def __init__(self, answer: Callable[..., dict], repository: str = "."):
        self.answer, self.repository = answer, repository

    def call(self, name: str, arguments: dict) -> dict:
        """A tool's result; a question that can't be answered is a result that says so."""
        own = {n: (p, r) for n, _, p, r in TOOLS}
        if name not in own:
            raise LookupError(f"unknown tool `{name}`")
        allowed, required = own[name]
        unknown, missing = sorted(set(arguments) - {*COMPARISON, *allowed}), [k for k in ("base", "target", *required) if k not in arguments]
        if unknown or missing or any(not isinstance(arguments.get(k, ""), str) for k in COMPARISON):
            raise LookupError(f"unknown field `{unknown[0]}`" if unknown else f"missing field `{missing[0]}`" if missing else "a comparison is made of strings")
        params = {k: v for k, v in arguments.items() if k not in COMPARISON}
        try:
            found = self.answer(name, arguments.get("repository", self.repository), arguments["base"], arguments["target"], params)
        except BadQuestion as e:
            found = {"error": {"code": e.code, "message": str(e)}}
        return {"content": [{"type": "text", "text": json.dumps(found, ensure_ascii=False)}], "structuredContent": found, "isError": "error" in found}

    def respond(self, request: dict) -> dict | None:
        """The response to one request, None for a notification."""
        method, params = request.get("method"), request.get("params") or {}
        if "id" not in request:
            return None
        head = {"jsonrpc": "2.0", "id": request["id"]}
        if method == "initialize":
            wanted = params.get("protocolVersion")
            return head | {"result": {"protocolVersion": wanted if wanted in PROTOCOLS else PROTOCOLS[0], "capabilities": {"tools": {}}, "serverInfo": {"name": "tidemark", "version": VERSION}}}
        if method == "ping":
            return head | {"result": {}}
        if method == "tools/list":
            return head | {"result": {"tools": listed()}}
        if method == "tools/call":
            try:
                return head | {"result": self.call(params.get("name"), params.get("arguments") or {})}
            except LookupError as e:
                return head | {"error": {"code": -32602, "message": str(e)}}
        return head | {"error": {"code": -32601, "message": f"unknown method `{method}`"}}

    def serve(self, lines: Iterable[str]) -> Iterator[str]:
        for line in lines:
            if line.strip():
                try:
                    request = json.loads(line)
                    response = self.respond(request) if isinstance(request, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "a request is an object"}}
                except ValueError:
                    response = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
                if response is not None:
                    yield json.dumps(response, ensure_ascii=False)
