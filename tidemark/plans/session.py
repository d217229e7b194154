"""Sessions over comparisons: identifiers, cursors, bounded caches, the answer envelope, and a line protocol."""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..sources import symbols
from ..sources.git import GitError, Repository
from . import answers, impact, reports
from .analysis import Analysis, analyze
from .answers import BadQuestion, bounded

VERSION, SCHEMA_VERSION, PROTOCOL = reports.VERSION, 2, 2
METHODS = ("analyze", "get_change_summary", "list_changed_files", "list_changed_functions", "get_function_change", "get_analysis_diagnostics", "get_impact_graph")
LISTS = {"list_changed_files": answers.FILE_PARAMETERS, "list_changed_functions": answers.FUNCTION_PARAMETERS}
# Every parameter with its type, the sizes of caches, the parameters of the 128-bit FNV-1a hash.
PARAMETERS = {
    "file": str, "function_id": str, "status": str, "classification": str, "minimum_risk": str, "min_complexity_delta": int, "include_unchanged": bool, "limit": int, "cursor": str,
    "direction": str, "relations": list, "depth": int, "view": str, "max_nodes": int, "max_edges": int, "render": list,
}
MAX_ANALYSES, MAX_FUNCTIONS, MAX_INDEXES = 4, 200_000, 8
DEFAULT_LIMIT, MAX_LIMIT = 50, 200
_BASIS, _PRIME = 0x6C62272E07BB014262B821756295C58D, 0x0000000001000000000000000000013B


def analysis_id(base: str, target: str, version: str = VERSION, schema: int = SCHEMA_VERSION) -> str:
    """32 hex digits for a comparison; fields are hashed with their lengths before them."""
    fields = [base.encode(), target.encode(), version.encode(), schema.to_bytes(4, "little")]
    h = _BASIS
    for byte in b"".join(len(f).to_bytes(8, "little") + f for f in fields):
        h = (h ^ byte) * _PRIME % (1 << 128)
    return f"{h:032x}"


class BadCursor(BadQuestion):
    """A cursor that can't be read or belongs to another question."""


def encode_cursor(analysis: str, method: str, params: dict, offset: int) -> str:
    payload = {"schema_version": SCHEMA_VERSION, "analysis": analysis, "query": {"method": method, **params}, "offset": offset}
    return json.dumps(payload, sort_keys=True, separators=(",", ":")).encode().hex()


def decode_cursor(token: str, analysis: str, method: str, params: dict) -> tuple[dict, int]:
    """The applied parameters and offset of a cursor that continues this very question; parameters left out follow the cursor."""
    try:
        if token != token.lower():
            raise ValueError
        found = json.loads(bytes.fromhex(token))
        query, offset = dict(found["query"]), int(found["offset"])
        issued = query.pop("method")
    except (ValueError, KeyError, TypeError) as e:
        raise BadCursor("`cursor` is not a cursor this server issued") from e
    if found.get("schema_version") != SCHEMA_VERSION:
        raise BadCursor(f"`cursor` was issued under schema version {found.get('schema_version')}; this server answers in version {SCHEMA_VERSION}")
    if found.get("analysis") != analysis:
        raise BadCursor(f"`cursor` was issued for analysis `{found.get('analysis')}`, not `{analysis}`")
    if issued != method:
        raise BadCursor(f"`cursor` was issued for another method; {method} cannot continue it")
    for k, v in params.items():
        if v is not None and query.get(k) != v:
            raise BadCursor(f"`{k}` does not match the query `cursor` continues; a cursor continues one query, so start a new page without it to ask something else")
    return query, offset


class Cache:
    """Least recently used values by key, bounded in number and weight; the newest always stays."""

    def __init__(self, entries: int, weight: int | None = None):
        self.entries, self.weight, self.held = entries, weight, OrderedDict()

    def find(self, key):
        if key in self.held:
            self.held.move_to_end(key)
            return self.held[key][0]
        return None

    def put(self, key, value, weight: int = 0):
        self.held.pop(key, None)
        self.held[key] = (value, weight)
        while len(self.held) > 1 and (len(self.held) > self.entries or self.weight is not None and sum(w for _, w in self.held.values()) > self.weight):
            self.held.popitem(last=False)
        return value

    def get(self, key, build: Callable[[], object], weigh: Callable[[object], int] = lambda value: 0):
        found = self.find(key)
        if found is None:
            found = build()
            self.put(key, found, weigh(found))
        return found


def checked(params) -> dict:
    """Parameters by name, none unknown and each of its type; null is as good as left out."""
    if not isinstance(params, dict):
        raise BadQuestion("invalid query parameters: an object is expected")
    for k, v in params.items():
        if k not in PARAMETERS:
            raise BadQuestion(f"invalid query parameters: unknown field `{k}`, expected one of {', '.join(PARAMETERS)}")
        kind = PARAMETERS[k]
        good = v is None or (isinstance(v, kind) and (kind is bool or not isinstance(v, bool)))
        if not good or (kind is list and v is not None and not all(isinstance(x, str) for x in v)) or (k in ("limit", "depth", "max_nodes", "max_edges") and v is not None and v < 0):
            raise BadQuestion(f"invalid query parameters: `{k}` has a value of the wrong type")
    return {k: v for k, v in params.items() if v is not None}


class Session:
    """Answers questions about comparisons; what one answer reads the next finds again.

    Tables are kept by commits, which don't change, never by revision names.
    Symbol tables grow to the files that a further question admits.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.analyses, self.indexes, self.parsed = Cache(MAX_ANALYSES, MAX_FUNCTIONS), Cache(MAX_INDEXES), Cache(MAX_INDEXES)

    def analysis(self, repository: str, base: str, target: str) -> Analysis:
        repo = Repository.open(repository)
        key = repo.root, repo.resolve(base), repo.resolve(target)
        return self.analyses.get(key, lambda: analyze(self.spark, repo.root, base, target), lambda a: a.functions.count())

    def index(self, root: str, commit: str) -> dict[str, DataFrame]:
        return self.indexes.get((root, commit), lambda: symbols.import_index(self.spark, root, commit))

    def symbols(self, root: str, commit: str, admitted: DataFrame) -> DataFrame:
        known = self.parsed.find((root, commit))
        if known is None:
            found = symbols.symbol_index(self.spark, root, commit, admitted)
        else:
            found = symbols.extend_symbols(self.spark, root, commit, known, admitted)
        return self.parsed.put((root, commit), found)

    def revisions(self, analysis: Analysis) -> impact.Revisions:
        root, (a, _), (b, _) = analysis.root, analysis.base, analysis.target
        base, target = self.index(root, a), self.index(root, b)
        admitted = impact.admitted(analysis, base["edge"], target["edge"])
        return impact.revisions(base, target, self.symbols(root, a, admitted), self.symbols(root, b, admitted))

    def answer(self, method: str | None, repository: str, base: str, target: str, params: dict | None = None) -> dict:
        """The envelope that every transport sends: which analysis, what was asked, what was found, and its page."""
        method = method or "analyze"
        if method not in METHODS:
            raise BadQuestion(f"unknown method `{method}`; expected {', '.join(METHODS[:-1])}, or {METHODS[-1]}", "unknown_method")
        given = checked(params or {})
        try:
            analysis = self.analysis(repository, base, target)
        except GitError as e:
            raise BadQuestion(str(e), "analysis_failed") from e
        key = analysis_id(analysis.base[0], analysis.target[0])
        if "cursor" in given and method not in LISTS:
            raise BadQuestion("`cursor` is only accepted by list_changed_files and list_changed_functions")
        revision = lambda r: {"id": r[0], "display_name": r[1]}
        head = {"id": key, "schema_version": SCHEMA_VERSION, "tool_version": VERSION, "base": revision(analysis.base), "target": revision(analysis.target)}
        return {"analysis": head} | self._project(method, analysis, given, key)

    def _project(self, method: str, analysis: Analysis, params: dict, key: str) -> dict:
        if method == "analyze":
            return {"query": {}, "data": reports.document(analysis)}
        if method == "get_analysis_diagnostics":
            return {"query": {"file": params.get("file")}, "data": answers.get_analysis_diagnostics(analysis, params.get("file"))}
        if method == "get_impact_graph":
            request, root = answers.graph_request(analysis, params)
            graph = impact.build(analysis, self.revisions(analysis), request)
            echo = {"file": request.file, "function_id": request.function_id, "direction": request.direction, "relations": list(request.relations), "depth": request.depth, "view": request.view, "max_nodes": request.max_nodes, "max_edges": request.max_edges, "render": list(request.render)}
            return {"query": echo, "data": impact.answer(graph, request, root)}
        if method == "get_function_change" and "function_id" not in params:
            raise BadQuestion("`function_id` is required")
        index = self.index(analysis.root, analysis.target[0])
        if method == "get_change_summary":
            return {"query": {}, "data": answers.get_change_summary(analysis, index)}
        if method == "get_function_change":
            return {"query": {"function_id": params["function_id"]}, "data": answers.get_function_change(analysis, index, params["function_id"])}
        return self._list(method, analysis, index, params, key)

    def _list(self, method: str, analysis: Analysis, index, params: dict, key: str) -> dict:
        names = LISTS[method]
        asked = {k: params.get(k) for k in names}
        if "limit" in params:
            asked["limit"] = bounded(params["limit"], DEFAULT_LIMIT, 1, MAX_LIMIT)
        if "cursor" in params:
            applied, offset = decode_cursor(params["cursor"], key, method, asked)
        else:
            applied, offset = asked | {"limit": asked["limit"] or DEFAULT_LIMIT}, 0
            if "include_unchanged" in applied:
                applied["include_unchanged"] = bool(applied["include_unchanged"])
        data, returned, total = getattr(answers, method)(analysis, index, applied, offset)
        more = offset + returned < total
        page = {"returned": returned, "total": total, "has_more": more, "next_cursor": encode_cursor(key, method, applied, offset + returned) if more else None}
        return {"query": applied, "data": data, "page": page}


@dataclass
class LineServer:
    """One JSON request a line, one JSON response a line, in order; a bad line never ends the loop.

    ``answer`` takes method, repository, base, target and parameters.
    """

    answer: Callable[[str | None, str, str, str, dict | None], dict]
    served: int = field(default=0, init=False)

    def respond(self, line: str) -> dict:
        key = None
        try:
            request = json.loads(line)
            if isinstance(request, dict) and isinstance(request.get("id"), str):
                key = request["id"]
            fields = {"protocol_version": int, "id": str, "repository": str, "base": str, "target": str}
            if not isinstance(request, dict) or set(request) - {*fields, "method", "params"} or any(not isinstance(request.get(k), t) for k, t in fields.items()):
                raise ValueError("a request has protocol_version, id, repository, base and target, and may have method and params")
            checked(request.get("params") or {})
        except ValueError as e:
            return self._error(key, "malformed_request", f"invalid request: {e}")
        if request["protocol_version"] != PROTOCOL:
            return self._error(key, "unsupported_protocol_version", f"unsupported protocol version {request['protocol_version']}; expected {PROTOCOL}")
        try:
            found = self.answer(request.get("method"), request["repository"], request["base"], request["target"], request.get("params"))
        except BadQuestion as e:
            return self._error(key, e.code, str(e))
        return {"protocol_version": PROTOCOL, "id": key, "result": found}

    def _error(self, key: str | None, code: str, message: str) -> dict:
        return {"protocol_version": PROTOCOL} | ({"id": key} if key is not None else {}) | {"error": {"code": code, "message": message}}

    def serve(self, lines: Iterable[str]) -> Iterator[str]:
        for line in lines:
            line = line.rstrip("\n").removesuffix("\r")
            if line:
                self.served += 1
                yield json.dumps(self.respond(line), ensure_ascii=False)
