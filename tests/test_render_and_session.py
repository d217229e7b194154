"""Texts of a small graph, cursors, caches and the line protocol."""

import json

import pytest

from tidemark.plans import render, session, tools
from tidemark.plans.answers import BadQuestion


def node(key, path, status, label=None, kind="module"):
    return {"id": path, "key": key, "path": path, "label": label or path.rsplit("/", 1)[-1], "status": status, "kind": kind}


def edge(a, b, relation, status, confidence=1.0):
    return {"from_id": a, "to_id": b, "relation": relation, "status": status, "confidence": confidence}


NODES = [node("n0", "t/a.spec.ts", "added"), node("n1", "src/old.ts", "removed"), node("n2", "src/a.ts", "modified"), node("n3", "src/b.ts", "unchanged"), node("n4", "src/lone.ts", "unchanged", 'x"y\n z' + "é" * 40)]
EDGES = [edge("t/a.spec.ts", "src/a.ts", "tested_by", "added", 0.9), edge("src/a.ts", "src/old.ts", "imports", "removed"), edge("src/a.ts", "src/b.ts", "imports", "unchanged"), edge("src/b.ts", "src/a.ts", "re_exports", "added"), edge("src/a.ts", "none", "imports", "added")]


def test_dependency_lines():
    assert render.dependency_lines(NODES, EDGES).splitlines() == ["+ t/a.spec.ts -[tested_by]-> src/a.ts", "- src/a.ts -> src/old.ts", "  src/a.ts -> src/b.ts", "+ src/b.ts -[re_exports]-> src/a.ts"]
    assert render.dependency_lines([], EDGES) == ""


def test_mermaid():
    text = render.mermaid(NODES, EDGES, [("c0", ["src/a.ts", "src/b.ts"]), ("c1", ["t/a.spec.ts"])]).splitlines()
    assert text[5:9] == ['    subgraph c0["cycle · 2 nodes"]', '        n2["a.ts · modified"]', '        n3["b.ts"]', "    end"]
    assert text[9:13] == ['    n0["a.spec.ts · added"] -. "~0.9" .-> n2', '    n2 -. "removed" .-> n1["old.ts · removed"]', "    n2 --> n3", '    n3 -- "re_exports" --> n2']
    assert text[13].startswith('    n4["xy z') and text[13].endswith('..."]') and text[-1] == "    class n4 unchanged"


def test_cursor_continues_its_question():
    token = session.encode_cursor("a1", "list_changed_files", {"limit": 10}, 20)
    assert session.decode_cursor(token, "a1", "list_changed_files", {"limit": None}) == ({"limit": 10}, 20)
    for bad in (("a2", "list_changed_files", {}), ("a1", "list_changed_functions", {}), ("a1", "list_changed_files", {"limit": 5})):
        with pytest.raises(session.BadCursor):
            session.decode_cursor(token, *bad)
    with pytest.raises(session.BadCursor):
        session.decode_cursor(token.upper(), "a1", "list_changed_files", {})
    assert session.analysis_id("a", "bc") != session.analysis_id("ab", "c") and len(session.analysis_id("", "")) == 32


def test_cache_keeps_the_newest(spark):
    cache, built = session.Cache(2), []

    def build(k):
        return lambda: built.append(k) or {"t": spark.range(k)}

    for k in (1, 2, 1, 3, 2):
        cache.get(k, build(k))
    assert built == [1, 2, 3, 2] and list(cache.held) == [3, 2]


def test_tools():
    def answer(method, repository, base, target, params):
        if params.get("limit") == 0:
            raise BadQuestion("no")
        return {"data": [method, repository, base, target, params]}

    server = tools.ToolServer(answer, "here")
    ask = lambda method, **params: {"jsonrpc": "2.0", "id": 1, "method": method, "params": params}
    call = lambda name, **arguments: ask("tools/call", name=name, arguments=arguments)
    requests = [
        ask("initialize", protocolVersion="2024-11-05"), {"jsonrpc": "2.0", "method": "notifications/initialized"}, ask("tools/list"), call("get_change_summary", base="a", target="b"), call("list_changed_files", base="a", target="b", limit=0),
        call("get_function_change", base="a", target="b"), call("list_changed_files", base="a", target="b", depth=1), call("nope", base="a", target="b"), ask("nope"), ask("ping"),
    ]
    out = [json.loads(x) for x in server.serve([json.dumps(r) for r in requests] + ["{", "[]"])]
    assert out[0]["result"]["protocolVersion"] == "2024-11-05" and len(out) == 11
    listed = {t["name"]: t for t in out[1]["result"]["tools"]}
    assert len(listed) == 6 and all(t["annotations"]["readOnlyHint"] for t in listed.values())
    assert listed["get_function_change"]["inputSchema"]["required"] == ["base", "target", "function_id"] and "enum" in listed["list_changed_functions"]["inputSchema"]["properties"]["status"]
    found = out[2]["result"]
    assert found["structuredContent"] == {"data": ["get_change_summary", "here", "a", "b", {}]} == json.loads(found["content"][0]["text"]) and not found["isError"]
    assert out[3]["result"]["isError"] and out[3]["result"]["structuredContent"]["error"]["code"] == "invalid_params"
    assert [x["error"]["code"] for x in (out[4], out[5], out[6], out[7], out[9], out[10])] == [-32602, -32602, -32602, -32601, -32700, -32600] and out[8]["result"] == {}
