"""A comparison end to end: analysis, reports, questions, graphs, the line protocol and the command line."""

import json

import pytest

from tests.repos import repository, sample
from tidemark import __main__ as command
from tidemark.plans import reports
from tidemark.plans.answers import BadQuestion, affinity
from tidemark.plans.session import LineServer, Session, checked


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    return sample(tmp_path_factory.mktemp("sample") / "r")


@pytest.fixture(scope="module")
def session(spark):
    return Session(spark)


@pytest.fixture(scope="module")
def ask(session, repo):
    return lambda method, **params: session.answer(method, *repo, params)


def test_document_and_report(ask, session, repo):
    data = ask("analyze")["data"]
    assert data["summary"] == {"changed_files": 12, "added_lines": 28, "removed_lines": 16, "supported_files": 10, "unsupported_files": 2, "diagnostics": {"info": 2, "warning": 2, "error": 1}}
    files = {f.get("target_path"): f for f in data["files"]}
    assert list(files) == sorted(files)
    assert [f["id"] for x in data["files"] for f in x["functions"]] == [f"function-{i + 1}" for i in range(13)]
    util = files["src/util.ts"]
    assert [(f["qualified_name"], f["status"], "metrics_before" in f, "metrics_after" in f) for f in util["functions"]] == [("old", "removed", True, False), ("score", "added", False, True), ("helper", "unchanged", True, True)]
    assert util["exports_added"] == ["score"] and util["exports_removed"] == ["old"] and "change" not in util["functions"][2]
    assert util["functions"][0]["change"] == {"changed_hunks": 1, "lines_added": 0, "lines_removed": 2, "hunk_overlap": 0.67}
    assert util["functions"][1]["metrics_after"] == {"physical_loc": 3, "source_loc": 3, "cyclomatic_complexity": 2, "cognitive_complexity": 1}
    assert files["image.bin"]["status"] == "binary" and files["src/app.ts"]["hunks"][0]["base_start"] == 1
    dups = [f for f in files["src/app.ts"]["functions"] if f["qualified_name"] == "dup"]
    assert [(f["status"], f["match_confidence"]) for f in dups] == [("unchanged", 0.9)] * 2
    assert {d["code"]: d["severity"] for f in data["files"] for d in f["diagnostics"]} == {"unsupported_language": "info", "binary_file": "info", "ambiguous_function_match": "warning", "malformed_source": "warning", "invalid_utf8": "error"}
    text = reports.human(session.analysis(*repo)).splitlines()
    assert text[2] == "12 changed files, +28 -16 (10 supported, 2 unsupported)"
    assert "  added deep [- -> loc 10/10, cyclo 6, cognitive 11]" in text and "binary image.bin (+0 -0)" in text
    assert reports.json_text(reports.document(session.analysis(*repo))) == reports.json_text(data)


def test_summary(ask):
    data = ask("get_change_summary")["data"]
    assert data["files"] == {"changed": 12, "supported": 10, "unsupported": 2, "by_classification": {"docs": 1, "source": 11}}
    assert data["functions"] == {"added": 2, "removed": 1, "modified": 6, "unchanged": 4}
    assert [(a["name"], a["files"], a["review_priority"]) for a in data["change_areas"]] == [("src", 10, "high"), ("<root>", 2, "low")]
    assert data["change_areas"][0]["complexity"]["cognitive_delta"] == 12
    assert [c["symbol"] for c in data["review_candidates"]][:3] == ["fn:old", "fn:deep", "fn:score"]


def test_files_page_by_page(ask):
    seen, cursor, pages = [], None, 0
    while True:
        got = ask("list_changed_files", limit=5, **({"cursor": cursor} if cursor else {}))
        seen += [f["path"] for f in got["data"]["files"]]
        cursor, pages = got["page"]["next_cursor"], pages + 1
        if not got["page"]["has_more"]:
            break
    assert cursor is None and pages == 3 and len(seen) == len(set(seen)) == got["page"]["total"] == 12
    util = ask("list_changed_files", limit=1)["data"]["files"][0]
    assert util["impact"] == {"direct_importers": 7, "nearby_importers": 8} and util["exports"] == {"added": ["score"], "removed": ["old"]}
    assert util["review_priority"]["score"] == 5 and [r["code"] for r in util["review_priority"]["reasons"]] == ["export_removed", "containing_module_direct_importers", "production_source"]
    assert [f["path"] for f in ask("list_changed_files", classification="docs")["data"]["files"]] == ["README.md"]


def test_functions_and_detail(ask):
    rows = ask("list_changed_functions", status="modified")["data"]["functions"]
    assert {r["qualified_name"] for r in rows} == {"run", *(f"use{i}" for i in range(5))}
    assert ask("list_changed_functions", status="unchanged")["page"]["total"] == 0
    assert ask("list_changed_functions", status="unchanged", include_unchanged=True, file="src/app.ts")["page"]["total"] == 3
    assert [r["qualified_name"] for r in ask("list_changed_functions", min_complexity_delta=5)["data"]["functions"]] == ["deep"]
    app = ask("get_function_change", function_id="src/app.ts#fn:run@target:7:7")["data"]
    assert app["hunks"] == [{"base_start": 9, "base_count": 1, "target_start": 9, "target_count": 2}] and app["diagnostics"] == []
    assert app["impact"]["related_tests"] == [{"file": "tests/app.spec.ts", "reason": "imports the changed module", "confidence": 0.9}]
    dup = ask("get_function_change", function_id="src/app.ts#arrow:dup@target:12:13")["data"]
    assert dup["function"]["match_confidence"] == 0.9 and [d["code"] for d in dup["diagnostics"]] == ["ambiguous_function_match"]
    with pytest.raises(BadQuestion, match=r"src/app.ts#fn:run@target:7:7") as e:
        ask("get_function_change", function_id="fn:run")
    assert e.value.code == "unknown_function"


def test_diagnostics(ask):
    assert ask("get_analysis_diagnostics")["data"]["counts"] == {"info": 2, "warnings": 2, "errors": 1, "total": 5}
    one = ask("get_analysis_diagnostics", file="src/app.ts")["data"]
    assert [d["related_entity_ids"] for d in one["diagnostics"]] == [["dup"]] and one["counts"]["total"] == 1


def edges_of(answer):
    short = lambda x: x.split(":", 1)[1].split("@")[0]
    return {(short(e["from"]), e["relation"], short(e["to"]), e["status"], e["resolution"]) for e in answer["data"]["graph"]["edges"]}


def test_module_graph(ask):
    got = ask("get_impact_graph", file="src/util.ts", render=["diff", "mermaid"])
    near = {(f"src/near{i}.ts", "imports", "src/util.ts", "unchanged", "resolved_specifier") for i in range(5)}
    found = edges_of(got)
    assert near <= found and ("src/app.ts", "imports", "src/util.ts", "added", "resolved_specifier") in found
    assert {e for e in found if e[1] in ("tested_by", "re_exports")} == {("tests/app.spec.ts", "tested_by", "src/app.ts", "unchanged", "test_imports_module"), ("src/barrel.ts", "re_exports", "src/util.ts", "unchanged", "export_clause")}
    data = got["data"]
    assert "+ src/app.ts -> src/util.ts\n" in data["dependency_diff"] and data["mermaid"].startswith("flowchart LR\n")
    assert data["visualization"]["recommended"] and data["root"] == {"kind": "module", "id": "module:src/util.ts", "path": "src/util.ts"}
    assert data["completeness"]["unresolved_specifiers"] == 0 and not data["graph"]["truncated"]
    one = next(e for e in data["graph"]["edges"] if e["from"] == "module:src/barrel.ts" and e["relation"] == "imports")
    assert one["evidence"] == {"file": "src/barrel.ts", "line": 2}
    base = edges_of(ask("get_impact_graph", file="src/util.ts", view="base", relations=["imports"]))
    assert not any(e[3] == "added" for e in base)


def test_graph_within_a_budget(ask):
    data = ask("get_impact_graph", file="src/util.ts", relations=["imports"], max_nodes=4)["data"]
    groups = [n for n in data["graph"]["nodes"] if n["kind"] == "group"]
    assert [(g["label"], g["group"]) for g in groups] == [("5 callers · src", {"size": 5, "role": "callers"})]
    assert data["graph"]["omitted"]["nodes"] == 5 and data["graph"]["reasons"] == ["max_nodes"] and len(data["graph"]["nodes"]) == 4


def test_function_graph(ask):
    got = ask("get_impact_graph", function_id="src/app.ts#fn:run@target:7:7", depth=1)
    assert edges_of(got) == {
        ("src/app.ts#fn:run", "calls", "src/app.ts#fn:helper", "unchanged", "direct_local_symbol"),
        ("src/app.ts#fn:run", "calls", "src/legacy.ts#fn:legacy", "unchanged", "re_exported_symbol"),
        ("src/app.ts#fn:run", "calls", "src/util.ts#fn:old", "added", "imported_symbol"),
        ('tests/app.spec.ts#arrow:test("runs").<anonymous>#1', "calls", "src/app.ts#fn:run", "unchanged", "imported_symbol"),
        ("src/app.ts", "contains", "src/app.ts#fn:helper", "unchanged", "declaration"),
        ("src/app.ts", "contains", "src/app.ts#fn:run", "unchanged", "declaration"),
    }
    score = edges_of(ask("get_impact_graph", function_id="src/util.ts#fn:score@target:1:7", relations=["calls"]))
    assert score == {(f"src/near{i}.ts#fn:use{i}", "calls", "src/util.ts#fn:score", "added", "imported_symbol") for i in range(5)} | {("src/app.ts#fn:run", "calls", "src/util.ts#fn:score", "added", "imported_symbol")}


def test_bad_questions(ask, session, repo):
    for params, message in (
        ({"file": "src/Util.ts"}, "`file` must name a changed file: no `src/Util.ts` in this analysis, which changed src/util.ts, "),
        ({"file": "a", "function_id": "b"}, "mutually exclusive"),
        ({"relations": ["extends"]}, "`relations` must be one of imports, tested_by, calls, contains, re_exports, possible_call; received `extends`"),
        ({"render": ["svg"]}, "`render` must be one of diff, mermaid; received `svg`"),
        ({"view": "both"}, "`view` must be one of delta, base, target; received `both`"),
        ({"cursor": "ab"}, "`cursor` is only accepted by"),
        ({"colour": 1}, "unknown field `colour`"),
        ({"depth": "1"}, "`depth` has a value of the wrong type"),
    ):
        with pytest.raises(BadQuestion) as e:
            ask("get_impact_graph", **params)
        assert message in str(e.value) and e.value.code == "invalid_params"
    with pytest.raises(BadQuestion, match="minimum_risk"):
        ask("list_changed_files", minimum_risk="huge")
    assert affinity("lib/util.ts", "src/util.spec.ts")[0] and affinity("a/util.ts", "b/util.ts") == (True, len("/util.ts"))
    assert checked({"file": None, "limit": 3}) == {"limit": 3}


def test_lines_and_command(session, repo, capsys):
    root, base, target = repo
    wire = {"protocol_version": 2, "id": "7", "repository": root, "base": base, "target": target}
    lines = [json.dumps(x) for x in (wire | {"method": "get_analysis_diagnostics"}, wire | {"method": "nope"}, wire | {"protocol_version": 1}, wire | {"extra": 1}, wire | {"base": "no-such"}, wire | {"params": {"limit": "x"}})] + ["{", ""]
    out = [json.loads(x) for x in LineServer(session.answer).serve(lines)]
    assert [x["error"]["code"] if "error" in x else "ok" for x in out] == ["ok", "unknown_method", "unsupported_protocol_version", "malformed_request", "analysis_failed", "malformed_request", "malformed_request"]
    assert out[0]["result"] == session.answer("get_analysis_diagnostics", *repo) and "id" not in out[-1] and out[3]["id"] == "7"
    assert command.main([base, target, "--repository", root], session) == 0
    assert "12 changed files" in capsys.readouterr().out
    assert command.main(["graph", base, target, "--repository", root, "--file", "src/util.ts", "--relations", "imports"], session) == 0
    said = capsys.readouterr().out.splitlines()
    assert said[1] == "Root: src/util.ts" and "+ src/app.ts -> src/util.ts" in said and "Diagram: recommended" in said
    assert command.main(["no-such", target, "--repository", root], session) == 1
    with pytest.raises(SystemExit) as e:
        command.main([base], session)
    assert e.value.code == 2


def test_sessions_reuse_what_they_read(spark, session, repo, tmp_path, monkeypatch):
    from tidemark.plans import session as module

    monkeypatch.setattr(module, "analyze", None)
    monkeypatch.setattr(module.symbols, "import_index", None)
    assert session.analysis(*repo).files.count() == 12
    assert session.index(repo[0], session.analysis(*repo).target[0]) is session.index(repo[0], session.analysis(*repo).target[0])


def test_symbols_grow(spark, repo):
    from tidemark.sources import symbols

    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    one = symbols.symbol_index(spark, repo[0], repo[2], paths("src/util.ts", "README.md", "none.ts"))
    assert [r.path for r in one.collect()] == ["src/util.ts"]
    two = symbols.extend_symbols(spark, repo[0], repo[2], one, paths("src/util.ts", "src/app.ts"))
    assert sorted(r.path for r in two.collect()) == ["src/app.ts", "src/util.ts"] and symbols.extend_symbols(spark, repo[0], repo[2], two, paths("src/app.ts")) is two


def test_renames_and_nothing(spark, session, tmp_path):
    before = "export function untouched(a) {\n  return a;\n}\nexport function edited(a) {\n  return a + 1;\n}\n"
    made = repository(tmp_path / "r", {"src/before.ts": before, "gone.ts": "const a = () => 1;\n"}, {"src/before.ts": None, "src/after.ts": before.replace("a + 1", "a + 2"), "gone.ts": None})
    files = {f.get("target_path"): f for f in session.answer("analyze", *made)["data"]["files"]}
    renamed = files["src/after.ts"]
    assert (renamed["status"], renamed["base_path"], renamed["added_lines"], renamed["removed_lines"]) == ("renamed", "src/before.ts", 1, 1)
    assert [(f["qualified_name"], f["status"]) for f in renamed["functions"]] == [("untouched", "unchanged"), ("edited", "modified")]
    assert files[None]["status"] == "deleted" and files[None]["functions"][0]["status"] == "removed"
    same = session.answer("analyze", made[0], made[1], made[1])["data"]
    assert same["files"] == [] and same["summary"]["changed_files"] == 0
    assert session.answer("get_impact_graph", made[0], made[1], made[1])["data"]["graph"]["nodes"] == []
