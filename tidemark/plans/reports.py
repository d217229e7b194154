"""A whole analysis as a report for people or as one JSON document, and a graph answer as text."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Row
from pyspark.sql import functions as F

from .analysis import Analysis, diagnostic_order, severity_counts, support_counts

TOOL, VERSION, DOCUMENT_VERSION = "tidemark", "0.1.0", 1
PLACE = ("start_line", "start_column", "end_line", "end_column")
NAMES = {"physical_loc": "physical_loc", "source_loc": "source_loc", "cyclomatic": "cyclomatic_complexity", "cognitive": "cognitive_complexity"}


def plain(value):
    """Rows as dictionaries without what is null."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items() if v is not None}
    if isinstance(value, list):
        return [plain(v) for v in value]
    return value


def summary_counts(analysis: Analysis) -> dict:
    """Totals of files, lines and diagnostics."""
    lines = analysis.files.agg(F.count("*").alias("n"), F.coalesce(F.sum("added_lines"), F.lit(0)).alias("added"), F.coalesce(F.sum("removed_lines"), F.lit(0)).alias("removed")).first()
    support = support_counts(analysis.files).first()
    found = analysis.diagnostics.agg(*severity_counts(F.col("severity"))).first()
    return {
        "changed_files": lines.n,
        "added_lines": lines.added,
        "removed_lines": lines.removed,
        "supported_files": support.supported,
        "unsupported_files": support.unsupported,
        "diagnostics": {"info": found.info, "warning": found.warnings, "error": found.errors},
    }


def diagnostic_view(d: Row, place: bool = True) -> dict:
    out = {"code": d.code, "severity": d.severity, "message": d.message}
    if d.path is not None:
        out["path"] = d.path
    if place and d.range is not None:
        out["range"] = plain(d.range)
    if d.related is not None:
        out["related_entity_ids"] = [d.related]
    return out


def _files(analysis: Analysis) -> Iterator[Row]:
    """Files in order, each with its hunks, functions and diagnostics; a few at a time reach the driver."""
    nested = lambda d, *keys: d.groupBy("file_ix").agg(F.array_sort(F.collect_list(F.struct(*keys, F.struct(*[c for c in d.columns if c not in ("file_ix",)]).alias("row")))).alias("rows"))
    hunks = nested(analysis.hunks, "hunk_ix").withColumnRenamed("rows", "hunks")
    functions = nested(analysis.functions.drop("path"), "fn_ix").withColumnRenamed("rows", "functions")
    order = [c.alias(f"o{i}") for i, c in enumerate(diagnostic_order())]
    noticed = nested(analysis.diagnostics, *order).withColumnRenamed("rows", "diagnostics")
    rows = analysis.files
    for part in (hunks, functions, noticed):
        rows = rows.join(part, "file_ix", "left")
    return rows.orderBy("file_ix").toLocalIterator()


def _rows(nested) -> list[Row]:
    return [x.row for x in nested or []]


def _metrics(side: Row | None) -> dict | None:
    return None if side is None else {name: side[c] for c, name in NAMES.items()}


def _overlap(f: Row) -> float:
    length = (f.t or f.b).physical_loc
    return int(min(max(f.lines_added, f.lines_removed), length) / length * 100 + 0.5) / 100 if length else 0.0


def function_document(f: Row) -> dict:
    out = {"id": f.id, "status": f.status, "kind": f.kind, "qualified_name": f.qualified_name}
    for name, side in (("base_range", f.b), ("target_range", f.t)):
        if side is not None:
            out[name] = {c: side[c] for c in PLACE}
    for name, side in (("metrics_before", f.b), ("metrics_after", f.t)):
        if side is not None:
            out[name] = _metrics(side)
    if f.changed_hunks or f.lines_added or f.lines_removed:
        out["change"] = {"changed_hunks": f.changed_hunks, "lines_added": f.lines_added, "lines_removed": f.lines_removed, "hunk_overlap": _overlap(f)}
    return out | {"match_confidence": f.confidence, "diagnostics": []}


def _file_document(f: Row) -> dict:
    out = {k: f[k] for k in ("base_path", "target_path", "status", "language", "is_binary", "added_lines", "removed_lines") if f[k] is not None}
    out["hunks"] = [{k: h[k] for k in ("base_start", "base_count", "target_start", "target_count", "added_lines", "removed_lines")} for h in _rows(f.hunks)]
    out["functions"] = [function_document(x) for x in _rows(f.functions)]
    out |= {k: list(f[k]) for k in ("exports_added", "exports_removed") if f[k]}
    return out | {"diagnostics": [diagnostic_view(d) for d in _rows(f.diagnostics)]}


def document(analysis: Analysis) -> dict:
    """The complete analysis as plain values."""
    revision = lambda r: {"id": r[0], "display_name": r[1]}
    return {
        "schema_version": DOCUMENT_VERSION,
        "tool_version": VERSION,
        "repository": analysis.root,
        "base": revision(analysis.base),
        "target": revision(analysis.target),
        "summary": summary_counts(analysis),
        "files": [_file_document(f) for f in _files(analysis)],
        "diagnostics": [],
    }


def json_text(value) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False) + "\n"


def _shown(side: Row | None) -> str:
    return "-" if side is None else f"loc {side.physical_loc}/{side.source_loc}, cyclo {side.cyclomatic}, cognitive {side.cognitive}"


def human(analysis: Analysis) -> str:
    """One line for each changed file, function and diagnostic, after the totals."""
    total = summary_counts(analysis)
    out = [
        f"{TOOL} {analysis.base[1]}..{analysis.target[1]}",
        f"Repository: {analysis.root}",
        f"{total['changed_files']} changed files, +{total['added_lines']} -{total['removed_lines']} ({total['supported_files']} supported, {total['unsupported_files']} unsupported)",
    ]
    for f in _files(analysis):
        both = f.base_path is not None and f.target_path is not None and f.base_path != f.target_path
        out.append(f"{f.status} {f'{f.base_path} -> {f.target_path}' if both else f.path} (+{f.added_lines} -{f.removed_lines})")
        out += [f"  {x.status} {x.qualified_name} [{_shown(x.b)} -> {_shown(x.t)}]" for x in _rows(f.functions)]
        out += [f"  {d.severity} {d.code}: {d.message}" for d in _rows(f.diagnostics)]
    return "".join(line + "\n" for line in out)


def graph_text(answer: dict) -> str:
    """A graph answer for people: the comparison, its root, the dependency lines, and whether to draw it."""
    base, target = (answer["analysis"][x]["display_name"] for x in ("base", "target"))
    root, seen = answer["data"]["root"], answer["data"]["visualization"]
    named = "none (centered on the changed set)" if root is None else root["id"] if root["kind"] == "function" else root["path"]
    out = [f"{TOOL} {base}..{target}", f"Root: {named}"]
    lines = answer["data"]["dependency_diff"].rstrip("\n")
    if lines:
        out.append(lines)
    out.append("Diagram: recommended" if seen["recommended"] else "Diagram: not recommended")
    out += [f"  {r['code']}: {r['message']}" for r in seen["reasons"]]
    return "".join(line + "\n" for line in out)
