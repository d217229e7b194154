"""The questions that a comparison answers, as plain values made of ranked, filtered and paged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.scoring import PRIORITY_MAXIMUM, PRIORITY_MODEL, RISK_MAXIMUM, RISK_MODEL, level_of_rank, level_rank
from ..operators import compare, edges, ranking
from . import impact
from .analysis import Analysis, diagnostic_order, scored, severity_counts, support_counts
from .reports import NAMES, diagnostic_view, plain, summary_counts

# What parameters accept, in the order that errors name them.
CLASSES = ("lockfile", "vendored", "generated", "test", "config", "docs", "source")
LEVELS, STATUSES = ("low", "medium", "high"), ("added", "removed", "modified", "unchanged")
SUGGESTED, CANDIDATES = 10, 5
REASONS = {"test_imports_module": "imports the changed module", "test_name_matches_module": "name matches the changed file"}
FILE_PARAMETERS = ("classification", "minimum_risk", "limit")
FUNCTION_PARAMETERS = ("file", "status", "classification", "minimum_risk", "min_complexity_delta", "include_unchanged", "limit")


class BadQuestion(ValueError):
    """A question that can't be answered as asked."""

    def __init__(self, message: str, code: str = "invalid_params"):
        super().__init__(message)
        self.code = code


def one_of(name: str, value: str | None, accepted: tuple[str, ...]) -> str | None:
    if value is not None and value not in accepted:
        raise BadQuestion(f"`{name}` must be one of {', '.join(accepted)}; received `{value}`")
    return value


def bounded(value: int | None, default: int, least: int, most: int) -> int:
    return default if value is None else min(max(value, least), most)


# ---- functions


def importer_counts(index: dict[str, DataFrame] | None) -> DataFrame | None:
    """path and direct_importers, None without an index."""
    return None if index is None else index["edge"].groupBy(F.col("target").alias("path")).agg(F.count_distinct("importer").cast("int").alias("direct_importers"))


def _metric(before: int | None, after: int | None) -> dict:
    return {k: v for k, v in (("before", before), ("after", after)) if v is not None} | {"delta": (after or 0) - (before or 0)}


def function_view(r: Row) -> dict:
    lines = lambda side: {"start_line": side.start_line, "end_line": side.end_line}
    return {
        "function_id": r.function_id,
        "file": r.path,
        "symbol": r.symbol,
        "qualified_name": r.qualified_name,
        "kind": r.kind,
        "status": r.status,
        "classification": r.classification,
        "metrics": {name: _metric(r.b and r.b[c], r.t and r.t[c]) for c, name in NAMES.items()},
        "change": {"changed_hunks": r.changed_hunks, "lines_added": r.lines_added, "lines_removed": r.lines_removed, "hunk_overlap": r.hunk_overlap},
        "risk": plain(r.risk),
        "review_priority": plain(r.review_priority),
        "match_confidence": r.confidence,
        "range": {k: lines(side) for k, side in (("before", r.b), ("after", r.t)) if side is not None},
    }


def _page(rows: DataFrame, order: list, limit: int, offset: int) -> tuple[list[Row], int]:
    return ranking.page(rows, order, limit, offset).collect(), rows.count()


def list_changed_functions(analysis: Analysis, index, applied: dict, offset: int) -> tuple[dict, int, int]:
    """Ranked functions: data, rows given and rows in all."""
    rows = ranking.select_functions(
        scored(analysis, importer_counts(index)), applied["file"], one_of("status", applied["status"], STATUSES), one_of("classification", applied["classification"], CLASSES),
        one_of("minimum_risk", applied["minimum_risk"], LEVELS), applied["min_complexity_delta"], applied["include_unchanged"],
    )
    found, total = _page(rows, ranking.function_order(["file_ix", "fn_ix"]), applied["limit"], offset)
    return {"functions": [function_view(r) for r in found]}, len(found), total


# ---- files


def impact_of(index: dict[str, DataFrame], wanted: DataFrame) -> dict[str, dict]:
    """What reaches each of a page's files (path): importers near and direct, and tests, by confidence and path."""
    near = index["edge"].select("importer", "target").distinct()
    one = near.join(wanted.select(F.col("path").alias("target")), "target", "left_semi").select(F.col("target").alias("path"), "importer")
    two = one.join(near.withColumnsRenamed({"importer": "next", "target": "importer"}), "importer").select("path", F.col("next").alias("importer"))
    direct = one.groupBy("path").agg(F.count("*").alias("direct"))
    nearby = one.union(two).distinct().filter("importer <> path").groupBy("path").agg(F.count("*").alias("nearby"))
    tests = edges.related_tests(near, index["file"].select("path")).join(wanted.select("path"), "path", "left_semi")
    listed = tests.groupBy("path").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("o"), F.col("test"), F.col("resolution")))).alias("tests"))
    out = {}
    for r in wanted.select("path").join(direct, "path", "left").join(nearby, "path", "left").join(listed, "path", "left").collect():
        view = {"direct_importers": r.direct or 0, "nearby_importers": r.nearby or 0}
        related = [{"file": t.test, "reason": REASONS[t.resolution], "confidence": -t.o} for t in r.tests or []]
        out[r.path] = view | ({"related_tests": related} if related else {})
    return out


def _complexity(rows: DataFrame, by: list[str]) -> DataFrame:
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long")
    sums = [total(f"{side}.{c}").alias(f"{c}_{when}") for c in ("cyclomatic", "cognitive", "source_loc") for side, when in (("b", "before"), ("t", "after"))]
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return rows.groupBy(*by).agg(*sums, *counts)


def _zero(model: str, maximum: int) -> dict:
    return {"model": model, "maximum_score": maximum, "score": 0, "level": "low", "reasons": []}


def file_rows(analysis: Analysis, rows: DataFrame) -> DataFrame:
    """Files with their complexity, the highest assessment of each model among changed functions, and their shape."""
    changed = F.col("status") != "unchanged"
    best = lambda what, score: F.max_by(F.when(changed, F.col(what)), F.when(changed, F.struct(score, -F.col("fn_ix"))))
    judged = rows.groupBy("file_ix").agg(best("risk", "risk_score").alias("risk"), best("review_priority", "priority_score").alias("review_priority"))
    totals = _complexity(rows, ["file_ix"])
    shapes = ranking.change_shape(rows.select("file_ix", "status", "cognitive_before", F.col("t.cognitive").alias("cognitive_after")), ["file_ix"])
    noticed = analysis.diagnostics.groupBy("file_ix").agg(*severity_counts(F.col("severity")))
    out = analysis.files
    for part in (judged, totals, shapes, noticed):
        out = out.join(part, "file_ix", "left")
    level = lambda c: F.coalesce(F.col(f"{c}.level"), F.lit("low"))
    return out.withColumns({"risk_level": level("risk"), "priority_level": level("review_priority"), "lines": F.col("added_lines") + F.col("removed_lines")})


def _complexity_view(r: Row) -> dict:
    out = {}
    for name in ("cyclomatic", "cognitive"):
        before, after = r[f"{name}_before"] or 0, r[f"{name}_after"] or 0
        out |= {f"{name}_before": before, f"{name}_after": after, f"{name}_delta": after - before}
    return out | {"source_loc_before": r.source_loc_before or 0, "source_loc_after": r.source_loc_after or 0}


def _noticed(r: Row) -> dict:
    return {k: r[k] or 0 for k in ("info", "warnings", "errors", "total")}


def file_view(r: Row, reach: dict[str, dict] | None) -> dict:
    out = {"path": r.path}
    if r.base_path is not None and r.base_path != r.target_path:
        out["renamed_from"] = r.base_path
    out |= {"status": r.status, "classification": r.classification}
    if r.language is not None:
        out["language"] = r.language
    out |= {
        "area": r.area,
        "lines": {"added": r.added_lines, "removed": r.removed_lines},
        "functions": {s: r[s] or 0 for s in STATUSES},
        "complexity": _complexity_view(r),
        "risk": plain(r.risk) if r.risk is not None else _zero(RISK_MODEL, RISK_MAXIMUM),
        "review_priority": plain(r.review_priority) if r.review_priority is not None else _zero(PRIORITY_MODEL, PRIORITY_MAXIMUM),
        "change_shape": r["shape"] or "other",
    }
    exports = {k: list(v) for k, v in (("added", r.exports_added), ("removed", r.exports_removed)) if v}
    out |= {"exports": exports} if exports else {}
    out |= {"impact": reach[r.path]} if reach is not None else {}
    return out | {"diagnostics": _noticed(r)}


def list_changed_files(analysis: Analysis, index, applied: dict, offset: int) -> tuple[dict, int, int]:
    rows = file_rows(analysis, scored(analysis, importer_counts(index)))
    wanted, least = one_of("classification", applied["classification"], CLASSES), one_of("minimum_risk", applied["minimum_risk"], LEVELS)
    if wanted is not None:
        rows = rows.filter(F.col("classification") == wanted)
    if least is not None:
        rows = rows.filter(level_rank(F.col("risk_level")) >= level_rank(F.lit(least)))
    found, total = _page(rows, [*ranking.file_order(), F.col("file_ix")], applied["limit"], offset)
    reach = None
    if index is not None:
        names = analysis.files.sparkSession.createDataFrame([(r.path,) for r in found], "path string")
        reach = impact_of(index, names)
    return {"files": [file_view(r, reach) for r in found]}, len(found), total


# ---- summary, detail, diagnostics


def areas(files: DataFrame) -> DataFrame:
    """Areas with files, lines, the highest levels and merged complexity."""
    top = lambda c: level_of_rank(F.max(level_rank(F.col(c))))
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c) for c in ("added_lines", "removed_lines", *(f"{n}_{w}" for n in ("cyclomatic", "cognitive", "source_loc") for w in ("before", "after")))]
    return files.groupBy("area").agg(F.count("*").alias("files"), *sums, top("risk_level").alias("risk_level"), top("priority_level").alias("priority_level"))


def get_change_summary(analysis: Analysis, index) -> dict:
    rows = scored(analysis, importer_counts(index))
    files, total = file_rows(analysis, rows), summary_counts(analysis)
    revision = lambda r: {"id": r[0], "display_name": r[1]}
    support = support_counts(analysis.files).first()
    classes = {r.classification: r.n for r in analysis.files.groupBy("classification").agg(F.count("*").alias("n")).collect()}
    counts = rows.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES]).first()
    best = ranking.page(ranking.select_functions(rows), ranking.function_order(["file_ix", "fn_ix"]), CANDIDATES).collect()
    found = total["diagnostics"]
    return {
        "base": revision(analysis.base),
        "target": revision(analysis.target),
        "files": {"changed": total["changed_files"], "supported": support.supported, "unsupported": support.unsupported, "by_classification": dict(sorted(classes.items()))},
        "lines": {"added": total["added_lines"], "removed": total["removed_lines"]},
        "functions": {s: counts[s] for s in STATUSES},
        "diagnostics": {"info": found["info"], "warnings": found["warning"], "errors": found["error"], "total": sum(found.values())},
        "change_areas": [
            {"name": a.area, "files": a.files, "lines": {"added": a.added_lines, "removed": a.removed_lines}, "risk": a.risk_level, "review_priority": a.priority_level, "complexity": _complexity_view(a)}
            for a in areas(files).orderBy(*ranking.area_order()).collect()
        ],
        "review_candidates": [
            {
                "function_id": r.function_id, "file": r.path, "symbol": r.symbol, "status": r.status, "complexity_delta": {"cyclomatic": r.cyclomatic_delta, "cognitive": r.cognitive_delta},
                "risk": r.risk_level, "review_priority": r.priority_level, "match_confidence": r.confidence,
            }
            for r in best
        ],
    }


def suggestions(ids: DataFrame, text: str, order: list, most: int = SUGGESTED) -> DataFrame:
    """Up to ``most`` rows of ``ids`` (function_id) that hold ``text``, in order; without any, the first ones."""
    hit = F.col("function_id").contains(text)
    some = ids.agg(F.bool_or(hit).alias("some"))
    # One row.
    return ids.crossJoin(F.broadcast(some)).filter(hit | ~F.coalesce("some", F.lit(False))).orderBy(*order).limit(most).select("function_id")


def closest_functions(analysis: Analysis, text: str) -> list[str]:
    return [r.function_id for r in suggestions(analysis.functions, text, ["file_ix", "fn_ix"]).collect()]


def get_function_change(analysis: Analysis, index, wanted: str) -> dict:
    row = scored(analysis, importer_counts(index)).filter(F.col("function_id") == wanted).orderBy("file_ix", "fn_ix").first()
    if row is None:
        known = closest_functions(analysis, wanted)
        said = f"it contains {', '.join(known)}" if known else "which contains no functions"
        raise BadQuestion(f"no function `{wanted}` in this analysis{';' if known else ','} {said}", "unknown_function")
    near = F.lit(False)
    for side, spans in ((row.b, "base"), (row.t, "target")):
        if side is not None:
            near = near | compare.nearby(F.lit(side.start_line), F.lit(side.end_line), F.col(f"{spans}_start"), F.col(f"{spans}_count"))
    hunks = analysis.hunks.filter((F.col("file_ix") == row.file_ix) & near).orderBy("hunk_ix").select("base_start", "base_count", "target_start", "target_count").collect()
    out = {"function": function_view(row), "hunks": [plain(h) for h in hunks]}
    if index is not None:
        out["impact"] = impact_of(index, analysis.files.sparkSession.createDataFrame([(row.path,)], "path string"))[row.path]
    said = analysis.diagnostics.filter((F.col("file_ix") == row.file_ix) & (F.col("related") == row.qualified_name)).orderBy(*diagnostic_order()).collect()
    return out | {"diagnostics": [diagnostic_view(d, place=False) for d in said]}


def get_analysis_diagnostics(analysis: Analysis, file: str | None) -> dict:
    rows = analysis.diagnostics if file is None else analysis.diagnostics.filter(F.col("path") == file)
    found = rows.orderBy("file_ix", *diagnostic_order()).collect()
    return {"diagnostics": [diagnostic_view(d, place=False) for d in found], "counts": _noticed(rows.agg(*severity_counts(F.col("severity"))).first())}


# ---- impact graph


def _stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].split(".", 1)[0]


def affinity(requested: str, path: str) -> tuple[bool, int]:
    """How near a changed path is to the one asked for: the same stem first, then the longest common ending in bytes."""
    same = 0
    for a, b in zip(reversed(requested.encode()), reversed(path.encode())):
        if a != b:
            break
        same += 1
    return _stem(path) == _stem(requested), same


def _unknown_file(analysis: Analysis, file: str) -> BadQuestion:
    known = [r.path for r in analysis.files.orderBy("file_ix").select("path").collect()]
    if not known:
        return BadQuestion(f"`file` must name a changed file: no `{file}` in this analysis, which changed no files")
    known.sort(key=lambda p: tuple(-int(x) for x in affinity(file, p)))
    more = f" and {len(known) - SUGGESTED} more" if len(known) > SUGGESTED else ""
    return BadQuestion(f"`file` must name a changed file: no `{file}` in this analysis, which changed {', '.join(known[:SUGGESTED])}{more}")


def _unknown_function(analysis: Analysis, wanted: str) -> BadQuestion:
    known = closest_functions(analysis, wanted)
    if not known:
        return BadQuestion(f"`function_id` must name a function in this analysis: no `{wanted}` in this analysis, which contains no functions")
    left = analysis.functions.count() - len(known)
    return BadQuestion(f"`function_id` must name a function in this analysis: no `{wanted}` in this analysis, which contains {', '.join(known)}{f' and {left} more' if left else ''}")


def graph_request(analysis: Analysis, params: dict) -> tuple[impact.Request, dict | None]:
    """A checked request and the root that an answer names."""
    file, wanted, root = params.get("file"), params.get("function_id"), None
    direction, view = one_of("direction", params.get("direction"), impact.DIRECTIONS) or "both", one_of("view", params.get("view"), impact.VIEWS) or "delta"
    if file is not None and wanted is not None:
        raise BadQuestion("`file` and `function_id` are mutually exclusive, and a graph has one center; name one changed `file` or one `function_id`, or neither to center the graph on every changed file")
    if wanted is not None:
        found = analysis.functions.filter(F.col("function_id") == wanted).select("path").first()
        if found is None:
            raise _unknown_function(analysis, wanted)
        root = {"kind": "function", "id": f"function:{wanted}", "path": found.path}
    elif file is not None:
        if analysis.files.filter(F.col("path") == file).isEmpty():
            raise _unknown_file(analysis, file)
        root = {"kind": "module", "id": f"module:{file}", "path": file}
    supported = impact.ops.SUPPORTED
    asked = params.get("relations") or [r for r in supported if r != "possible_call"]
    for name in asked:
        one_of("relations", name, supported)
    for name in params.get("render") or []:
        one_of("render", name, impact.RENDERINGS)
    return impact.Request(
        file, wanted, direction, tuple(r for r in supported if r in asked), bounded(params.get("depth"), 1, 1, 3), view,
        bounded(params.get("max_nodes"), 30, 3, 100), bounded(params.get("max_edges"), 60, 3, 200), tuple(r for r in impact.RENDERINGS if r in (params.get("render") or [])),
    ), root

