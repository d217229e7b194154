"""The graph that a change reaches, from a changed file, a function or all that changed, cut to what an answer holds."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..operators import edges as links
from ..operators import impact as ops
from ..operators.durable import durable
from ..operators.edges import CONFIDENCE
from ..sources import symbols
from . import render
from .analysis import Analysis, function_id, symbol_id

VIEWS, DIRECTIONS, RENDERINGS = ("delta", "base", "target"), ("upstream", "downstream", "both"), ("diff", "mermaid")
PLACE = ("start_line", "start_column", "end_line", "end_column")
CODE_ORDER = ("many_callers", "many_dependencies", "converges_and_branches", "crosses_areas", "cycle", "cycle_introduced", "changed_on_both_sides", "multiple_levels")


@dataclass
class Request:
    """A graph question whose values are already checked and bounded."""

    file: str | None = None
    function_id: str | None = None
    direction: str = "both"
    relations: tuple[str, ...] = tuple(r for r in ops.SUPPORTED if r != "possible_call")
    depth: int = 1
    view: str = "delta"
    max_nodes: int = 30
    max_edges: int = 60
    render: tuple[str, ...] = ()


@dataclass
class Revisions:
    """Import tables of both sides, told apart by ``side``, and parsed symbols (side, path, facts) of the admitted files."""

    imports: DataFrame  # importer, target, line
    specifiers: DataFrame  # path, specifier, line, target
    bindings: DataFrame
    files: DataFrame  # path, truncated
    parsed: DataFrame


def revisions(base: dict[str, DataFrame], target: dict[str, DataFrame], base_symbols: DataFrame, target_symbols: DataFrame) -> Revisions:
    both = lambda name: ops.sided(base[name], target[name])
    return Revisions(durable(both("edge")), both("specifier"), both("binding"), both("file"), ops.sided(base_symbols, target_symbols))


def admitted(analysis: Analysis, base: DataFrame, target: DataFrame) -> DataFrame:
    """Files that may be parsed for calls across files: changed ones on either side, their importers, what they import."""
    changed = analysis.files.select(F.explode(F.array("base_path", "target_path")).alias("path")).filter("path is not null").distinct()
    return links.admitted_files(changed, base.select("importer", "target").union(target.select("importer", "target")))


@dataclass
class Graph:
    """A delivered graph: rows in order, at most as many as its budgets."""

    nodes: list[Row]
    edges: list[Row]
    completeness: dict
    omitted_nodes: int = 0
    omitted_edges: int = 0
    reasons: list[str] = field(default_factory=list)

    def cycles(self, view: str = "delta") -> list[tuple[str, list[str]]]:
        """Key and members of each class of nodes that reach one another, by node order; guesses don't close a cycle.

        The nodes are those of a delivered graph, a hundred at most.
        """
        kept = {"delta": ("added", "removed", "unchanged"), "base": ("removed", "unchanged"), "target": ("added", "unchanged")}[view]
        onward: dict[str, set[str]] = {}
        for e in self.edges:
            if e.status in kept and e.relation != "possible_call":
                onward.setdefault(e.from_id, set()).add(e.to_id)
        reach = {n.id: _closure(n.id, onward) for n in self.nodes}
        out, placed = [], set()
        for n in self.nodes:
            if n.id in placed or n.id not in reach[n.id]:
                continue
            members = [m.id for m in self.nodes if m.id in reach[n.id] and n.id in reach[m.id]]
            placed.update(members)
            out.append((f"c{len(out)}", members))
        return out


def _closure(start: str, onward: dict[str, set[str]]) -> set[str]:
    seen: set[str] = set()
    todo = list(onward.get(start, ()))
    while todo:
        if (now := todo.pop()) not in seen:
            seen.add(now)
            todo += onward.get(now, ())
    return seen


def _statuses(analysis: Analysis) -> DataFrame:
    return analysis.files.select("path", ops.file_node_status(F.col("status")).alias("status"))


def finish(nodes: DataFrame, edges: DataFrame, request: Request, known: dict) -> Graph:
    """A view of nodes and edges, grouped, and cut to the budgets; only what is delivered reaches the driver."""
    nodes, edges = ops.in_view(nodes, edges, request.view)
    nodes, edges = ops.collapse_known(nodes, edges)
    nodes, edges, taken = ops.collapse_overflow(durable(nodes), durable(edges), request.max_nodes)
    nodes, edges = durable(nodes), durable(edges)
    total = nodes.count()
    kept = nodes.orderBy(*ops.priority()).limit(request.max_nodes)
    kept = durable(kept)
    inside = edges.join(F.broadcast(kept.select(F.col("id").alias("from_id"))), "from_id", "left_semi").join(F.broadcast(kept.select(F.col("id").alias("to_id"))), "to_id", "left_semi")
    n_edges = inside.count()
    rows = kept.orderBy(*ops.node_order()).collect()
    found = inside.select(*ops.EDGE).orderBy(*ops.edge_order()).limit(request.max_edges).collect()
    reasons = ["max_nodes"] * (total > len(rows) or taken > 0) + ["max_edges"] * (n_edges > request.max_edges)
    return Graph(rows, found, known, total - len(rows) + taken, n_edges - len(found), reasons)


# ---- rooted at files


def _known(table: DataFrame, calls: int = 0) -> dict:
    row = table.first()
    return {"scan_truncated_files": row.scan_truncated_files, "unresolved_specifiers": row.unresolved_specifiers, "unresolved_calls": calls, "relations_supported": list(ops.SUPPORTED)}


def _forwards(revs: Revisions) -> DataFrame:
    """path, target and side of whole or partial re-exports."""
    named = revs.parsed.select("side", "path", F.explode("modules").alias("specifier"))
    return named.join(revs.specifiers.filter("target is not null").select("side", "path", "specifier", "target"), ["side", "path", "specifier"]).select("path", "target", "side")


def module_graph(analysis: Analysis, revs: Revisions, request: Request) -> Graph:
    """Modules near the roots with their imports, tests and re-exports."""
    statuses = _statuses(analysis)
    roots = statuses.select("path") if request.file is None else statuses.filter(F.col("path") == request.file).select("path")
    both = revs.imports.select(F.col("importer").alias("from_id"), F.col("target").alias("to_id")).distinct()
    start = roots.select(F.col("path").alias("id"))
    if "imports" in request.relations:
        reached = ops.reached_from(both, start, request.direction, request.depth)
    else:
        reached = start.distinct().select("id", F.lit(0).alias("depth"), F.lit(True).alias("is_root"))
    reached = durable(reached.withColumnRenamed("id", "path"))
    nodes, edges = [ops.module_nodes(reached, statuses)], []
    if "imports" in request.relations:
        edges.append(ops.import_relations(revs.imports, reached))
    if "tested_by" in request.relations:
        side = lambda d, s: d.filter(F.col("side") == s).drop("side")
        tested = ops.sided(*[links.related_tests(side(revs.imports, s), side(revs.files, s).select("path")) for s in ("base", "target")])
        found, tests = ops.test_relations(tested, reached)
        edges.append(found)
        nodes.append(ops.module_nodes(tests.withColumn("is_root", F.lit(False)), statuses))
    if "re_exports" in request.relations:
        edges.append(ops.re_export_relations(_forwards(revs), revs.imports, reached))
    scope = reached.select("path", F.explode(F.array(F.lit("base"), F.lit("target"))).alias("side"))
    known = _known(ops.completeness(revs.files, revs.specifiers, scope, request.view))
    return finish(ops.nearest(_union(nodes)), _union(edges, analysis), request, known)


def _union(tables: list[DataFrame], analysis: Analysis | None = None) -> DataFrame:
    if not tables:
        spark = analysis.files.sparkSession
        return spark.createDataFrame([], "from_id string, relation string, to_id string, resolution string, status string, evidence_file string, evidence_line int")
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


# ---- rooted at a function


def _place(side: Column) -> Column:
    return F.when(side.isNotNull(), F.struct(*[side[c].alias(c) for c in PLACE]))


def _node_id(value: Column) -> Column:
    return F.concat(F.lit("function:"), value)


def _placed(analysis: Analysis, revs: Revisions, functions: DataFrame) -> DataFrame:
    """Where functions are (path, place) and which node they are: id, label, line, col, status.

    In a changed file the analysis names them, whichever side the place is of;
    elsewhere path, symbol and place do, on the side that still has it.
    """
    rows = analysis.functions.join(analysis.files.select("file_ix", "base_path", "target_path"), "file_ix")
    own = _own_places(rows)
    changed = analysis.files.select(F.explode(F.array("base_path", "target_path")).alias("path")).filter("path is not null").distinct()
    others = functions.join(changed, "path", "left_anti").groupBy("path", "place").agg(F.bool_or(F.col("side") == "base").alias("b"), F.bool_or(F.col("side") == "target").alias("t"), F.max_by(F.struct("kind", "qualified_name"), "side").alias("f"))
    start = F.col("place")
    named = function_id(F.col("path"), symbol_id(F.col("f.kind"), F.col("f.qualified_name")), F.when(F.col("t"), "unchanged").otherwise("removed"), F.when(~F.col("t"), start), F.when(F.col("t"), start))
    status = F.when(F.col("b") & F.col("t"), "unchanged").when(F.col("t"), "added").otherwise("removed")
    outside = others.select(F.col("path").alias("at"), "place", F.struct(_node_id(named).alias("id"), F.col("f.qualified_name").alias("label"), F.col("path").alias("path"), F.col("place.start_line").alias("line"), F.col("place.start_column").alias("col"), status.alias("status")).alias("node"))
    return own.unionByName(outside)


def _own_node() -> Column:
    line = lambda c: F.coalesce(F.col(f"t.{c}"), F.col(f"b.{c}"))
    return F.struct(_node_id(F.col("function_id")).alias("id"), F.col("qualified_name").alias("label"), F.col("path").alias("path"), line("start_line").alias("line"), line("start_column").alias("col"), F.col("status").alias("status")).alias("node")


def _own_places(rows: DataFrame) -> DataFrame:
    """at, place, node: of functions whose place on either side is the same, the first."""
    each = rows.select(F.array_distinct(F.array("base_path", "target_path")).alias("paths"), F.array(_place(F.col("b")), _place(F.col("t"))).alias("places"), F.struct("file_ix", "fn_ix").alias("ord"), _own_node())
    each = each.select(F.explode("paths").alias("at"), "places", "ord", "node").select("at", F.explode("places").alias("place"), "ord", "node").filter("at is not null and place is not null")
    return each.groupBy("at", "place").agg(F.min_by("node", "ord").alias("node"))


def function_graph(analysis: Analysis, revs: Revisions, request: Request) -> Graph:
    """A function, the calls it takes part in on either side, and the module that declares it."""
    root = analysis.functions.filter(F.col("function_id") == request.function_id).select("file_ix", "path").first()
    path, guess = root.path, "possible_call" in request.relations
    files = analysis.files.select("file_ix", "base_path", "target_path")
    exports = revs.parsed.select("side", "path", F.inline("exports")).drop("line")
    place = F.struct(*PLACE).alias("place")
    indexed = durable(symbols.functions_of(revs.parsed, "side", "path").select("side", "path", "fn_ix", "kind", "qualified_name", place, "calls"))
    answered = durable(revs.specifiers.select("side", "path", "specifier", "target").distinct())

    # Functions of changed files by side, under either of their paths, and of other files from the index.
    sides = F.array(F.struct(F.lit("base").alias("side"), F.col("b").alias("f")), F.struct(F.lit("target").alias("side"), F.col("t").alias("f")))
    own = analysis.functions.select("file_ix", "qualified_name", "function_id", F.explode(sides).alias("s")).filter("s.f is not null").select("file_ix", "qualified_name", "function_id", "s.side", F.col("s.f.fn_ix").alias("side_fn"), _place(F.col("s.f")).alias("place"))
    own = durable(own.join(files, "file_ix").select("*", F.explode(F.array_distinct(F.array("base_path", "target_path"))).alias("path")).filter("path is not null"))
    called = analysis.calls.select("file_ix", "side", F.col("fn_ix").alias("side_fn"), "name", "receiver", "line")
    root_functions = own.filter((F.col("file_ix") == root.file_ix) & (F.col("path") == path))
    from_root = root_functions.join(called, ["file_ix", "side", "side_fn"]).select("side", "path", "place", "name", "receiver", "line")

    importers = revs.imports.filter(F.col("target") == path).select("side", F.col("importer").alias("path")).distinct()
    touched = files.select(F.explode(F.array("base_path", "target_path")).alias("path")).filter("path is not null").distinct()
    near = own.join(importers, ["side", "path"], "left_semi").join(called, ["file_ix", "side", "side_fn"]).select("side", "path", "place", "name", "receiver", "line")
    far = indexed.join(importers, ["side", "path"], "left_semi").join(touched, "path", "left_anti").select("side", "path", "place", F.inline("calls")).select("side", "path", "place", "name", "receiver", "line")

    # Calls of names that the root's own file declares once on that side.
    local_names = ops.declared(root_functions.select("side", "path", "qualified_name", "place"))
    at_home = from_root.filter("receiver is null").join(local_names.withColumnRenamed("place", "to_place"), ["side", "path", "name"])
    local = at_home.select("side", "path", "place", "name", "receiver", "line", F.lit(path).alias("def_path"), "to_place", F.lit("calls").alias("relation"), F.lit("direct_local_symbol").alias("resolution"))
    away = from_root.join(local_names.select("side", "path", "name", F.lit(True).alias("home")), ["side", "path", "name"], "left").filter("home is null or receiver is not null").select("side", "path", "place", "name", "receiver", "line")

    sites = durable(away.withColumn("origin", F.lit("root")).unionByName(near.unionByName(far).withColumn("origin", F.lit("importer"))))
    exact = durable(ops.imported_calls(sites, revs.bindings.select("side", "path", "local", "imported_kind", "imported", "specifier"), answered, exports, indexed).withColumn("relation", F.lit("calls")))
    found = exact
    if guess:
        same = [F.col(f"s.{c}").eqNullSafe(F.col(f"e.{c}")) for c in ("side", "path", "place", "name", "receiver", "line")]
        left = sites.alias("s").join(exact.select("side", "path", "place", "name", "receiver", "line").distinct().alias("e"), same, "left_anti")
        found = exact.unionByName(ops.guessed_calls(left, revs.imports, answered, exports, indexed).withColumn("relation", F.lit("possible_call")))
    found = durable(found)
    flat = lambda d: d.select("side", "path", F.col("place.start_line").alias("start_line"), F.col("place.start_column").alias("start_column"), "name", "receiver", "line")
    missing = ops.unresolved_calls(flat(sites), flat(found), request.view).count()
    site = ["side", "path", "place", "name", "receiver", "line", "def_path", "to_place", "relation", "resolution"]
    # A call into the root's file means the function that stands there on the call's side; one out of it whichever side's place it is.
    inward = found.filter((F.col("origin") == "importer") & (F.col("def_path") == path)).select(*site)
    outward = local.unionByName(found.filter("origin = 'root'").select(*site))

    nodes = durable(_placed(analysis, revs, indexed))
    ends = nodes.select(F.col("at").alias("path"), "place", F.col("node.id").alias("from_id"))
    into = nodes.select(F.col("at").alias("def_path"), F.col("place").alias("to_place"), F.col("node.id").alias("to_id"))
    here = root_functions.select("side", F.col("place").alias("to_place"), _node_id(F.col("function_id")).alias("to_id"))
    met = outward.join(into, ["def_path", "to_place"]).unionByName(inward.join(here, ["side", "to_place"]))
    calls = met.join(ends, ["path", "place"]).select("from_id", "to_id", "relation", "side", F.col("path").alias("site"), "line", "resolution")
    merged = durable(ops.merged_calls(calls).filter(F.col("relation").isin(*request.relations)))

    root_id = "function:" + request.function_id
    start = analysis.files.sparkSession.createDataFrame([(root_id,)], "id string")
    if {"calls", "possible_call"} & set(request.relations):
        reached = durable(ops.reached_from(merged.select("from_id", "to_id"), start, request.direction, request.depth))
    else:
        reached = start.select("id", F.lit(0).alias("depth"), F.lit(True).alias("is_root"))
    placed = nodes.select("node").union(analysis.functions.select(_own_node())).groupBy(F.col("node.id").alias("id")).agg(F.min("node").alias("node"))
    shown = reached.join(placed, "id").select(
        "id", F.lit("function").alias("kind"), "node.label", "node.path", "node.line", "node.col", "node.status", "depth", "is_root", F.lit(None).cast("string").alias("role"), F.lit(1).cast("long").alias("size")
    )
    both = [reached.select(F.col("id").alias(c)) for c in ("from_id", "to_id")]
    edges = merged.join(both[0], "from_id", "left_semi").join(both[1], "to_id", "left_semi")
    if "contains" in request.relations:
        mine = analysis.functions.filter(F.col("file_ix") == root.file_ix).select(_node_id(F.col("function_id")).alias("id"), F.col("b").isNotNull().alias("in_base"), F.col("t").isNotNull().alias("in_target"))
        edges = edges.unionByName(ops.contains_relations(path, mine, reached))
        module = analysis.files.filter(F.col("file_ix") == root.file_ix).select("path", F.lit(1).alias("depth"), F.lit(False).alias("is_root"))
        shown = shown.unionByName(ops.module_nodes(module, _statuses(analysis)))
    own_paths = files.filter(F.col("file_ix") == root.file_ix).select(F.explode(F.array(F.struct(F.lit("base").alias("side"), F.col("base_path").alias("path")), F.struct(F.lit("target").alias("side"), F.col("target_path").alias("path")))).alias("x")).select("x.path", "x.side").filter("path is not null")
    scope = own_paths.unionByName(importers.select("path", "side"))
    known = _known(ops.completeness(revs.files, revs.specifiers, scope, request.view), missing)
    return finish(ops.nearest(shown), edges, request, known)


def build(analysis: Analysis, revs: Revisions, request: Request) -> Graph:
    return module_graph(analysis, revs, request) if request.function_id is None else function_graph(analysis, revs, request)


# ---- whether to draw it


def _counted(n: int, noun: str) -> str:
    return f"{n} {noun}" if n == 1 else f"{n} {noun}s"


def area_of(path: str) -> str:
    from ..functions.paths import PACKAGE_ROOTS

    first, *rest = path.split("/")
    return "<root>" if not rest else f"{first}/{rest[0]}" if first in PACKAGE_ROOTS else first


def recommend(graph: Graph) -> dict:
    """Whether a delivered graph is worth a diagram, with the signals that say so in their fixed order.

    Few nodes in a line or a loop are better read as lines, whatever else holds. Guesses count for nothing.
    """
    edges = [e for e in graph.edges if e.relation != "possible_call"]
    into, out = [e.to_id for e in edges], [e.from_id for e in edges]
    forks = any(len(x) != len(set(x)) for x in (into, out))
    signal = lambda code, message, value: {"code": code, "message": message, "value": value}
    if len(graph.nodes) < 4 and not forks:
        n = len(graph.nodes)
        return {"recommended": False, "reasons": [signal("linear_and_small", f"{_counted(n, 'node')} and no branching; a dependency diff is the better answer", n)]}
    roots = {n.id for n in graph.nodes if n.is_root}
    depth = {n.id: n.depth for n in graph.nodes}
    changed = [e for e in edges if e.status != "unchanged"]
    inbound, outbound = sum(x in roots for x in into), sum(x in roots for x in out)
    areas = len({area_of(n.path) for n in graph.nodes})
    cyclic = sum(len(m) for _, m in graph.cycles())
    before = {tuple(m) for _, m in graph.cycles("base")}
    introduced = sum(tuple(m) not in before for _, m in graph.cycles("target"))
    both = any(e.to_id in roots for e in changed) and any(e.from_id in roots for e in changed)
    levels = len({max(depth[e.from_id], depth[e.to_id]) for e in changed})
    found = {
        "many_callers": (inbound >= 3, f"{inbound} relationships point at the root", inbound),
        "many_dependencies": (outbound >= 3, f"the root points at {outbound} relationships", outbound),
        "converges_and_branches": (min(inbound, outbound) >= 2, f"{inbound} relationships point at the root and {outbound} leave it", min(inbound, outbound)),
        "crosses_areas": (areas >= 2, f"the graph spans {areas} change areas", areas),
        "cycle": (cyclic > 0, f"the graph contains a cycle through {_counted(cyclic, 'node')}", cyclic),
        "cycle_introduced": (introduced > 0, f"the change closes {_counted(introduced, 'cycle')}; the target loops where the base did not", introduced),
        "changed_on_both_sides": (both, f"relationships changed on both sides of the root; {_counted(len(changed), 'relationship')} in total", len(changed)),
        "multiple_levels": (levels >= 2, f"changed relationships appear at {_counted(levels, 'hop level')} from the root", levels),
    }
    reasons = [signal(code, found[code][1], found[code][2]) for code in CODE_ORDER if found[code][0]]
    return {"recommended": bool(reasons), "reasons": reasons}


def answer(graph: Graph, request: Request, root: dict | None) -> dict:
    """What a graph question is answered with."""
    keyed = {n.id: f"n{i}" for i, n in enumerate(graph.nodes)}
    nodes, edges = [], []
    for n in graph.nodes:
        view = {"id": n.id, "key": keyed[n.id], "label": n.label, "kind": n.kind, "path": n.path, "status": n.status}
        nodes.append(view | ({"group": {"size": n.size, "role": n.role}} if n.role else {}))
    for e in graph.edges:
        view = {"from": e.from_id, "to": e.to_id, "relation": e.relation, "status": e.status, "resolution": e.resolution, "confidence": CONFIDENCE[e.resolution]}
        edges.append(view | ({"evidence": {"file": e.evidence_file, "line": e.evidence_line}} if e.evidence_line is not None else {}))
    out = {
        "root": root,
        "graph": {"nodes": nodes, "edges": edges, "truncated": bool(graph.reasons), "omitted": {"nodes": graph.omitted_nodes, "edges": graph.omitted_edges}, "reasons": graph.reasons},
        "completeness": graph.completeness,
    }
    drawn = [{"from_id": e["from"], "to_id": e["to"], "relation": e["relation"], "status": e["status"], "confidence": e["confidence"]} for e in edges]
    if "diff" in request.render:
        out["dependency_diff"] = render.dependency_lines(nodes, drawn)
    if "mermaid" in request.render:
        out["mermaid"] = render.mermaid(nodes, drawn, graph.cycles())
    return out | {"visualization": recommend(graph)}
