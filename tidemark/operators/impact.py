"""Relations that a change reaches: modules, tests, re-exports, calls, and how many of them fit an answer.

Nodes are rows (id, kind, label, path, line, col, status, depth, is_root, role,
size), edges (from_id, relation, to_id, resolution, status, evidence_file,
evidence_line). A table of one revision is a side; both sides are read, since
only two can tell what was removed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import change_area, classify, leaf_name
from .compare import membership
from .durable import durable
from .edges import CONFIDENCE, chase_reexports
from .graph import KINDS, RELATIONS, rank_of, walk

# Orders and names that answers are compared by.
SUPPORTED = ("imports", "tested_by", "calls", "contains", "re_exports", "possible_call")
RESOLUTIONS = (
    "resolved_specifier", "direct_local_symbol", "declaration", "test_imports_module", "test_name_matches_module",
    "imported_symbol", "export_clause", "re_exported_symbol", "property_name_match",
)
NOUNS = {
    "tests": ("test", "tests"),
    "generated": ("generated file", "generated files"),
    "vendored": ("vendored file", "vendored files"),
    "lockfile": ("lockfile", "lockfiles"),
    "callers": ("caller", "callers"),
    "dependencies": ("dependency", "dependencies"),
}
CLASSIFIED = ("generated", "vendored", "lockfile")
NODE = ["id", "kind", "label", "path", "line", "col", "status", "depth", "is_root", "role", "size"]
EDGE = ["from_id", "relation", "to_id", "resolution", "status", "evidence_file", "evidence_line"]
SITE = ["path", "start_line", "start_column", "name", "receiver", "line"]


def file_node_status(status: Column) -> Column:
    """What a file's status is for its node: what was renamed or is binary was touched."""
    return F.when(status == "added", "added").when(status.isin("deleted", "removed"), "removed").when(status.isin("modified", "renamed", "binary"), "modified").otherwise("unchanged")


def module_id(path: Column) -> Column:
    return F.concat(F.lit("module:"), path)


def confidence(resolution: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair]), resolution)


def sided(base: DataFrame, target: DataFrame) -> DataFrame:
    """Both sides in one table, told apart by ``side``."""
    return base.withColumn("side", F.lit("base")).unionByName(target.withColumn("side", F.lit("target")))


def view_sides(view: str) -> tuple[str, ...]:
    return ("base", "target") if view == "delta" else (view,)


def presence(rows: DataFrame, key: list[str], line: str | None = None) -> DataFrame:
    """key, status by the sides a row is on, and the line of the side that an answer shows."""
    on = lambda s: F.col("side") == s
    facts = [F.bool_or(on("base")).alias("b"), F.bool_or(on("target")).alias("t")]
    if line:
        facts += [F.min(F.when(on("base"), F.col(line))).alias("bl"), F.min(F.when(on("target"), F.col(line))).alias("tl")]
    both = rows.groupBy(*key).agg(*facts).withColumn("status", membership(F.col("b"), F.col("t")))
    shown = [F.when(F.col("status") == "removed", F.col("bl")).otherwise(F.col("tl")).alias("line")] if line else []
    return both.select(*key, "status", *shown)


# ---- modules


def module_nodes(paths: DataFrame, statuses: DataFrame) -> DataFrame:
    """Nodes of modules (path, depth, is_root), with the status that the change gave them (path, status)."""
    p = F.col("path")
    known = paths.join(statuses, "path", "left")
    return known.select(
        module_id(p).alias("id"), F.lit("module").alias("kind"), F.substring_index(p, "/", -1).alias("label"), "path", F.lit(0).alias("line"), F.lit(0).alias("col"),
        F.coalesce("status", F.lit("unchanged")).alias("status"), F.col("depth").cast("int").alias("depth"), "is_root", F.lit(None).cast("string").alias("role"), F.lit(1).cast("long").alias("size"),
    )


def import_relations(imports: DataFrame, reached: DataFrame) -> DataFrame:
    """Import edges (importer, target, line, side) between reached modules (path)."""
    inside = imports.join(reached.select(F.col("path").alias("importer")), "importer", "left_semi").join(reached.select(F.col("path").alias("target")), "target", "left_semi")
    rows = presence(inside, ["importer", "target"], "line")
    return _module_edges(rows, "importer", "target", "imports", F.lit("resolved_specifier"), True)


def test_relations(links: DataFrame, reached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tested_by edges of reached modules (path, depth) from links (path, test, resolution, side), and the tests (path, depth) they add."""
    near = links.join(reached.select("path", "depth"), "path")
    rows = presence(near, ["path", "test", "resolution"])
    tests = near.groupBy(F.col("test").alias("p")).agg((F.min("depth") + 1).alias("depth")).withColumnRenamed("p", "path")
    return _module_edges(rows, "test", "path", "tested_by", F.col("resolution"), False), tests


def re_export_relations(forwards: DataFrame, imports: DataFrame, reached: DataFrame) -> DataFrame:
    """re_exports edges between reached modules from what each side forwards (path, target, side); the evidence is the import's line."""
    ends = [reached.select(F.col("path").alias(c)) for c in ("path", "target")]
    inside = forwards.join(ends[0], "path", "left_semi").join(ends[1], "target", "left_semi").select("path", "target", "side").distinct()
    rows = presence(inside.join(imports.select(F.col("importer").alias("path"), "target", "side", "line"), ["path", "target", "side"], "left"), ["path", "target"], "line")
    return _module_edges(rows, "path", "target", "re_exports", F.lit("export_clause"), True)


def _module_edges(rows: DataFrame, start: str, end: str, relation: str, resolution: Column, evident: bool) -> DataFrame:
    line = F.col("line").cast("int") if evident else F.lit(None).cast("int")
    file = F.when(line.isNotNull(), F.col(start)) if evident else F.lit(None).cast("string")
    return rows.select(
        module_id(F.col(start)).alias("from_id"), F.lit(relation).alias("relation"), module_id(F.col(end)).alias("to_id"), resolution.alias("resolution"), "status", file.alias("evidence_file"), line.alias("evidence_line")
    )


def nearest(nodes: DataFrame) -> DataFrame:
    """One row for each node id, at its fewest hops."""
    rest = [c for c in nodes.columns if c not in ("id", "depth", "is_root")]
    return nodes.groupBy("id").agg(F.min("depth").alias("depth"), F.bool_or("is_root").alias("is_root"), *[F.first(c).alias(c) for c in rest]).select(*NODE)


def completeness(files: DataFrame, specifiers: DataFrame, scope: DataFrame, view: str) -> DataFrame:
    """scan_truncated_files and unresolved_specifiers of a scope (path, side), over the sides that a view shows.

    ``files`` are (path, truncated, side), ``specifiers`` (path, target, side). A file counts on each side.
    """
    shown = scope.filter(F.col("side").isin(*view_sides(view))).select("path", "side").distinct()
    cut = files.filter("truncated").join(shown, ["path", "side"], "left_semi").agg(F.count("*").alias("scan_truncated_files"))
    lost = specifiers.filter("target is null").join(shown, ["path", "side"], "left_semi").agg(F.count("*").alias("unresolved_specifiers"))
    return cut.crossJoin(F.broadcast(lost))  # one row each


# ---- calls


def declared(functions: DataFrame) -> DataFrame:
    """side, path, name and place of what one function of a file and side alone declares."""
    named = functions.withColumn("name", leaf_name(F.col("qualified_name")))
    once = named.groupBy("side", "path", "name").agg(F.count("*").alias("k"), F.first("place").alias("place")).filter("k = 1")
    return once.select("side", "path", "name", "place")


def definitions(starts: DataFrame, exports: DataFrame, targets: DataFrame, functions: DataFrame) -> DataFrame:
    """Where exported names (side, path, name) are defined: def_path, place and hops; names that lead to no function are left out.

    ``exports`` are (side, path, exported, local, from_specifier, fn_ix),
    ``targets`` (side, path, specifier, target), ``functions`` (side, path,
    fn_ix, place). A side is part of the path while re-exports are followed.
    """
    at = lambda p: F.concat("side", F.lit(":"), p)
    answered = targets.filter("target is not null").select("side", "path", F.col("specifier").alias("from_specifier"), F.col("target").alias("onward")).distinct()
    known = exports.join(answered, ["side", "path", "from_specifier"], "left").filter("from_specifier is null or onward is not null")
    links = known.select(at(F.col("path")).alias("path"), F.col("exported").alias("name"), F.when(F.col("from_specifier").isNotNull(), at(F.col("onward"))).alias("from_path"), F.col("local").alias("from_name"))
    found = chase_reexports(starts.select(at(F.col("path")).alias("path"), "name").distinct(), links)
    own = exports.filter("from_specifier is null and fn_ix is not null").select("side", F.col("path").alias("own_path"), F.col("exported").alias("def_name"), "fn_ix")
    places = own.join(functions.select("side", F.col("path").alias("own_path"), "fn_ix", "place"), ["side", "own_path", "fn_ix"])
    placed = places.select(at(F.col("own_path")).alias("def_path"), "def_name", "side", F.col("own_path").alias("defined_in"), "place")
    ended = found.join(placed, ["def_path", "def_name"])
    return ended.select("side", F.expr("substring(path, length(side) + 2)").alias("path"), "name", F.col("defined_in").alias("def_path"), "place", "hops")


def imported_calls(sites: DataFrame, bindings: DataFrame, targets: DataFrame, exports: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls that name an import's definition in another module: the site's columns, def_path, to_place, resolution.

    A bare name calls what it is bound to; a member of a namespace import calls
    that name there; a namespace itself is not called.
    """
    local = F.coalesce("receiver", "name")
    bound = sites.withColumn("local", local).join(bindings, ["side", "path", "local"])
    by_member = F.col("receiver").isNotNull() & (F.col("imported_kind") == "namespace")
    by_name = F.col("receiver").isNull() & (F.col("imported_kind") != "namespace")
    wanted = F.when(by_member, F.col("name")).when(by_name & (F.col("imported_kind") == "default"), F.lit("default")).when(by_name, F.col("imported"))
    answered = targets.filter("target is not null").select("side", "path", "specifier", F.col("target").alias("module")).distinct()
    named = bound.withColumn("wanted", wanted).filter("wanted is not null").join(answered, ["side", "path", "specifier"])
    found = definitions(named.select("side", F.col("module").alias("path"), F.col("wanted").alias("name")), exports, targets, functions)
    found = found.select("side", F.col("path").alias("module"), F.col("name").alias("wanted"), "def_path", F.col("place").alias("to_place"), "hops")
    resolution = F.when(F.col("hops") == 0, "imported_symbol").otherwise("re_exported_symbol")
    return named.join(found, ["side", "module", "wanted"]).select(*sites.columns, "def_path", "to_place", resolution.alias("resolution"))


def guessed_calls(sites: DataFrame, imports: DataFrame, targets: DataFrame, exports: DataFrame, functions: DataFrame) -> DataFrame:
    """Property calls whose name has one definition in sight: in the file itself, or among the exports of what it imports."""
    asked = sites.filter("receiver is not null")
    here = functions.select("side", "path", leaf_name(F.col("qualified_name")).alias("name"), F.col("path").alias("def_path"), "place")
    names = asked.select("side", "path", "name").distinct()
    near = names.join(imports.select("side", F.col("importer").alias("path"), F.col("target").alias("module")).distinct(), ["side", "path"])
    found = definitions(near.select("side", F.col("module").alias("path"), "name"), exports, targets, functions)
    there = near.join(found.select("side", F.col("path").alias("module"), "name", "def_path", "place"), ["side", "module", "name"]).select("side", "path", "name", "def_path", "place")
    # A definition is told by its file and where it starts.
    options = names.join(here.unionByName(there), ["side", "path", "name"]).select("side", "path", "name", "def_path", "place", F.struct("def_path", "place.start_line", "place.start_column").alias("at"))
    single = options.groupBy("side", "path", "name").agg(F.count_distinct("at").alias("k"), F.first("def_path").alias("def_path"), F.first("place").alias("to_place")).filter("k = 1").drop("k")
    return asked.join(single, ["side", "path", "name"]).select(*sites.columns, "def_path", "to_place", F.lit("property_name_match").alias("resolution"))


def merged_calls(rows: DataFrame) -> DataFrame:
    """Call edges of both sides (from_id, to_id, relation, side, site, line, resolution) as one edge for each relation of a pair.

    The weaker of two resolutions stays, the first line of each side counts.
    """
    key = ["from_id", "to_id", "relation"]
    weakest = rows.groupBy(*key).agg(F.min_by("resolution", F.struct(confidence(F.col("resolution")), rank_of(F.col("resolution"), RESOLUTIONS))).alias("resolution"), F.min("site").alias("site"))
    return presence(rows, key, "line").join(weakest, key).select("from_id", "relation", "to_id", "resolution", "status", F.col("site").alias("evidence_file"), F.col("line").cast("int").alias("evidence_line"))


def unresolved_calls(sites: DataFrame, found: DataFrame, view: str) -> DataFrame:
    """Distinct call sites (side and SITE) of a view that nothing resolved; a missing receiver counts as one."""
    key = ["side", *SITE]
    same = reduce(lambda a, b: a & b, [F.col(f"s.{c}").eqNullSafe(F.col(f"f.{c}")) for c in key])
    left = sites.select(*key).distinct().alias("s").join(found.select(*key).distinct().alias("f"), same, "left_anti")
    return left.filter(F.col("side").isin(*view_sides(view)))


def contains_relations(path: str, functions: DataFrame, reached: DataFrame) -> DataFrame:
    """Edges from a module to those of its own functions (id, in_base, in_target) that were reached (id)."""
    own = functions.join(reached.select("id"), "id", "left_semi")
    none = F.lit(None)
    return own.select(
        module_id(F.lit(path)).alias("from_id"), F.lit("contains").alias("relation"), F.col("id").alias("to_id"), F.lit("declaration").alias("resolution"),
        membership(F.col("in_base"), F.col("in_target")).alias("status"), none.cast("string").alias("evidence_file"), none.cast("int").alias("evidence_line"),
    )


# ---- what fits an answer


def in_view(nodes: DataFrame, edges: DataFrame, view: str) -> tuple[DataFrame, DataFrame]:
    """What a view shows: its edges, and the nodes that they meet or that are roots."""
    if view == "delta":
        return nodes, edges
    kept = edges.filter(F.col("status").isin(*{"base": ("removed", "unchanged"), "target": ("added", "unchanged")}[view]))
    met = kept.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct().withColumn("met", F.lit(True))
    return nodes.join(met, "id", "left").filter("met or is_root").drop("met"), kept


def regroup(nodes: DataFrame, edges: DataFrame, roles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (id, role) become one group node a role; edges are rewritten, those inside a group go, equal ones merge.

    A group has its members' status and area where they share one. Of edges that
    become one the first in edge order stays; evidence goes with a member.
    """
    members = nodes.join(roles, "id").select("id", F.col("role_to").alias("role"), "status", "depth", change_area(F.col("path")).alias("area"))
    size = F.count("*").alias("size")
    groups = members.groupBy("role").agg(size, F.min("depth").alias("depth"), F.count_distinct("status").alias("s"), F.min("status").alias("status"), F.count_distinct("area").alias("a"), F.min("area").alias("area"))
    noun = F.element_at(F.create_map(*[F.lit(x) for k, (_, many) in NOUNS.items() for x in (k, many)]), F.col("role"))
    area = F.when(F.col("a") == 1, F.col("area")).otherwise(F.lit(""))
    label = F.concat(F.col("size").cast("string"), F.lit(" "), noun, F.when(area != "", F.concat(F.lit(" · "), area)).otherwise(F.lit("")))
    made = groups.select(
        F.concat(F.lit("group:"), "role").alias("id"), F.lit("group").alias("kind"), label.alias("label"), area.alias("path"), F.lit(0).alias("line"), F.lit(0).alias("col"),
        F.when(F.col("s") == 1, F.col("status")).otherwise("unchanged").alias("status"), "depth", F.lit(False).alias("is_root"), "role", "size",
    )
    left = nodes.join(roles.select("id"), "id", "left_anti").select(*NODE).unionByName(made)
    ends = edges.withColumn("old", F.struct("from_id", rank_of(F.col("relation"), RELATIONS), "to_id", rank_of(F.col("resolution"), RESOLUTIONS)))
    for end in ("from_id", "to_id"):
        ends = ends.join(roles.select(F.col("id").alias(end), F.col("role_to").alias(f"{end}_role")), end, "left")
        ends = ends.withColumn(end, F.coalesce(F.concat(F.lit("group:"), f"{end}_role"), F.col(end)))
    moved = F.col("from_id_role").isNotNull() | F.col("to_id_role").isNotNull()
    ends = ends.filter(~F.coalesce(F.col("from_id_role") == F.col("to_id_role"), F.lit(False)))
    fact = F.struct("status", F.when(~moved, F.col("evidence_file")).alias("evidence_file"), F.when(~moved, F.col("evidence_line")).alias("evidence_line"))
    merged = ends.groupBy("from_id", "relation", "to_id", "resolution").agg(F.min_by(fact, "old").alias("x"))
    return left, merged.select("from_id", "relation", "to_id", "resolution", "x.*")


def collapse_known(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tests by their tested_by edge, then generated, vendored and lock files by their path: a group each, of two members or more.

    One pass: a node is of the first group that takes it, and roots are of none.
    """
    tests = edges.filter("relation = 'tested_by'").select(F.col("from_id").alias("id")).distinct().withColumn("is_test", F.lit(True))
    seen = nodes.filter("not is_root").join(tests, "id", "left").select("id", F.coalesce("is_test", F.lit(False)).alias("is_test"), F.when(F.col("kind") != "group", classify(F.col("path"))).alias("class"))
    # One row of counts.
    enough = seen.agg((F.count_if("is_test") > 1).alias("grouped"))
    first = seen.join(F.broadcast(enough)).select("id", F.when(F.col("is_test") & F.col("grouped"), "tests").when(F.col("class").isin(*CLASSIFIED), F.col("class")).alias("role_to")).filter("role_to is not null")
    counts = first.groupBy("role_to").agg(F.count("*").alias("k")).filter("k > 1").select("role_to")
    return regroup(nodes, edges, first.join(F.broadcast(counts), "role_to").select("id", "role_to"))


def priority() -> list[Column]:
    """Which nodes stay: roots, groups, changed ones, near ones, then the order of nodes."""
    return [F.col("is_root").desc(), (F.col("kind") == "group").desc(), (F.col("status") != "unchanged").desc(), "depth", *node_order()]


def node_order() -> list[Column]:
    return [rank_of(F.col("kind"), KINDS), F.col("path"), F.col("line"), F.col("col"), F.col("label"), F.col("id")]


def edge_order() -> list[Column]:
    return [F.col("from_id"), rank_of(F.col("relation"), RELATIONS), F.col("to_id"), rank_of(F.col("resolution"), RESOLUTIONS)]


def collapse_overflow(nodes: DataFrame, edges: DataFrame, max_nodes: int) -> tuple[DataFrame, DataFrame, int]:
    """What ``max_nodes`` can't hold becomes a group of callers and one of dependencies; gives the count of nodes they took.

    A caller is the start of some edge. Groups take a place themselves, so the
    fewest places reserved for them (0 to 2) that suffice are. Only the nodes
    that stay, ``max_nodes`` at most, reach the driver.
    """
    starts = edges.select(F.col("from_id").alias("id")).distinct().withColumn("calls", F.lit(True))
    seen = durable(nodes.join(starts, "id", "left").withColumn("calls", F.coalesce("calls", F.lit(False))))
    loose = ~F.col("is_root") & (F.col("kind") != "group")
    total = seen.agg(F.count("*").alias("n"), F.count_if(loose & F.col("calls")).alias("callers"), F.count_if(loose & ~F.col("calls")).alias("dependencies")).first()
    if total.n <= max_nodes:
        return nodes, edges, 0
    top = seen.orderBy(*priority()).limit(max_nodes).select("id", "calls", loose.alias("loose")).collect()
    for reserve in range(3):
        kept = top[: max_nodes - reserve]
        over = {"callers": total.callers - sum(r.loose and r.calls for r in kept), "dependencies": total.dependencies - sum(r.loose and not r.calls for r in kept)}
        if sum(n > 1 for n in over.values()) <= reserve:
            break
    stay = seen.sparkSession.createDataFrame([(r.id,) for r in kept], "id string")
    role = F.when(F.col("calls"), "callers").otherwise("dependencies")
    roles = seen.filter(loose).join(F.broadcast(stay), "id", "left_anti").select("id", role.alias("role_to")).filter(F.col("role_to").isin([k for k, n in over.items() if n > 1]))
    return *regroup(nodes, edges, roles), sum(n for n in over.values() if n > 1)


def reached_from(edges: DataFrame, roots: DataFrame, direction: str, depth: int) -> DataFrame:
    """id, depth and is_root of what roots (id) reach over edges (from_id, to_id)."""
    found = walk(edges, roots, direction, depth)
    return found.withColumn("is_root", F.col("depth") == 0)
