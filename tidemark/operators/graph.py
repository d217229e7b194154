"""Bounded walks over edges, and what is made of the nodes and edges reached."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .durable import durable

# The order of relations and of resolutions, and what collapses into groups, in order.
RELATIONS = ("calls", "imports", "re_exports", "references_type", "extends", "implements", "tested_by", "contains", "possible_call")
KINDS = ("module", "function", "group")
COLLAPSED = ("tests", "generated", "vendored", "lockfile")
MAX_DEPTH = 3


def rank_of(column: Column, names: tuple[str, ...]) -> Column:
    """Place of a value among names in their fixed order, from 1."""
    return F.array_position(F.array(*[F.lit(n) for n in names]), column)


def walk(edges: DataFrame, roots: DataFrame, direction: str = "both", depth: int = 1) -> DataFrame:
    """id and depth (fewest hops) of what roots (id) reach over edges (from_id, to_id), ``depth`` hops at most.

    ``downstream`` follows edges, ``upstream`` goes against them. Each hop is a
    join of the frontier and an anti-join of what was seen, so paths that meet
    don't multiply.
    """
    if direction not in ("upstream", "downstream", "both") or not 0 <= depth <= MAX_DEPTH:
        raise ValueError("direction is upstream, downstream or both, depth 0 to 3")
    down = edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("next"))
    up = edges.select(F.col("to_id").alias("id"), F.col("from_id").alias("next"))
    # Each hop reads the edges again, so they are cut from their own plan once.
    steps = durable({"downstream": down, "upstream": up, "both": down.union(up)}[direction].distinct())
    seen = frontier = roots.select("id").distinct().withColumn("depth", F.lit(0))
    for hop in range(1, depth + 1):
        reached = frontier.select("id").join(steps, "id").select(F.col("next").alias("id")).distinct()
        frontier = reached.join(seen, "id", "left_anti").withColumn("depth", F.lit(hop))
        seen = seen.union(frontier)
    return seen


def reachable_importers(edges: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """id and depth of what imports ``start`` (id) within ``depth`` hops, without the start."""
    return walk(edges, start, "upstream", depth).filter("depth > 0")


def truncate(nodes: DataFrame, edges: DataFrame, max_nodes: int, max_edges: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges kept, with their keys.

    Nodes (id, kind, path, label, start_line, status, depth, is_root) are kept
    by priority: roots, groups, changed ones, near ones. Edges (from_id,
    relation, to_id) follow if both ends stay, in their order, up to a bound.
    Both bounds are features of the answer; top-k keeps no more than that.
    """
    priority = [F.col("is_root").desc(), (F.col("kind") == "group").desc(), (F.col("status") != "unchanged").desc(), "depth", rank_of(F.col("kind"), KINDS), "path", "start_line", "label", "id"]
    kept = nodes.orderBy(*priority).limit(max_nodes)
    place = Window.orderBy(rank_of(F.col("kind"), KINDS), "path", "start_line", "label", "id")
    kept = kept.withColumn("key", F.concat(F.lit("n"), (F.row_number().over(place) - 1).cast("string")))
    ids = kept.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return kept, inside.orderBy("from_id", rank_of(F.col("relation"), RELATIONS), "to_id").limit(max_edges)


def collapse(nodes: DataFrame, edges: DataFrame, role: str, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One group node for ``members`` (id) that aren't roots, if there are two or more; edges rewritten and merged.

    nodes: id, kind, path, status, depth, is_root, area, size; edges: from_id,
    relation, to_id, status. A group has its members' status and area where
    they share one, else unchanged and none; edges inside it go. Of edges that
    become one the first in edge order stays.
    """
    group_id = f"group:{role}"
    chosen = nodes.filter("not is_root").join(members.select("id").distinct(), "id", "left_semi")
    group = chosen.agg(F.count("*").alias("size"), F.min("depth").alias("depth"), F.count_distinct("status").alias("s"), F.min("status").alias("status"), F.count_distinct("area").alias("a"), F.min("area").alias("area")).filter("size >= 2")
    group = group.select(
        F.lit(group_id).alias("id"), F.lit("group").alias("kind"), F.lit("").alias("path"), F.when(F.col("s") == 1, F.col("status")).otherwise("unchanged").alias("status"), "depth", F.lit(False).alias("is_root"), F.when(F.col("a") == 1, F.col("area")).otherwise("").alias("area"), "size"
    )
    gone = chosen.select("id").join(F.broadcast(group.select(F.col("id").alias("g"))))
    left = nodes.join(gone.select("id"), "id", "left_anti").select("id", "kind", "path", "status", "depth", "is_root", "area", "size")
    edges = edges.withColumn("old", F.struct("from_id", rank_of(F.col("relation"), RELATIONS), "to_id"))
    for end in ("from_id", "to_id"):
        edges = edges.join(gone.withColumnRenamed("id", end), end, "left").withColumn(end, F.coalesce("g", end)).drop("g")
    merged = edges.filter("not (from_id = to_id and from_id like 'group:%')").groupBy("from_id", "relation", "to_id").agg(F.min_by("status", "old").alias("status"))
    return left.unionByName(group), merged


#: Edges that one task may hold: pieces up to this size are solved in place.
LOCAL_EDGES = 1_000_000


def strong_classes(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(key, member) of each class of nodes that reach one another over ``pairs``: one walk in depth, without recursion."""
    onward: dict[str, list[str]] = {}
    for a, b in pairs:
        onward.setdefault(a, []).append(b)
        onward.setdefault(b, [])
    seen: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    on_stack: set[str] = set()
    out = []
    for start in onward:
        todo = [(start, 0)] if start not in seen else []
        while todo:
            node, k = todo.pop()
            if k == 0:
                seen[node] = low[node] = len(seen)
                stack.append(node)
                on_stack.add(node)
            else:
                low[node] = min(low[node], low[onward[node][k - 1]]) if onward[node][k - 1] in on_stack else low[node]
            for i in range(k, len(onward[node])):
                after = onward[node][i]
                if after not in seen:
                    todo += [(node, i + 1), (after, 0)]
                    break
                if after in on_stack:
                    low[node] = min(low[node], seen[after])
            else:
                if low[node] == seen[node]:
                    members = []
                    while not members or members[-1] != node:
                        members.append(stack.pop())
                    on_stack.difference_update(members)
                    if len(members) > 1 or node in onward[node]:
                        out += [(min(members), m) for m in members]
    return out


def _local_classes(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(strong_classes(list(zip(rows.from_id, rows.to_id))), columns=["key", "member"])


def _spread(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(id, color) least over everything that reaches a node, from ``start`` (id, color), by rounds until nothing changes."""
    now = durable(start)
    while True:
        met = edges.join(now.withColumnRenamed("id", "from_id"), "from_id").groupBy(F.col("to_id").alias("id")).agg(F.min("color").alias("met"))
        grown = durable(now.join(met, "id", "left").select("id", F.least("color", F.coalesce("met", "color")).alias("color"), (F.col("met") < F.col("color")).alias("moved")))
        now = grown.select("id", "color")
        if not grown.filter("moved").limit(1).count():
            return now


def _colored_classes(edges: DataFrame) -> DataFrame:
    """(key, member) of classes in edges too many for a task.

    Nodes take the least node that reaches them as their color; what reaches
    that node back within its color is its class, and goes; then again. Rows
    grow with the edges, rounds with the longest of shortest paths.
    """
    found, left = None, durable(edges)
    while left.limit(1).count():
        nodes = left.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
        colors = _spread(left, nodes.select("id", F.col("id").alias("color")))
        by = lambda end: colors.withColumnsRenamed({"id": end, "color": f"{end}_color"})
        inside = durable(left.join(by("from_id"), "from_id").join(by("to_id"), "to_id").filter("from_id_color = to_id_color").select("from_id", "to_id", F.col("to_id_color").alias("color")))
        # Backwards from each color's own node, over edges of that color.
        reached = frontier = durable(colors.filter("id = color"))
        while frontier.limit(1).count():
            back = inside.join(frontier.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(F.col("from_id").alias("id"), "color").distinct()
            frontier = durable(back.join(reached.select("id"), "id", "left_anti"))
            reached = durable(reached.union(frontier))
        looped = inside.filter("from_id = to_id").select(F.col("from_id").alias("id")).distinct().withColumn("loop", F.lit(True))
        sizes = reached.groupBy("color").agg(F.count("*").alias("n"))
        classes = reached.join(sizes, "color").join(looped, "id", "left").filter("n > 1 or loop").select(F.col("color").alias("key"), F.col("id").alias("member"))
        found = classes if found is None else found.union(classes)
        gone = reached.select("id")
        left = durable(inside.select("from_id", "to_id").join(gone.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(gone.withColumnRenamed("id", "to_id"), "to_id", "left_anti"))
    return found


def cycles(edges: DataFrame) -> DataFrame:
    """key and member of each class of nodes that reach one another, self-loops included; key is the least member.

    Edges fall into connected pieces first. Pieces of LOCAL_EDGES edges at most
    share tasks that solve them in place; larger ones are colored by joins.
    """
    links = durable(edges.select("from_id", "to_id").distinct())
    pieces = durable(components(links.select(F.col("from_id").alias("u"), F.col("to_id").alias("v"))))
    named = links.join(pieces.withColumnRenamed("node", "from_id"), "from_id", "left").select("from_id", "to_id", F.coalesce("component", "from_id").alias("piece"))
    sizes = named.groupBy("piece").agg(F.count("*").alias("n"))
    large = durable(sizes.filter(F.col("n") > LOCAL_EDGES).select("piece"))
    # Pieces over the bound are as few as all edges over the bound.
    small = named.join(F.broadcast(large), "piece", "left_anti")
    tasks = 1 + links.count() // max(LOCAL_EDGES // 4, 1)
    local = small.groupBy(F.pmod(F.xxhash64("piece"), F.lit(tasks)).alias("task")).applyInPandas(_local_classes, "key string, member string")
    if not large.limit(1).count():
        return local
    rest = _colored_classes(named.join(F.broadcast(large), "piece", "left_semi").select("from_id", "to_id"))
    return local.union(rest) if rest is not None else local


def introduced_cycles(base: DataFrame, target: DataFrame) -> DataFrame:
    """Cycles (key, members) of the target whose member list the base doesn't have."""
    listed = lambda e: cycles(e).groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("member")), ",").alias("members"))
    return listed(target).join(listed(base).select("members"), "members", "left_anti").select("key", "members")


# Codes in report order and the least measure that gives each.
SIGNALS = (
    ("many_callers", "callers", 3),
    ("many_dependencies", "dependencies", 3),
    ("converges_and_branches", "both_sides", 2),
    ("crosses_areas", "areas", 2),
    ("changed_on_both_sides", "changed_both", 1),
    ("multiple_levels", "levels", 2),
)


def measures(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per root: callers, dependencies, areas and levels of changed edges, whether both sides changed, nodes, and the highest degree.

    nodes: root, id, area, depth; edges: root, from_id, to_id, status, seen from the root.
    """
    degrees = [edges.groupBy("root", end).agg(F.count("*").alias("n")) for end in ("from_id", "to_id")]
    degree = degrees[0].select("root", "n").union(degrees[1].select("root", "n")).groupBy("root").agg(F.max("n").alias("degree"))
    changed = F.col("status") != "unchanged"
    at_root = edges.groupBy("root").agg(
        F.count_if(F.col("to_id") == F.col("root")).alias("callers"),
        F.count_if(F.col("from_id") == F.col("root")).alias("dependencies"),
        F.count_if(changed & (F.col("to_id") == F.col("root"))).alias("changed_in"),
        F.count_if(changed & (F.col("from_id") == F.col("root"))).alias("changed_out"),
    )
    ends = edges.filter(changed).select("root", F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    levels = ends.join(nodes, ["root", "id"]).groupBy("root").agg(F.count_distinct("depth").alias("levels"))
    areas = nodes.groupBy("root").agg(F.count_distinct("area").alias("areas"), F.count_distinct("id").alias("nodes"))
    rows = areas.join(at_root, "root", "left").join(levels, "root", "left").join(degree, "root", "left").na.fill(0).withColumn("both_sides", F.least("callers", "dependencies"))
    return rows.withColumn("changed_both", ((F.col("changed_in") > 0) & (F.col("changed_out") > 0)).cast("int"))


def recommendation(rows: DataFrame) -> DataFrame:
    """Adds ``codes``: the signals reached, in report order, joined by commas.

    Fewer than four nodes without a branch are better read as lines: that signal then stands alone.
    """
    codes = F.filter(F.array(*[F.when(F.col(c) >= n, F.lit(code)) for code, c, n in SIGNALS]), lambda x: x.isNotNull())
    return rows.withColumn("codes", F.when((F.col("nodes") < 4) & (F.col("degree") <= 1), "linear_and_small").otherwise(F.array_join(codes, ",")))
