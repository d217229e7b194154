"""Import edges: specifiers resolved against a tree, edges of two sides compared, calls resolved."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import alias_target, classify, joined_specifier, stem
from .compare import membership

# Extensions that are tried after a specifier, in order.
EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".json")
CONFIDENCE = {
    "resolved_specifier": 1.0,
    "direct_local_symbol": 1.0,
    "declaration": 1.0,
    "test_imports_module": 0.9,
    "test_name_matches_module": 0.8,
    "imported_symbol": 1.0,
    "export_clause": 1.0,
    "re_exported_symbol": 0.9,
    "property_name_match": 0.5,
}


def candidates(target: Column, endings: tuple[str, ...] = EXTENSIONS) -> Column:
    """Paths that a specifier may mean, in order: itself if it has a dot, with an ending, as a folder's index."""
    exact = F.when(target.contains("."), F.array(target)).otherwise(F.array().cast("array<string>"))
    return F.concat(exact, F.array(*[F.concat(target, F.lit(e)) for e in endings]), F.array(*[F.concat(target, F.lit("/index" + e)) for e in endings]))


def specifier_targets(specifiers: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Adds ``targets``, what a specifier may stand for: relative to the importer's folder, or by aliases in rank order.

    Aliases (rank, pattern, target) come from one configuration file, so they
    are gathered to an array and broadcast.
    """
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "")).otherwise(F.lit(""))
    relative = F.array(joined_specifier(folder, F.col("specifier")))
    if aliases is None:
        return specifiers.withColumn("targets", F.when(F.col("specifier").startswith("."), relative).otherwise(F.array().cast("array<string>")))
    ranked = aliases.agg(F.array_sort(F.collect_list(F.struct("rank", "pattern", "target"))).alias("aliases"))
    by_alias = F.filter(F.transform("aliases", lambda a: alias_target(a.pattern, a.target, F.col("specifier"))), lambda x: x.isNotNull())
    return specifiers.join(F.broadcast(ranked)).withColumn("targets", F.when(F.col("specifier").startswith("."), relative).otherwise(by_alias)).drop("aliases")


def resolve(specifiers: DataFrame, tree: DataFrame, keys: list[str], endings: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """First existing candidate of each row of ``specifiers`` (keys, targets), null where none exists.

    ``tree`` has ``path`` and any of ``keys`` that tell sides apart (a column
    ``side`` in both). Candidates carry their order into one equi-join.
    """
    on = ["candidate"] + (["side"] if "side" in tree.columns else [])
    options = specifiers.select(*keys, F.posexplode_outer(F.flatten(F.transform("targets", lambda t: candidates(t, endings)))).alias("ord", "candidate"))
    found = options.join(tree.withColumnRenamed("path", "candidate").select(*on).distinct().withColumn("there", F.lit(True)), on, "left")
    return found.groupBy(*keys).agg(F.min_by("candidate", F.when(F.col("there"), F.col("ord"))).alias("target"))


def compare_edges(base: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """key, status and line of edges on two sides (key, line): the target's line, the base's for removed ones."""
    b = base.groupBy(*key).agg(F.min("line").alias("base_line"))
    t = target.groupBy(*key).agg(F.min("line").alias("target_line"))
    both = b.join(t, key, "full_outer")
    return both.select(*key, membership(F.col("base_line").isNotNull(), F.col("target_line").isNotNull()).alias("status"), F.coalesce("target_line", "base_line").alias("line"))


def in_view(edges: DataFrame, view: str) -> DataFrame:
    """Edges of one side, or all for ``delta``."""
    kept = {"base": ("removed", "unchanged"), "target": ("added", "unchanged"), "delta": ("added", "removed", "unchanged")}[view]
    return edges.filter(F.col("status").isin(*kept))


def without_isolated(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes (id) that an edge meets, and roots (id)."""
    kept = edges.select(F.col("from_id").alias("id")).union(edges.select(F.col("to_id").alias("id"))).union(roots.select("id")).distinct()
    return nodes.join(kept, "id", "left_semi")


def related_tests(edges: DataFrame, files: DataFrame) -> DataFrame:
    """path, test, resolution and confidence: tests that import a module, then tests named as it.

    ``edges`` are (importer, target), ``files`` (path). A name match counts
    where the test isn't linked by an import already.
    """
    tests = files.filter(classify(F.col("path")) == "test")
    imports = edges.select(F.col("target").alias("path"), F.col("importer").alias("test")).distinct().filter(classify(F.col("test")) == "test").withColumn("resolution", F.lit("test_imports_module"))
    names = tests.select(F.col("path").alias("test"), stem(F.col("path")).alias("stem")).filter("stem <> ''")
    same = files.select("path", stem(F.col("path")).alias("stem")).join(names, "stem").select("path", "test").join(imports.select("path", "test"), ["path", "test"], "left_anti")
    rows = imports.union(same.withColumn("resolution", F.lit("test_name_matches_module")))
    return rows.withColumn("confidence", F.when(F.col("resolution") == "test_imports_module", 0.9).otherwise(0.8))


def admitted_files(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """Changed files (path), their importers and their dependencies over edges (importer, target) of both sides."""
    by, of = edges.join(changed.withColumnRenamed("path", "target"), "target", "left_semi"), edges.join(changed.withColumnRenamed("path", "importer"), "importer", "left_semi")
    return reduce(DataFrame.union, [changed.select("path"), by.select("importer"), of.select("target")]).distinct()


def local_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls of bare names that one function of the file alone declares.

    calls: file, caller, name; functions: file, id, leaf.
    """
    unique = functions.withColumn("k", F.count("*").over(Window.partitionBy("file", "leaf"))).filter("k = 1").select("file", F.col("leaf").alias("name"), F.col("id").alias("callee"))
    return calls.join(unique, ["file", "name"])


def possible_calls(calls: DataFrame, options: DataFrame) -> DataFrame:
    """Calls (call_id, name, scope) with exactly one distinct candidate among ``options`` (scope, name, definition)."""
    found = calls.join(options.distinct(), ["scope", "name"])
    return found.groupBy("call_id").agg(F.count("*").alias("k"), F.min("definition").alias("definition")).filter("k = 1").select("call_id", "definition")


def exact_before_possible(exact: DataFrame, possible: DataFrame) -> DataFrame:
    """Union of resolved calls, where a guess counts only without a certain one."""
    return exact.select("call_id", "definition", F.lit("exact").alias("how")).union(possible.join(exact, "call_id", "left_anti").select("call_id", "definition", F.lit("possible").alias("how")))


def chase_reexports(starts: DataFrame, exports: DataFrame, hops: int = 4) -> DataFrame:
    """Follow (path, name) through ``exports`` (path, name, from_path, from_name) to a definition.

    A row whose from_path is null defines the name. ``hops`` + 1 look-ups are
    unrolled as joins; chains that are longer, break off or reach ``*`` end
    without a definition. Gives path, name, def_path, def_name, hops.
    """
    now = starts.select("path", "name", F.col("path").alias("at"), F.col("name").alias("as_name"))
    done = None
    links = exports.select(F.col("path").alias("at"), F.col("name").alias("as_name"), "from_path", "from_name")
    for hop in range(hops + 1):
        step = now.join(links, ["at", "as_name"])
        ended = step.filter("from_path is null").select("path", "name", F.col("at").alias("def_path"), F.col("as_name").alias("def_name"), F.lit(hop).alias("hops"))
        done = ended if done is None else done.union(ended)
        now = step.filter("from_path is not null and from_name <> '*'").select("path", "name", F.col("from_path").alias("at"), F.col("from_name").alias("as_name"))
    return done


