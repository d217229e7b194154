"""Queries over relations, diagnostics and graphs: each applies an operator to the driver's tables, beside its SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import paths
from ..operators import compare, edges, graph, ranking
from ..operators import impact as ops
from ..operators.durable import durable, shared_dir
from . import analysis, answers, inputs, render
from .oracles import sql
from .queries import _GRAPH, _graph, _trees, query

# ---- inventory, diagnostics, orders


@query(
    sql(
        """WITH x AS (SELECT doc_id, l, sum(s) AS net FROM (SELECT doc_id, unnest(string_split(CASE WHEN right(target_text, 1) = chr(10) THEN left(target_text, length(target_text) - 1) ELSE target_text END, chr(10))) AS l, 1 AS s FROM repo WHERE in_base AND in_target AND target_text <> ''
UNION ALL SELECT doc_id, unnest(string_split(CASE WHEN right(base_text, 1) = chr(10) THEN left(base_text, length(base_text) - 1) ELSE base_text END, chr(10))), -1 FROM repo WHERE in_base AND in_target AND base_text <> '') GROUP BY doc_id, l),
d AS (SELECT doc_id, sum(greatest(net, 0)) AS a, sum(greatest(-net, 0)) AS r FROM x GROUP BY doc_id)
SELECT count(*) AS files, CAST(coalesce(sum(a), 0) AS BIGINT) AS added, CAST(coalesce(sum(r), 0) AS BIGINT) AS removed, CAST(count(*) FILTER (repo.doc_id % 17 = 0) AS BIGINT) AS binary_files FROM repo LEFT JOIN d ON d.doc_id = repo.doc_id WHERE in_base AND in_target""",
        "repo",
    )
)
def inventory_summary(spark, sf_dir):
    repo = inputs.repository(spark, sf_dir).filter("in_base and in_target")
    lines = compare.line_delta(repo.select(F.col("doc_id").alias("id"), F.col("base_text").alias("before"), F.col("target_text").alias("after")))
    return compare.inventory_summary(lines.withColumn("is_binary", F.col("id") % 17 == 0))


@query(
    sql(
        """WITH s AS (SELECT row_number() OVER (ORDER BY coalesce(t, b), b NULLS FIRST) AS place, b AS base_path, t AS target_path, status FROM (WITH g AS (SELECT *, row_number() OVER (PARTITION BY old_blob ORDER BY path) AS k FROM fs WHERE status = 'deleted'),
a AS (SELECT *, row_number() OVER (PARTITION BY new_blob ORDER BY path) AS k FROM fs WHERE status = 'added') SELECT g.path AS b, a.path AS t, CASE WHEN g.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'deleted' ELSE 'renamed' END AS status
FROM g FULL OUTER JOIN a ON g.old_blob = a.new_blob AND g.k = a.k UNION ALL SELECT path, path, status FROM fs WHERE status = 'modified')) SELECT place, base_path, target_path, status FROM s WHERE place <= 200""",
        "trees",
    )
)
def inventory_order(spark, sf_dir):
    rows = compare.exact_renames(compare.file_status(*_trees(spark, sf_dir))).select("base_path", "target_path", "status")
    page = ranking.page(rows, ranking.inventory_order(), 200)
    return ranking.placed(page, ranking.inventory_order()).select("place", "base_path", "target_path", "status")


@query(sql("SELECT count(*) FILTER (path LIKE '%.ts' AND doc_id % 17 <> 0) AS supported, count(*) FILTER (NOT (path LIKE '%.ts' AND doc_id % 17 <> 0)) AS unsupported FROM roles", "roles"))
def support_counts(spark, sf_dir):
    files = inputs.role_paths(spark, sf_dir).select(paths.language(F.col("path")).alias("language"), (F.col("doc_id") % 17 == 0).alias("is_binary"))
    return analysis.support_counts(files)


_NOTICED = """n AS (SELECT doc_id, path, 'unsupported_language' AS code, 'info' AS severity, 'unsupported language' AS message, NULL AS related FROM roles WHERE NOT path LIKE '%.ts'
UNION ALL SELECT doc_id, path, 'binary_file', 'info', 'binary', NULL FROM roles WHERE doc_id % 17 = 0 UNION ALL SELECT doc_id, path, 'malformed_source', 'warning', 'malformed', NULL FROM roles WHERE lines % 5 = 0
UNION ALL SELECT doc_id, path, 'invalid_utf8', 'error', 'not UTF-8', NULL FROM roles WHERE doc_id % 29 = 0 UNION ALL SELECT doc_id, path, 'ambiguous_function_match', 'warning', 'ambiguous', x FROM roles, (VALUES ('f'), ('g')) v(x) WHERE doc_id % 6 = 0),
u AS (SELECT doc_id, path, code, severity, message, min(related) AS related FROM n GROUP BY ALL)"""


def _noticed(spark, sf_dir):
    d, files = F.col("doc_id"), inputs.role_paths(spark, sf_dir)
    said = lambda when, code, severity, message, related=None: F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(message).alias("message"), F.lit(related).cast("string").alias("related")))
    found = F.array_compact(
        F.array(
            said(paths.language(F.col("path")).isNull(), "unsupported_language", "info", "unsupported language"), said(d % 17 == 0, "binary_file", "info", "binary"), said(F.col("lines") % 5 == 0, "malformed_source", "warning", "malformed"),
            said(d % 29 == 0, "invalid_utf8", "error", "not UTF-8"), said(d % 6 == 0, "ambiguous_function_match", "warning", "ambiguous", "g"), said(d % 6 == 0, "ambiguous_function_match", "warning", "ambiguous", "f"),
        )
    )
    rows = files.select(d.alias("file_ix"), "path", F.inline(found))
    return analysis.distinct_diagnostics(rows.withColumn("range", F.lit(None).cast("struct<start_line: int, start_column: int, end_line: int, end_column: int>")))


_SEVERITY = "CASE severity WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END, list_position(['unsupported_language', 'binary_file', 'malformed_source', 'parse_error', 'invalid_utf8', 'oversized_file', 'missing_blob', 'git_error', 'ambiguous_function_match'], code), path, message"


@query(sql(f"WITH {_NOTICED} SELECT path, code, severity, related, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {_SEVERITY}) AS INT) AS place FROM u", "roles"))
def diagnostics_order(spark, sf_dir):
    return ranking.placed(_noticed(spark, sf_dir), analysis.diagnostic_order(), ["file_ix"]).select("path", "code", "severity", "related", "place")


@query(sql(f"WITH {_NOTICED} SELECT count(*) FILTER (severity = 'info') AS info, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'error') AS errors, count(*) AS total FROM u", "roles"))
def severity_totals(spark, sf_dir):
    return _noticed(spark, sf_dir).agg(*analysis.severity_counts(F.col("severity")))


@query(sql(f"WITH {_NOTICED} SELECT path, code, severity FROM u WHERE path = (SELECT min(path) FROM u WHERE severity = 'error')", "roles"))
def file_diagnostics(spark, sf_dir):
    rows = _noticed(spark, sf_dir)
    # One row.
    wanted = rows.filter("severity = 'error'").agg(F.min("path").alias("path"))
    return rows.join(F.broadcast(wanted), "path").select("path", "code", "severity")


@query(sql(f"WITH {_NOTICED} SELECT path, code FROM u WHERE related = 'f'", "roles"))
def function_diagnostics(spark, sf_dir):
    return _noticed(spark, sf_dir).filter("related = 'f'").select("path", "code")


@query(
    sql(
        "SELECT file, name, b_pos, t_pos, CAST(row_number() OVER (PARTITION BY file ORDER BY coalesce(tf, bf), name, confidence DESC, b_pos) - 1 AS INT) AS fn_ix, 'function-' || row_number() OVER (ORDER BY file, coalesce(tf, bf), name, confidence DESC, b_pos) AS id FROM d", "churn"
    )
)
def function_ids(spark, sf_dir):
    rows = inputs.matched(spark, sf_dir).withColumnRenamed("file", "file_ix")
    order = [F.coalesce("t.first", "b.first"), "name", F.col("confidence").desc(), F.col("b.pos")]
    return analysis.numbered(rows, order).select(F.col("file_ix").alias("file"), "name", F.col("b.pos").cast("long").alias("b_pos"), F.col("t.pos").cast("long").alias("t_pos"), "fn_ix", "id")


@query(sql("SELECT function_id FROM sl WHERE contains(function_id, '#fn:3@base') ORDER BY function_id LIMIT 10", "scores"))
def closest_functions(spark, sf_dir):
    return answers.suggestions(inputs.scored_functions(spark, sf_dir).select("function_id"), "#fn:3@base", ["function_id"])


_RANK = "max(CASE WHEN status <> 'unchanged' THEN CASE {} WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END ELSE 0 END)"
_NAME = "CASE max({}) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END"


@query(
    sql(
        f"""WITH f AS (SELECT path, sum(lines_added) AS la, sum(lines_removed) AS lr, sum(coalesce(bcyc, 0)) AS cb, sum(coalesce(tcyc, 0)) AS ca, sum(coalesce(bcog, 0)) AS gb, sum(coalesce(tcog, 0)) AS ga, {_RANK.format("risk_level")} AS r, {_RANK.format("priority_level")} AS p FROM sl GROUP BY path),
a AS (SELECT *, CASE WHEN split_part(path, '/', 1) = 'packages' THEN split_part(path, '/', 1) || '/' || split_part(path, '/', 2) ELSE split_part(path, '/', 1) END AS area FROM f)
SELECT area, count(*) AS files, CAST(sum(la) AS BIGINT) AS added_lines, CAST(sum(lr) AS BIGINT) AS removed_lines, CAST(sum(cb) AS BIGINT) AS cyclomatic_before, CAST(sum(ca) AS BIGINT) AS cyclomatic_after, CAST(sum(gb) AS BIGINT) AS cognitive_before, CAST(sum(ga) AS BIGINT) AS cognitive_after,
{_NAME.format("r")} AS risk_level, {_NAME.format("p")} AS priority_level FROM a GROUP BY area""",
        "scores",
    )
)
def area_totals(spark, sf_dir):
    rows = inputs.scored_functions(spark, sf_dir)
    level = lambda c: answers.level_of_rank(F.max(F.when(F.col("status") != "unchanged", answers.level_rank(F.col(c))).otherwise(0))).alias(c)
    sums = {"added_lines": "lines_added", "removed_lines": "lines_removed", "cyclomatic_before": "cyclomatic_before", "cyclomatic_after": "cyclomatic_after", "cognitive_before": "cognitive_before", "cognitive_after": "cognitive_after"}
    files = rows.groupBy("path").agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(n) for n, c in sums.items()], level("risk_level"), level("priority_level"))
    files = files.withColumns({"area": paths.change_area(F.col("path")), "source_loc_before": F.lit(0), "source_loc_after": F.lit(0)})
    return answers.areas(files).drop("source_loc_before", "source_loc_after")


# ---- calls


def _chain(spark, sf_dir):
    """Parts as modules that forward names along a chain, bind one another and call what they bind."""
    p = F.col("p_partkey")
    parts = inputs.read(spark, sf_dir, "part").select("p_partkey")
    # One row.
    parts = parts.join(F.broadcast(parts.agg(F.count("*").alias("n")))).select(F.lit("target").alias("side"), p.cast("string").alias("path"), p.alias("p"), "n")
    p, own = F.col("p"), F.col("p") % 7 == 0
    names = F.when(p % 2 == 0, F.array(F.lit("x"), F.lit("default"))).otherwise(F.array(F.lit("x")))
    exports = parts.select("side", "path", F.explode(names).alias("exported"), own.alias("own"), (own & (p % 3 != 0)).alias("f")).select(
        "side", "path", "exported", F.col("exported").alias("local"), F.when(~F.col("own"), "n").alias("from_specifier"), F.when(F.col("f"), F.lit(0)).alias("fn_ix")
    )
    forward, bound = F.struct(F.lit("n").alias("specifier"), ((p * 5 + 1) % F.col("n")).alias("t")), F.struct(F.lit("s").alias("specifier"), F.when(p % 11 != 0, (p * 3 + 2) % F.col("n")).alias("t"))
    targets = parts.select("side", "path", F.inline(F.array(forward, bound))).select("side", "path", "specifier", F.col("t").cast("string").alias("target"))
    functions = parts.select("side", "path", F.lit(0).alias("fn_ix"), F.concat(F.lit("a.x"), (p % 5).cast("string")).alias("qualified_name"), F.struct(p.cast("int").alias("start_line"), F.lit(0).alias("start_column"), p.cast("int").alias("end_line"), F.lit(1).alias("end_column")).alias("place"))
    kind = F.when(p % 4 == 0, "default").when(p % 4 == 2, "namespace").otherwise("named")
    bindings = parts.select("side", "path", F.lit("c").alias("local"), kind.alias("imported_kind"), F.when(kind == "named", "x").alias("imported"), F.lit("s").alias("specifier"))
    site = lambda name, receiver: F.struct(F.lit(name).alias("name"), F.lit(receiver).cast("string").alias("receiver"))
    sites = parts.select("side", "path", F.inline(F.array(site("c", None), site("x", "c"), site("x1", "obj"))))
    return sites, bindings, targets, exports, functions


_CHAIN = """n AS (SELECT count(*) AS n FROM part), e AS (SELECT p_partkey AS k, nm, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE (p_partkey * 5 + 1) % n END AS f, p_partkey % 7 = 0 AND p_partkey % 3 <> 0 AS fn FROM part, n, (VALUES ('x'), ('default')) v(nm) WHERE nm = 'x' OR p_partkey % 2 = 0),
w AS (SELECT k AS start, nm, k AS cur, 0 AS hops FROM e UNION ALL SELECT w.start, w.nm, e.f, w.hops + 1 FROM w JOIN e ON e.k = w.cur AND e.nm = w.nm WHERE e.f IS NOT NULL AND w.hops < 4),
def AS (SELECT w.start, w.nm, w.cur, w.hops FROM w JOIN e ON e.k = w.cur AND e.nm = w.nm WHERE e.f IS NULL AND e.fn)"""


@query(
    f"""WITH RECURSIVE {_CHAIN}, c AS (SELECT p_partkey AS k, name, receiver, CASE WHEN p_partkey % 4 = 2 AND receiver IS NOT NULL THEN name WHEN p_partkey % 4 = 0 AND receiver IS NULL THEN 'default' WHEN p_partkey % 4 IN (1, 3) AND receiver IS NULL THEN 'x' END AS wanted, CASE WHEN p_partkey % 11 <> 0 THEN (p_partkey * 3 + 2) % n END AS module
FROM part, n, (VALUES ('c', NULL), ('x', 'c')) v(name, receiver))
SELECT CAST(c.k AS VARCHAR) AS path, c.name, c.receiver, CAST(def.cur AS VARCHAR) AS def_path, CASE WHEN def.hops = 0 THEN 'imported_symbol' ELSE 're_exported_symbol' END AS resolution FROM c JOIN def ON def.start = c.module AND def.nm = c.wanted"""
)
def imported_calls(spark, sf_dir):
    return ops.imported_calls(*_chain(spark, sf_dir)).select("path", "name", "receiver", "def_path", "resolution")


@query(
    f"""WITH RECURSIVE {_CHAIN}, o AS (SELECT p_partkey AS k, 'x' AS name, (p_partkey * 3 + 2) % n AS module FROM part, n WHERE p_partkey % 11 <> 0),
own AS (SELECT p_partkey AS k, 'x' || (p_partkey % 5) AS name, p_partkey AS d FROM part), a AS (SELECT k, name, d FROM own WHERE name = 'x1' UNION SELECT o.k, 'x', def.cur FROM o JOIN def ON def.start = o.module AND def.nm = 'x'),
s AS (SELECT k, name, min(d) AS d FROM a GROUP BY k, name HAVING count(*) = 1)
SELECT CAST(s.k AS VARCHAR) AS path, name, CASE name WHEN 'x' THEN 'c' ELSE 'obj' END AS receiver, CAST(d AS VARCHAR) AS def_path FROM s"""
)
def guessed_calls(spark, sf_dir):
    sites, _, targets, exports, functions = _chain(spark, sf_dir)
    imports = targets.filter("specifier = 's' and target is not null").select("side", F.col("path").alias("importer"), "target")
    return ops.guessed_calls(sites, imports, targets, exports, functions).select("path", "name", "receiver", "def_path")


_CALLS = """c AS (SELECT file || ':' || name AS from_id, file || ':' || (p % 4) AS to_id, CASE WHEN s % 5 = 0 THEN 'possible_call' ELSE 'calls' END AS relation, CASE WHEN l_returnflag = 'R' THEN 'base' ELSE 'target' END AS side, pos AS line,
CASE WHEN s % 5 = 0 THEN 'property_name_match' WHEN p % 3 = 0 THEN 'imported_symbol' WHEN p % 3 = 1 THEN 're_exported_symbol' ELSE 'direct_local_symbol' END AS resolution FROM li),
g AS (SELECT from_id, to_id, relation, bool_or(side = 'base') AS b, bool_or(side = 'target') AS t, min(line) FILTER (side = 'base') AS bl, min(line) FILTER (side = 'target') AS tl,
arg_min(resolution, CASE resolution WHEN 'property_name_match' THEN 0 WHEN 're_exported_symbol' THEN 1 WHEN 'direct_local_symbol' THEN 2 ELSE 3 END) AS resolution FROM c GROUP BY ALL)"""


@query(sql(f"WITH {_CALLS} SELECT from_id, to_id, relation, resolution, CASE WHEN b AND t THEN 'unchanged' WHEN t THEN 'added' ELSE 'removed' END AS status, CAST(CASE WHEN t THEN tl ELSE bl END AS INT) AS evidence_line FROM g", "sides"))
def call_edges(spark, sf_dir):
    li, file = inputs.order_lines(spark, sf_dir), F.col("file").cast("string")
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    guess = s % 5 == 0
    resolution = F.when(guess, "property_name_match").when(p % 3 == 0, "imported_symbol").when(p % 3 == 1, "re_exported_symbol").otherwise("direct_local_symbol")
    rows = li.select(
        F.concat(file, F.lit(":"), "name").alias("from_id"), F.concat(file, F.lit(":"), (p % 4).cast("string")).alias("to_id"), F.when(guess, "possible_call").otherwise("calls").alias("relation"),
        F.when(F.col("l_returnflag") == "R", "base").otherwise("target").alias("side"), F.col("pos").alias("line"), resolution.alias("resolution"), file.alias("site"),
    )
    return ops.merged_calls(rows).select("from_id", "to_id", "relation", "resolution", "status", "evidence_line")


@query(
    sql(
        """WITH c AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'base' ELSE 'target' END AS side, file, name, p % 8 AS called, CASE WHEN p % 3 <> 0 THEN s % 3 END AS receiver, pos % 5 AS line, p % 2 = 0 AS found FROM li)
SELECT side, count(*) AS n FROM (SELECT side, file, name, called, receiver, line FROM c EXCEPT SELECT side, file, name, called, receiver, line FROM c WHERE found) GROUP BY side""",
        "sides",
    )
)
def unresolved_calls(spark, sf_dir):
    li = inputs.order_lines(spark, sf_dir)
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    sites = li.select(
        F.when(F.col("l_returnflag") == "R", "base").otherwise("target").alias("side"), F.col("file").cast("string").alias("path"), F.col("name").alias("start_line"), F.lit(0).alias("start_column"),
        (p % 8).cast("string").alias("name"), F.when(p % 3 != 0, (s % 3).cast("string")).alias("receiver"), (F.col("pos") % 5).alias("line"), (p % 2 == 0).alias("found"),
    )
    return ops.unresolved_calls(sites, sites.filter("found"), "delta").groupBy("side").agg(F.count("*").alias("n"))


# ---- module graphs


def _links(spark, sf_dir):
    """Import rows (importer, target, line, side) and files (path, side) of both sides."""
    rows = inputs.resolved(spark, sf_dir)
    return rows.filter("target is not null").select(F.col("path").alias("importer"), "target", "line", "side"), inputs.imports(spark, sf_dir)[1]


def _tested(imports, files):
    side = lambda d, s: d.filter(F.col("side") == s).drop("side")
    return ops.sided(*[edges.related_tests(side(imports, s), side(files, s)) for s in ("base", "target")])


_TESTED = """tl AS (SELECT DISTINCT side, target AS path, path AS test, 'test_imports_module' AS resolution FROM res WHERE target IS NOT NULL AND starts_with(path, 'tests/')),
sm AS (SELECT side, path, split_part(split_part(path, '/', -1), '.', 1) AS stem FROM files), ts AS (SELECT a.side, a.path, b.path AS test FROM sm a JOIN sm b ON a.side = b.side AND a.stem = b.stem AND starts_with(b.path, 'tests/')),
al AS (SELECT * FROM tl UNION ALL SELECT side, path, test, 'test_name_matches_module' FROM (SELECT * FROM ts EXCEPT SELECT side, path, test FROM tl))"""


@query(
    sql(
        f"""WITH {_TESTED}, rc AS (SELECT DISTINCT path FROM files WHERE doc_id % 3 = 0)
SELECT 'module:' || test AS from_id, 'module:' || path AS to_id, resolution, CASE WHEN count(*) = 2 THEN 'unchanged' WHEN min(side) = 'target' THEN 'added' ELSE 'removed' END AS status FROM al WHERE path IN (SELECT path FROM rc) GROUP BY test, path, resolution""",
        "imports",
    )
)
def tested_by_edges(spark, sf_dir):
    reached = inputs.repository(spark, sf_dir).filter("doc_id % 3 = 0 and (in_base or in_target)").select("path", F.lit(0).alias("depth"))
    return ops.test_relations(_tested(*_links(spark, sf_dir)), reached)[0].select("from_id", "to_id", "resolution", "status")


@query(
    sql(
        f"""{_GRAPH}, {_TESTED}, s2 AS (SELECT id, min(depth) AS depth FROM w WHERE depth <= 2 GROUP BY id), t2 AS (SELECT al.test AS id, min(s2.depth) + 1 AS depth FROM al JOIN s2 ON s2.id = al.path GROUP BY al.test)
SELECT 'module:' || x.id AS id, split_part(x.id, '/', -1) AS label, CAST(min(x.depth) AS INT) AS depth, any_value(CASE WHEN NOT in_base THEN 'added' WHEN NOT in_target THEN 'removed' WHEN edited THEN 'modified' ELSE 'unchanged' END) AS status FROM (SELECT * FROM s2 UNION ALL SELECT * FROM t2) x JOIN repo ON repo.path = x.id GROUP BY x.id""",
        "imports",
        recursive=True,
    )
)
def module_graph_nodes(spark, sf_dir):
    imports, files = _links(spark, sf_dir)
    statuses, reached = _module_walk(spark, sf_dir, imports)
    tests = ops.test_relations(_tested(imports, files), reached)[1].withColumn("is_root", F.lit(False))
    return ops.nearest(ops.module_nodes(reached, statuses).unionByName(ops.module_nodes(tests, statuses))).select("id", "label", "depth", "status")


def _module_walk(spark, sf_dir, imports):
    from .queries import _ROOTS

    status = F.when(~F.col("in_base"), "added").when(~F.col("in_target"), "removed").when(F.col("edited"), "modified").otherwise("unchanged")
    statuses = inputs.repository(spark, sf_dir).select("path", status.alias("status"))
    both = imports.select(F.col("importer").alias("from_id"), F.col("target").alias("to_id"))
    start = spark.createDataFrame([(r,) for r in _ROOTS], "id string")
    return statuses, durable(ops.reached_from(both, start, "both", 2).withColumnRenamed("id", "path"))


@query(
    sql(
        f"""{_GRAPH}, s2 AS (SELECT id FROM w WHERE depth <= 2)
SELECT 'module:' || importer AS from_id, 'module:' || target AS to_id, status, importer AS evidence_file, line AS evidence_line FROM edges WHERE importer IN (SELECT id FROM s2) AND target IN (SELECT id FROM s2)""",
        "imports",
        recursive=True,
    )
)
def module_graph_edges(spark, sf_dir):
    imports, _ = _links(spark, sf_dir)
    return ops.import_relations(imports, _module_walk(spark, sf_dir, imports)[1]).select("from_id", "to_id", "status", "evidence_file", "evidence_line")


@query(
    sql(
        """SELECT 'module:' || path AS from_id, 'module:' || target AS to_id, CASE WHEN count(*) = 2 THEN 'unchanged' WHEN min(side) = 'target' THEN 'added' ELSE 'removed' END AS status,
CAST(CASE WHEN bool_or(side = 'target') THEN min(line) FILTER (side = 'target') ELSE min(line) END AS INT) AS evidence_line FROM (SELECT side, path, target, min(line) AS line FROM res WHERE target IS NOT NULL GROUP BY ALL)
WHERE CAST(regexp_extract(path, 'd(\\d+)', 1) AS INT) % 4 = 2 GROUP BY path, target""",
        "imports",
    )
)
def re_export_edges(spark, sf_dir):
    imports, _ = _links(spark, sf_dir)
    forwards = imports.filter(F.col("importer").endswith("/index.ts")).select(F.col("importer").alias("path"), "target", "side")
    reached = inputs.repository(spark, sf_dir).select("path")
    return ops.re_export_relations(forwards, imports, reached).select("from_id", "to_id", "status", "evidence_line")


def _completeness(view: str) -> str:
    sides = {"delta": "'base', 'target'", "base": "'base'", "target": "'target'"}[view]
    return f"""SELECT '{view}' AS view, (SELECT count(*) FROM files WHERE doc_id % 19 = 0 AND doc_id % 3 = 0 AND side IN ({sides})) AS scan_truncated_files,
(SELECT count(*) FROM res JOIN files f ON f.side = res.side AND f.path = res.path WHERE target IS NULL AND f.doc_id % 3 = 0 AND res.side IN ({sides})) AS unresolved_specifiers"""


@query(sql(" UNION ALL ".join(_completeness(v) for v in ("delta", "base", "target")), "imports"))
def graph_completeness(spark, sf_dir):
    specifiers = durable(inputs.resolved(spark, sf_dir))
    repo = inputs.repository(spark, sf_dir)
    files = inputs.imports(spark, sf_dir)[1].join(repo.select("path", "doc_id"), "path").withColumn("truncated", F.col("doc_id") % 19 == 0)
    scope = files.filter("doc_id % 3 = 0").select("path", "side")
    rows = [ops.completeness(files, specifiers, scope, v).select(F.lit(v).alias("view"), "*") for v in ("delta", "base", "target")]
    return rows[0].union(rows[1]).union(rows[2])


@query(
    sql(
        """WITH f AS (SELECT min(file) AS f FROM m) SELECT 'module:m' AS from_id, coalesce(b_pos, 0) || '/' || coalesce(t_pos, 0) AS to_id, CASE WHEN b_pos IS NULL THEN 'added' WHEN t_pos IS NULL THEN 'removed' ELSE 'unchanged' END AS status FROM m, f WHERE file = f AND coalesce(t_pos, b_pos) % 3 <> 2""",
        "sides",
    )
)
def contains_edges(spark, sf_dir):
    m = inputs.matched(spark, sf_dir)
    first = m.agg(F.min("file").alias("file"))  # one row
    pos = lambda s: F.coalesce(F.col(f"{s}.pos").cast("string"), F.lit("0"))
    rows = m.join(F.broadcast(first), "file").select(F.concat(pos("b"), F.lit("/"), pos("t")).alias("id"), F.col("b").isNotNull().alias("in_base"), F.col("t").isNotNull().alias("in_target"), F.coalesce("t.pos", "b.pos").alias("pos"))
    return ops.contains_relations("m", rows, rows.filter("pos % 3 <> 2")).select("from_id", "to_id", "status")


# ---- groups


def _roles_graph(spark, sf_dir):
    """Every document as a module under a path of some role, importing and testing others."""
    d = F.col("doc_id")
    files = inputs.role_paths(spark, sf_dir).select("doc_id", "path")
    status = F.element_at(F.array(*[F.lit(s) for s in ("added", "removed", "modified", "unchanged")]), (d % 4 + 1).cast("int"))
    nodes = files.select(
        ops.module_id(F.col("path")).alias("id"), F.lit("module").alias("kind"), F.substring_index("path", "/", -1).alias("label"), "path", F.lit(0).alias("line"), F.lit(0).alias("col"), status.alias("status"),
        (d % 3 + 1).cast("int").alias("depth"), (d % 400 == 0).alias("is_root"), F.lit(None).cast("string").alias("role"), F.lit(1).cast("long").alias("size"),
    )
    n = files.agg(F.count("*").alias("n"))  # one row
    ends = files.join(F.broadcast(n))
    link = F.when(d % 9 == 1, F.struct(F.lit("tested_by").alias("relation"), ((d * 13 + 5) % F.col("n")).alias("t"), F.lit("test_imports_module").alias("resolution")))
    other = F.when(d % 3 != 0, F.struct(F.lit("imports").alias("relation"), ((d * 7 + 3) % F.col("n")).alias("t"), F.lit("resolved_specifier").alias("resolution")))
    made = ends.select("doc_id", "path", F.inline(F.array_compact(F.array(link, other))))
    to = files.select(F.col("doc_id").alias("t"), ops.module_id(F.col("path")).alias("to_id"))
    kinds = F.element_at(F.array(*[F.lit(s) for s in ("added", "removed", "unchanged")]), (d % 3 + 1).cast("int"))
    edges_ = made.join(to, "t").select(ops.module_id(F.col("path")).alias("from_id"), "relation", "to_id", "resolution", kinds.alias("status"), F.col("path").alias("evidence_file"), (d % 50).cast("int").alias("evidence_line"))
    return nodes, edges_


_ROLES = """n AS (SELECT count(*) AS n FROM roles),
nd AS (SELECT doc_id, 'module:' || path AS id, path, split_part(path, '/', -1) AS label, area, classification, (['added', 'removed', 'modified', 'unchanged'])[doc_id % 4 + 1] AS status, doc_id % 3 + 1 AS depth, doc_id % 400 = 0 AS is_root FROM cls),
ed AS (SELECT 'module:' || a.path AS from_id, relation, 'module:' || b.path AS to_id, resolution, (['added', 'removed', 'unchanged'])[a.doc_id % 3 + 1] AS status FROM
(SELECT doc_id, path, 'tested_by' AS relation, (doc_id * 13 + 5) % n AS t, 'test_imports_module' AS resolution FROM roles, n WHERE doc_id % 9 = 1 UNION ALL SELECT doc_id, path, 'imports', (doc_id * 7 + 3) % n, 'resolved_specifier' FROM roles, n WHERE doc_id % 3 <> 0) a JOIN roles b ON b.doc_id = a.t)"""
_GROUPED = """k AS (SELECT id, CASE WHEN doc_id % 9 = 1 THEN 'tests' WHEN classification IN ('generated', 'vendored', 'lockfile') THEN classification END AS role FROM nd WHERE NOT is_root),
g AS (SELECT id, role FROM k WHERE role IN (SELECT role FROM k WHERE role IS NOT NULL GROUP BY role HAVING count(*) > 1))"""
_REWIRED = """x AS (SELECT coalesce('group:' || a.role, from_id) AS from_id, relation, coalesce('group:' || b.role, to_id) AS to_id, resolution, status, from_id AS of_, to_id AS ot FROM ed LEFT JOIN g a ON a.id = from_id LEFT JOIN g b ON b.id = to_id WHERE a.role IS DISTINCT FROM b.role OR a.role IS NULL)
SELECT from_id, relation, to_id, arg_min(status, of_ || '|' || ot) AS status FROM x GROUP BY from_id, relation, to_id, resolution"""
_LABELS = "CASE role WHEN 'tests' THEN 'tests' WHEN 'generated' THEN 'generated files' WHEN 'vendored' THEN 'vendored files' WHEN 'lockfile' THEN 'lockfiles' WHEN 'callers' THEN 'callers' ELSE 'dependencies' END"
_MADE = f"""SELECT role, count(*) AS size, CAST(min(depth) AS INT) AS depth, CASE WHEN count(DISTINCT status) = 1 THEN min(status) ELSE 'unchanged' END AS status, count(*) || ' ' || {_LABELS} || CASE WHEN count(DISTINCT area) = 1 THEN ' · ' || min(area) ELSE '' END AS label FROM g JOIN nd USING (id) GROUP BY role"""


@query(sql(f"WITH {_ROLES}, {_GROUPED} {_MADE}", "roles"))
def group_known(spark, sf_dir):
    return ops.collapse_known(*_roles_graph(spark, sf_dir))[0].filter("kind = 'group'").select("role", "size", "depth", "status", "label")


@query(sql(f"WITH {_ROLES}, {_GROUPED}, {_REWIRED}", "roles"))
def group_known_edges(spark, sf_dir):
    return ops.collapse_known(*_roles_graph(spark, sf_dir))[1].select("from_id", "relation", "to_id", "status")


_OVER = """top AS (SELECT id FROM nd ORDER BY NOT is_root, status = 'unchanged', depth, path, label, id LIMIT 38),
g AS (SELECT id, CASE WHEN id IN (SELECT from_id FROM ed) THEN 'callers' ELSE 'dependencies' END AS role FROM nd WHERE NOT is_root AND id NOT IN (SELECT id FROM top))"""


@query(sql(f"WITH {_ROLES}, {_OVER} {_MADE}", "roles"))
def group_overflow(spark, sf_dir):
    return ops.collapse_overflow(*_roles_graph(spark, sf_dir), 40)[0].filter("kind = 'group'").select("role", "size", "depth", "status", "label")


@query(sql(f"WITH {_ROLES}, v AS (SELECT * FROM ed WHERE status IN ('removed', 'unchanged')) SELECT id, status FROM nd WHERE is_root OR id IN (SELECT from_id FROM v UNION SELECT to_id FROM v)", "roles"))
def view_nodes(spark, sf_dir):
    return ops.in_view(*_roles_graph(spark, sf_dir), "base")[0].select("id", "status")


# ---- answers, as rows only


def _delivered(spark, sf_dir):
    nodes, links = _graph(spark, sf_dir)
    kept, found = graph.truncate(nodes, links, 30, 60)
    return [r.asDict() for r in kept.orderBy("key").collect()], [r.asDict() | {"confidence": 1.0} for r in found.collect()]


@query()
def render_diff(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in render.dependency_lines(*_delivered(spark, sf_dir)).splitlines()], "line string")


@query()
def render_mermaid(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in render.mermaid(*_delivered(spark, sf_dir)).splitlines()], "line string")


def _generated(spark, sf_dir) -> tuple[str, str, str]:
    """A repository made of the nations: a module each, changed in its second commit; in the shared folder, as tasks read it."""
    import atexit
    import shutil
    import subprocess
    import uuid
    from pathlib import Path

    at = shared_dir(spark).removeprefix("file://")
    if "://" in at:
        raise ValueError("Git needs a shared folder that is mounted")
    rows = inputs.read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    root = Path(at) / f"repository-{uuid.uuid4().hex}"
    root.mkdir(parents=True)
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True).stdout.decode().strip()
    run("init", "-q")
    commits = []
    for more in ("", " || a > 2"):
        for r in rows:
            key, region = r.n_nationkey, r.n_regionkey
            calls = f"import {{ f{region} }} from './n{region}';\n" if key != region else ""
            at = root / "src" / f"n{key}.ts"
            at.parent.mkdir(exist_ok=True)
            at.write_text(f"{calls}export function f{key}(a) {{\n  if (a > {key}{more if key % 3 else ''}) {{ return {f'f{region}(a)' if calls else 'a'}; }}\n  return 0;\n}}\n")
        run("add", "-A")
        run("commit", "-q", "-m", "x")
        commits.append(run("rev-parse", "HEAD"))
    return str(root), *commits


@query()
def git_analyze(spark, sf_dir):
    found = analysis.analyze(spark, *_generated(spark, sf_dir))
    return found.functions.select("path", "symbol", "status", "confidence", "lines_added", "lines_removed", "changed_hunks")


@query()
def envelope(spark, sf_dir):
    from .session import Session

    answer = Session(spark).answer("list_changed_functions", *_generated(spark, sf_dir), {"limit": 5})
    return spark.createDataFrame([(json.dumps(answer, sort_keys=True),)], "answer string")
