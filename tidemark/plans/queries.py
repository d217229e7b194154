"""The change-analytics queries: each applies an operator to the driver's tables, beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, scoring
from ..operators import compare, edges, graph, ranking
from ..operators.durable import durable
from . import inputs
from .oracles import sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    def put(f):
        key = name or f.__name__
        QUERIES[key] = f
        if oracle:
            ORACLE_SQL[key] = oracle
        return f

    return put


def _trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    repo = inputs.repository(spark, sf_dir)
    base = repo.filter("in_base").select("path", F.md5("base_text").alias("blob"))
    moved = F.when(F.col("doc_id") % 7 == 3, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    return base, repo.filter("in_target").select(moved.alias("path"), F.md5("target_text").alias("blob"))


# ---- files and lines


@query(sql("SELECT path, status FROM fs", "trees"))
def file_status(spark, sf_dir):
    return compare.file_status(*_trees(spark, sf_dir)).select("path", "status")


@query(
    sql(
        """WITH g AS (SELECT *, row_number() OVER (PARTITION BY old_blob ORDER BY path) AS k FROM fs WHERE status = 'deleted'),
a AS (SELECT *, row_number() OVER (PARTITION BY new_blob ORDER BY path) AS k FROM fs WHERE status = 'added')
SELECT g.path AS base_path, a.path AS target_path, CASE WHEN g.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'deleted' ELSE 'renamed' END AS status FROM g FULL OUTER JOIN a ON g.old_blob = a.new_blob AND g.k = a.k
UNION ALL SELECT path, path, status FROM fs WHERE status = 'modified'""",
        "trees",
    )
)
def rename_exact(spark, sf_dir):
    return compare.exact_renames(compare.file_status(*_trees(spark, sf_dir))).select("base_path", "target_path", "status")


_LINES = "unnest(string_split(CASE WHEN right({0}, 1) = chr(10) THEN left({0}, length({0}) - 1) ELSE {0} END, chr(10)))"


@query(
    sql(
        f"""WITH x AS (SELECT doc_id, l, sum(s) AS net FROM (SELECT doc_id, {_LINES.format("target_text")} AS l, 1 AS s FROM repo WHERE in_base AND in_target AND target_text <> ''
UNION ALL SELECT doc_id, {_LINES.format("base_text")}, -1 FROM repo WHERE in_base AND in_target AND base_text <> '') GROUP BY doc_id, l)
SELECT doc_id AS id, CAST(sum(greatest(net, 0)) AS BIGINT) AS added, CAST(sum(greatest(-net, 0)) AS BIGINT) AS removed FROM x GROUP BY doc_id""",
        "repo",
    )
)
def line_delta(spark, sf_dir):
    repo = inputs.repository(spark, sf_dir).filter("in_base and in_target")
    return compare.line_delta(repo.select(F.col("doc_id").alias("id"), F.col("base_text").alias("before"), F.col("target_text").alias("after")))


@query(sql("SELECT count(*) AS files, CAST(count(*) FILTER (status = 'added') AS BIGINT) AS added, CAST(count(*) FILTER (status = 'deleted') AS BIGINT) AS deleted, CAST(count(*) FILTER (status = 'modified') AS BIGINT) AS modified FROM fs", "trees"))
def change_summary(spark, sf_dir):
    rows = compare.file_status(*_trees(spark, sf_dir))
    return rows.agg(F.count("*").alias("files"), *[F.count_if(F.col("status") == s).alias(s) for s in ("added", "deleted", "modified")])


@query(sql("SELECT doc_id, path, classification, area FROM cls", "roles"))
def classify_paths(spark, sf_dir):
    p = F.col("path")
    return inputs.role_paths(spark, sf_dir).select("doc_id", "path", paths.classify(p).alias("classification"), paths.change_area(p).alias("area"))


@query(sql("SELECT classification, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines FROM cls GROUP BY classification", "roles"))
def files_by_class(spark, sf_dir):
    return inputs.role_paths(spark, sf_dir).groupBy(paths.classify(F.col("path")).alias("classification")).agg(F.count("*").alias("files"), F.sum("lines").alias("lines"))


_AREA_LEVELS = "CASE WHEN lines >= 20 THEN 'high' WHEN lines >= 5 THEN 'medium' ELSE 'low' END"


@query(
    sql(
        f"""WITH l AS (SELECT area, lines, {_AREA_LEVELS} AS risk_level, CASE WHEN classification = 'source' THEN 'high' ELSE 'low' END AS priority_level FROM cls)
SELECT area, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, CASE WHEN bool_or(risk_level = 'high') THEN 'high' WHEN bool_or(risk_level = 'medium') THEN 'medium' ELSE 'low' END AS risk_level,
CASE WHEN bool_or(priority_level = 'high') THEN 'high' ELSE 'low' END AS priority_level FROM l GROUP BY area""",
        "roles",
    )
)
def change_areas(spark, sf_dir):
    p = F.col("path")
    files = inputs.role_paths(spark, sf_dir).select(paths.change_area(p).alias("area"), "lines", F.expr(_AREA_LEVELS).alias("risk_level"), F.when(paths.classify(p) == "source", "high").otherwise("low").alias("priority_level"))
    return ranking.areas(files).orderBy(*ranking.area_order())


@query(
    """SELECT doc_id, CAST(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) - (CASE WHEN right(text, 1) = chr(10) THEN 1 ELSE 0 END) END AS BIGINT) AS physical,
CAST(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\r\\f\\v]'))) AS BIGINT) AS nonblank FROM documents"""
)
def loc_metrics(spark, sf_dir):
    lines = compare.text_lines(F.coalesce("text", F.lit("")))
    return inputs.read(spark, sf_dir, "documents").select("doc_id", F.size(lines).cast("long").alias("physical"), F.size(F.filter(lines, lambda x: x.rlike(r"[^ \t\r\f\x0B]"))).cast("long").alias("nonblank"))


# ---- functions


@query(sql("SELECT file, name, b_pos, t_pos, CAST(confidence AS DOUBLE) AS confidence FROM m", "sides"))
def match_functions(spark, sf_dir):
    return inputs.matched(spark, sf_dir).select("file", "name", F.col("b.pos").cast("long").alias("b_pos"), F.col("t.pos").cast("long").alias("t_pos"), "confidence")


@query(sql("SELECT CAST(confidence AS DOUBLE) AS confidence, CASE WHEN b_pos IS NULL THEN 'added' WHEN t_pos IS NULL THEN 'removed' ELSE 'both' END AS sides, count(*) AS n FROM m GROUP BY ALL", "sides"))
def match_summary(spark, sf_dir):
    sides = F.when(F.col("b").isNull(), "added").when(F.col("t").isNull(), "removed").otherwise("both")
    return inputs.matched(spark, sf_dir).groupBy("confidence", sides.alias("sides")).agg(F.count("*").alias("n"))


@query(sql("SELECT file, name, b_pos, t_pos, status, lines_added, lines_removed, changed_hunks FROM fc", "churn"))
def function_churn(spark, sf_dir):
    rows = inputs.function_changes(spark, sf_dir)
    return rows.select("file", "name", F.col("b_pos").cast("long").alias("b_pos"), F.col("t_pos").cast("long").alias("t_pos"), "status", "lines_added", "lines_removed", "changed_hunks")


@query(sql("SELECT file, b_pos, t_pos, base_start, base_count, target_start, target_count FROM o WHERE near", "churn"))
def detail_hunks(spark, sf_dir):
    m = inputs.matched(spark, sf_dir)
    rows = m.join(inputs.hunks(spark, sf_dir), "file")
    side = lambda s, p: compare.nearby(F.col(f"{s}.first"), F.col(f"{s}.last"), F.col(f"{p}_start"), F.col(f"{p}_count"))
    return rows.filter(side("b", "base") | side("t", "target")).select("file", F.col("b.pos").cast("long").alias("b_pos"), F.col("t.pos").cast("long").alias("t_pos"), "base_start", "base_count", "target_start", "target_count")


@query(
    sql(
        """SELECT file, CAST(round(least(greatest(lines_added, lines_removed), coalesce(tl - tf, bl - bf) + 1) * 100.0 / (coalesce(tl - tf, bl - bf) + 1)) AS BIGINT) AS percent, count(*) AS n FROM fc GROUP BY ALL""", "churn"
    )
)
def hunk_overlap(spark, sf_dir):
    length = F.coalesce(F.col("t_last") - F.col("t_first"), F.col("b_last") - F.col("b_first")) + 1
    share = compare.rounded_share(F.greatest("lines_added", "lines_removed"), length)
    return inputs.function_changes(spark, sf_dir).groupBy("file", F.round(share * 100).cast("long").alias("percent")).agg(F.count("*").alias("n"))


@query(
    sql(
        """WITH eb AS (SELECT DISTINCT file, name FROM bs WHERE ex), et AS (SELECT DISTINCT file, name FROM ts WHERE ex),
a AS (SELECT file, string_agg(name::VARCHAR, ',' ORDER BY name) AS l FROM (SELECT * FROM et EXCEPT SELECT * FROM eb) GROUP BY file), r AS (SELECT file, string_agg(name::VARCHAR, ',' ORDER BY name) AS l FROM (SELECT * FROM eb EXCEPT SELECT * FROM et) GROUP BY file)
SELECT coalesce(a.file, r.file) AS file, coalesce(a.l, '') AS exports_added, coalesce(r.l, '') AS exports_removed FROM a FULL OUTER JOIN r ON a.file = r.file""",
        "sides",
    )
)
def export_delta(spark, sf_dir):
    base, target = inputs.entities(spark, sf_dir)
    pick = lambda d: d.filter("exported").select(F.col("file").alias("path"), "name")
    rows = compare.export_delta(pick(base), pick(target))
    return rows.select(F.col("path").alias("file"), F.array_join(F.col("exports_added").cast("array<string>"), ",").alias("exports_added"), F.array_join(F.col("exports_removed").cast("array<string>"), ",").alias("exports_removed"))


_TOTALS = "CAST(sum(coalesce(bcog, 0)) AS BIGINT) AS cognitive_before, CAST(sum(coalesce(tcog, 0)) AS BIGINT) AS cognitive_after, CAST(sum(coalesce(bcyc, 0)) AS BIGINT) AS cyclomatic_before, CAST(sum(coalesce(tcyc, 0)) AS BIGINT) AS cyclomatic_after, " + ", ".join(
    f"count(*) FILTER (status = '{s}') AS {s}" for s in ("added", "removed", "modified", "unchanged")
)


@query(sql(f"SELECT file, {_TOTALS} FROM fc GROUP BY file", "churn"))
def complexity_totals(spark, sf_dir):
    return ranking.complexity_totals(inputs.function_changes(spark, sf_dir), ["file"])


@query(
    sql(
        """SELECT file, CASE WHEN sum(coalesce(tcog, 0) - coalesce(bcog, 0)) <= 0 AND bool_or(status = 'added' AND tcog >= 5) AND bool_or(status IN ('modified', 'removed') AND coalesce(tcog, 0) - coalesce(bcog, 0) < 0)
THEN 'complexity_extraction' ELSE 'other' END AS shape FROM fc GROUP BY file""",
        "churn",
    )
)
def change_shape(spark, sf_dir):
    return ranking.change_shape(inputs.function_changes(spark, sf_dir), ["file"])


_SCORED = ["file", "name", "b_pos", "t_pos", "status", "classification", "exported", "direct_importers", "cognitive_delta", "cyclomatic_delta", "churn", "risk_score", "risk_level", "priority_score", "priority_level"]


@query(sql("SELECT function_id, status, classification, exported, CAST(direct_importers AS INT) AS direct_importers, cognitive_delta, cyclomatic_delta, churn, risk_score, risk_level, priority_score, priority_level FROM sl", "scores"))
def risk_scores(spark, sf_dir):
    return inputs.scored_functions(spark, sf_dir).select("function_id", *_SCORED[4:])


@query(
    sql(
        """WITH r AS (SELECT function_id, 0 AS o, CASE WHEN status = 'added' AND cog_after >= 10 THEN 'added_function_cognitive_complexity' END AS code, 'new function has cognitive complexity ' || cog_after AS message, cog_after AS v FROM sl
UNION ALL SELECT function_id, 1, CASE WHEN status = 'added' AND cyc_after >= 10 THEN 'added_function_cyclomatic_complexity' END, 'new function has cyclomatic complexity ' || cyc_after, cyc_after FROM sl
UNION ALL SELECT function_id, 2, CASE WHEN status <> 'added' AND cognitive_delta >= 2 THEN 'cognitive_complexity_increased' END, 'cognitive complexity increased by ' || cognitive_delta, cognitive_delta FROM sl
UNION ALL SELECT function_id, 3, CASE WHEN status <> 'added' AND cyclomatic_delta >= 2 THEN 'cyclomatic_complexity_increased' END, 'cyclomatic complexity increased by ' || cyclomatic_delta, cyclomatic_delta FROM sl
UNION ALL SELECT function_id, 4, CASE WHEN status <> 'added' AND cog_after >= 15 THEN 'cognitive_complexity_after' END, 'cognitive complexity is ' || cog_after || ' after the change', cog_after FROM sl
UNION ALL SELECT function_id, 5, CASE WHEN churn >= 30 THEN 'high_churn' END, churn || ' lines changed inside the function', churn FROM sl
UNION ALL SELECT function_id, 6, CASE WHEN exported = 'removed' THEN 'export_removed' END, 'no longer exported; every importer of this name breaks', NULL FROM sl
UNION ALL SELECT function_id, 7, CASE WHEN exported = 'added' THEN 'export_added' END, 'newly part of the module''s public surface', NULL FROM sl
UNION ALL SELECT function_id, 8, CASE WHEN direct_importers >= 5 THEN 'containing_module_direct_importers' END, 'containing module is imported directly by ' || direct_importers || ' modules', direct_importers FROM sl
UNION ALL SELECT function_id, 9, CASE WHEN classification = 'source' THEN 'production_source' END, 'production source file', NULL FROM sl
UNION ALL SELECT function_id, 10, CASE WHEN confidence < 1 THEN 'match_confidence' END, 'matched with ' || CASE WHEN confidence < 0.7 THEN '0.6' ELSE '0.9' END || ' confidence; verify it is the same function', NULL FROM sl),
f AS (SELECT *, row_number() OVER (PARTITION BY function_id ORDER BY o) - 1 AS ord FROM r WHERE code IS NOT NULL)
SELECT function_id, CAST(ord AS INT) AS ord, code, message, CAST(v AS BIGINT) AS value FROM f""",
        "scores",
    )
)
def risk_reasons(spark, sf_dir):
    rows = inputs.scored_functions(spark, sf_dir)
    return rows.select("function_id", F.posexplode("review_priority.reasons").alias("ord", "r")).select("function_id", "ord", "r.code", "r.message", "r.value")


@query(
    sql(
        """WITH f AS (SELECT file, path, risk_score, priority_score, coalesce(t_pos, b_pos) * 2 + (t_pos IS NULL)::INT AS ord, status FROM sl),
r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY risk_score DESC, ord) AS k FROM f WHERE status <> 'unchanged'), p AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY priority_score DESC, ord) AS k FROM f WHERE status <> 'unchanged')
SELECT x.path, coalesce(r.risk_score, 0) AS risk_score, CAST(r.ord AS BIGINT) AS risk_at, coalesce(p.priority_score, 0) AS priority_score, CAST(p.ord AS BIGINT) AS priority_at
FROM (SELECT DISTINCT file, path FROM f) x LEFT JOIN r ON r.file = x.file AND r.k = 1 LEFT JOIN p ON p.file = x.file AND p.k = 1""",
        "scores",
    )
)
def file_assessment(spark, sf_dir):
    at = F.coalesce("t_pos", "b_pos").cast("long") * 2 + F.col("t_pos").isNull().cast("int")
    return ranking.file_assessment(inputs.scored_functions(spark, sf_dir).withColumn("at", at), ["path"], "at")


_FN_ORDER = "priority_score DESC, risk_score DESC, cognitive_delta DESC, churn DESC, path, symbol, function_id"


def _ranked(spark, sf_dir, **filters):
    return ranking.select_functions(inputs.scored_functions(spark, sf_dir), **filters)


@query(sql(f"SELECT function_id, risk_score, priority_score, cognitive_delta, churn FROM sl WHERE status <> 'unchanged' AND risk_level <> 'low' ORDER BY {_FN_ORDER} LIMIT 50", "scores"))
def list_changed_functions(spark, sf_dir):
    rows = ranking.page(_ranked(spark, sf_dir, minimum_risk="medium"), ranking.function_order(["function_id"]))
    return rows.select("function_id", "risk_score", "priority_score", "cognitive_delta", "churn")


@query(sql(f"SELECT function_id, total FROM (SELECT *, count(*) OVER () AS total FROM sl WHERE status = 'modified' AND classification = 'source' AND greatest(cognitive_delta, cyclomatic_delta) >= 3) ORDER BY {_FN_ORDER} LIMIT 20 OFFSET 40", "scores"))
def page_functions(spark, sf_dir):
    rows = _ranked(spark, sf_dir, status="modified", classification="source", min_complexity_delta=3)
    # The count is one row.
    total = rows.agg(F.count("*").alias("total"))
    return ranking.page(rows, ranking.function_order(["function_id"]), 20, 40).select("function_id").join(F.broadcast(total))


@query(sql(f"SELECT function_id, priority_score, risk_score FROM sl WHERE status <> 'unchanged' ORDER BY {_FN_ORDER} LIMIT 5", "scores"))
def review_candidates(spark, sf_dir):
    return ranking.page(_ranked(spark, sf_dir), ranking.function_order(["function_id"]), 5).select("function_id", "priority_score", "risk_score")


_RANK = "CASE {} WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"


@query(
    sql(
        f"""WITH f AS (SELECT path, CAST(sum(churn) AS BIGINT) AS lines, max(CASE WHEN status <> 'unchanged' THEN {_RANK.format("risk_level")} ELSE 0 END) AS r, max(CASE WHEN status <> 'unchanged' THEN {_RANK.format("priority_level")} ELSE 0 END) AS p FROM sl GROUP BY path)
SELECT path, lines, CASE r WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS risk_level, CASE p WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS priority_level FROM f ORDER BY p DESC, r DESC, lines DESC, path LIMIT 50""",
        "scores",
    )
)
def list_changed_files(spark, sf_dir):
    rows = inputs.scored_functions(spark, sf_dir)
    top = lambda c: scoring.level_of_rank(F.max(F.when(F.col("status") != "unchanged", scoring.level_rank(F.col(c))).otherwise(0)))
    files = rows.groupBy("path").agg(F.sum("churn").alias("lines"), top("risk_level").alias("risk_level"), top("priority_level").alias("priority_level"))
    return ranking.page(files, ranking.file_order())


@query(sql("SELECT function_id, status, CAST(confidence AS DOUBLE) AS confidence, cognitive_delta, churn, risk_level FROM sl WHERE function_id = (SELECT min(function_id) FROM sl WHERE status = 'modified')", "scores"))
def get_function_change(spark, sf_dir):
    rows = inputs.scored_functions(spark, sf_dir)
    # One row.
    wanted = rows.filter("status = 'modified'").agg(F.min("function_id").alias("function_id"))
    return rows.join(F.broadcast(wanted), "function_id").select("function_id", "status", "confidence", "cognitive_delta", "churn", "risk_level")


@query(
    sql(
        """SELECT severity, code, count(*) AS n FROM (SELECT DISTINCT 'warning' AS severity, 'ambiguous_function_match' AS code, file::VARCHAR AS f, name::VARCHAR AS s FROM m WHERE confidence < 1
UNION ALL SELECT 'info', 'unsupported_language', path, NULL FROM roles WHERE NOT (path LIKE '%.ts' OR path LIKE '%.tsx')) GROUP BY ALL""",
        "sides",
        "roles",
    )
)
def diagnostics_summary(spark, sf_dir):
    ambiguous = inputs.matched(spark, sf_dir).filter("confidence < 1").select("file", "name").distinct().select(F.lit("warning").alias("severity"), F.lit("ambiguous_function_match").alias("code"))
    unsupported = inputs.role_paths(spark, sf_dir).filter(paths.language(F.col("path")).isNull()).select(F.lit("info").alias("severity"), F.lit("unsupported_language").alias("code"))
    return ambiguous.union(unsupported).groupBy("severity", "code").agg(F.count("*").alias("n"))


# ---- edges and graphs


@query(sql("SELECT side, path, specifier, target FROM res", "imports"))
def resolve_specifiers(spark, sf_dir):
    return inputs.resolved(spark, sf_dir).select("side", "path", "specifier", "target")


@query(sql("SELECT side, count(*) AS n, count(DISTINCT path) AS files FROM res WHERE target IS NULL GROUP BY side", "imports"))
def unresolved_specifiers(spark, sf_dir):
    return inputs.resolved(spark, sf_dir).filter("target is null").groupBy("side").agg(F.count("*").alias("n"), F.count_distinct("path").alias("files"))


@query(
    sql(
        """WITH s AS (SELECT side, path, '@pkg/' || split_part(specifier, '/', 2) AS specifier, line, specifier AS t FROM specs)
SELECT s.side, s.path, s.specifier, CASE WHEN s.specifier = '@pkg/d1' THEN CASE WHEN EXISTS (SELECT 1 FROM files f WHERE f.side = s.side AND f.path = 'src/d8.ts') THEN 'src/d8.ts' ELSE r.target END ELSE r.target END AS target
FROM s JOIN res r ON r.side = s.side AND r.path = s.path AND r.specifier = s.t AND r.line = s.line""",
        "imports",
    )
)
def alias_resolution(spark, sf_dir):
    specs, tree = inputs.imports(spark, sf_dir)
    aliases = spark.createDataFrame([(0, "@pkg/d1", "src/d8"), (1, "@pkg/*", "src/*")], "rank int, pattern string, target string")
    named = specs.select("side", "path", "line", F.concat(F.lit("@pkg/"), F.substring_index("specifier", "/", -1)).alias("specifier"))
    found = edges.resolve(edges.specifier_targets(named, aliases), tree, ["side", "path", "specifier", "line"], (".ts", ".tsx"))
    return found.select("side", "path", "specifier", "target")


@query(sql("SELECT importer, target, status, line FROM edges", "imports"))
def edge_status(spark, sf_dir):
    return inputs.import_edges(spark, sf_dir).select("importer", "target", "status", F.col("line").cast("int").alias("line"))


@query(sql("SELECT target AS path, count(*) AS importers FROM edges WHERE status <> 'removed' GROUP BY target", "imports"))
def direct_importers(spark, sf_dir):
    return edges.in_view(inputs.import_edges(spark, sf_dir), "target").groupBy(F.col("target").alias("path")).agg(F.count("*").alias("importers"))


def _view(view: str, kept: str) -> None:
    @query(sql(f"SELECT importer, target, status FROM edges WHERE status IN {kept}", "imports"), f"view_{view}")
    def run(spark, sf_dir):
        return edges.in_view(inputs.import_edges(spark, sf_dir), view).select("importer", "target", "status")


_view("base", "('removed', 'unchanged')")
_view("target", "('added', 'unchanged')")

_STEPS = {"downstream": "SELECT importer AS a, target AS b FROM edges", "upstream": "SELECT target AS a, importer AS b FROM edges"}
_STEPS["both"] = f"{_STEPS['downstream']} UNION {_STEPS['upstream']}"
_ROOTS = ("src/d4.ts", "src/d17.tsx", "src/d14/index.ts")


def _reached(spark, found, direction, depth):
    links = found.select(F.col("importer").alias("from_id"), F.col("target").alias("to_id"))
    roots = spark.createDataFrame([(r,) for r in _ROOTS], "id string")
    return graph.walk(links, roots, direction, depth)


def _walk(direction: str, depth: int) -> None:
    roots = ", ".join(f"('{r}')" for r in _ROOTS)
    body = f"""WITH st AS ({_STEPS[direction]}), w AS (SELECT r AS id, 0 AS depth FROM (VALUES {roots}) v(r) UNION ALL SELECT st.b, w.depth + 1 FROM w JOIN st ON st.a = w.id WHERE w.depth < {depth})
SELECT id, CAST(min(depth) AS INT) AS depth FROM w GROUP BY id"""

    @query(sql(body, "imports", recursive=True), f"walk_{direction}_depth{depth}")
    def run(spark, sf_dir):
        return _reached(spark, inputs.import_edges(spark, sf_dir), direction, depth)


for _d in ("both", "upstream", "downstream"):
    for _n in (1, 2, 3):
        _walk(_d, _n)


@query(
    sql(
        f"""WITH st AS ({_STEPS["upstream"]}), w AS (SELECT 'src/d17.tsx' AS id, 0 AS depth UNION ALL SELECT st.b, w.depth + 1 FROM w JOIN st ON st.a = w.id WHERE w.depth < 2)
SELECT id, CAST(min(depth) AS INT) AS depth FROM w GROUP BY id HAVING min(depth) > 0""",
        "imports",
        recursive=True,
    )
)
def reach_importers(spark, sf_dir):
    found = inputs.import_edges(spark, sf_dir).select(F.col("importer").alias("from_id"), F.col("target").alias("to_id"))
    return graph.reachable_importers(found, spark.createDataFrame([("src/d17.tsx",)], "id string"))


@query(
    sql(
        """WITH t AS (SELECT path, split_part(split_part(path, '/', -1), '.', 1) AS stem FROM repo), i AS (SELECT DISTINCT target AS path, importer AS test FROM edges WHERE starts_with(importer, 'tests/')),
s AS (SELECT a.path, b.path AS test FROM t a JOIN t b ON a.stem = b.stem AND starts_with(b.path, 'tests/') WHERE a.stem <> '')
SELECT path, test, 'test_imports_module' AS resolution, CAST(0.9 AS DOUBLE) AS confidence FROM i UNION ALL SELECT path, test, 'test_name_matches_module', CAST(0.8 AS DOUBLE) FROM (SELECT * FROM s EXCEPT SELECT * FROM i)""",
        "imports",
    )
)
def related_tests(spark, sf_dir):
    found = inputs.import_edges(spark, sf_dir)
    return edges.related_tests(found, inputs.repository(spark, sf_dir).select("path"))


@query(
    sql(
        """WITH c AS (SELECT DISTINCT path FROM repo WHERE edited AND doc_id % 3 = 0)
SELECT path FROM c UNION SELECT importer FROM edges WHERE target IN (SELECT path FROM c) UNION SELECT target FROM edges WHERE importer IN (SELECT path FROM c)""",
        "imports",
    )
)
def admitted_files(spark, sf_dir):
    changed = inputs.repository(spark, sf_dir).filter("edited and doc_id % 3 = 0").select("path")
    return edges.admitted_files(changed, inputs.import_edges(spark, sf_dir))


@query(
    sql(
        """WITH fn AS (SELECT file, pos, cyc % 8 AS leaf FROM bs), u AS (SELECT file, leaf, min(pos) AS callee FROM fn GROUP BY ALL HAVING count(*) = 1)
SELECT bs.file, bs.pos AS caller, u.callee FROM bs JOIN u ON u.file = bs.file AND u.leaf = bs.body % 8""",
        "sides",
    )
)
def local_calls(spark, sf_dir):
    base, _ = inputs.entities(spark, sf_dir)
    calls = base.select("file", F.col("pos").cast("long").alias("caller"), (F.col("body") % 8).alias("name"))
    functions = base.select("file", F.col("pos").cast("long").alias("id"), (F.col("cyc") % 8).cast("long").alias("leaf"))
    return edges.local_calls(calls, functions).select("file", "caller", "callee")


@query(
    sql(
        """WITH fn AS (SELECT DISTINCT file, cyc % 8 AS leaf, pos FROM bs UNION SELECT DISTINCT file, cyc % 8, pos FROM ts), c AS (SELECT file, pos, body % 8 AS leaf FROM bs),
p AS (SELECT c.file, c.pos, min(fn.pos) AS definition FROM c JOIN fn ON fn.file = c.file AND fn.leaf = c.leaf GROUP BY ALL HAVING count(*) = 1),
u AS (SELECT file, leaf, min(pos) AS callee FROM (SELECT file, pos, cyc % 8 AS leaf FROM bs) GROUP BY ALL HAVING count(*) = 1), e AS (SELECT c.file, c.pos, u.callee FROM c JOIN u ON u.file = c.file AND u.leaf = c.leaf WHERE c.leaf < 4)
SELECT file || '/' || pos AS call_id, callee AS definition, 'exact' AS how FROM e UNION ALL SELECT file || '/' || pos, definition, 'possible' FROM p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.file = p.file AND e.pos = p.pos)""",
        "sides",
    )
)
def possible_calls(spark, sf_dir):
    base, target = inputs.entities(spark, sf_dir)
    call_id = F.concat("file", F.lit("/"), "pos")
    calls = base.select(call_id.alias("call_id"), "file", F.col("pos").cast("long").alias("caller"), (F.col("body") % 8).alias("name"))
    named = lambda d: d.select(F.col("file").alias("scope"), (F.col("cyc") % 8).cast("long").alias("name"), F.col("pos").cast("long").alias("definition"))
    guesses = edges.possible_calls(calls.withColumnRenamed("file", "scope"), named(base).union(named(target)))
    exact = edges.local_calls(calls.filter("name < 4"), named(base).select(F.col("scope").alias("file"), F.col("name").alias("leaf"), F.col("definition").alias("id")))
    return edges.exact_before_possible(exact.select("call_id", F.col("callee").alias("definition")), guesses)


@query(
    """WITH RECURSIVE n AS (SELECT count(*) AS n FROM part), e AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE (p_partkey * 5 + 1) % n END AS f FROM part, n),
w AS (SELECT k AS start, k AS cur, 0 AS hops FROM e UNION ALL SELECT w.start, e.f, w.hops + 1 FROM w JOIN e ON e.k = w.cur WHERE e.f IS NOT NULL AND w.hops < 4)
SELECT w.start, w.cur AS definition, CAST(w.hops AS INT) AS hops FROM w JOIN e ON e.k = w.cur WHERE e.f IS NULL"""
)
def reexport_chase(spark, sf_dir):
    parts = inputs.read(spark, sf_dir, "part").select("p_partkey")
    n = parts.agg(F.count("*").alias("n"))
    links = parts.join(F.broadcast(n)).select(F.col("p_partkey").alias("path"), F.lit("x").alias("name"), F.when(F.col("p_partkey") % 7 != 0, (F.col("p_partkey") * 5 + 1) % F.col("n")).alias("from_path"), F.lit("x").alias("from_name"))
    found = edges.chase_reexports(links.select("path", "name"), links)
    return found.select(F.col("path").alias("start"), F.col("def_path").alias("definition"), "hops")


def _graph(spark, sf_dir):
    found = durable(inputs.import_edges(spark, sf_dir))
    reached = _reached(spark, found, "both", 3)
    repo = inputs.repository(spark, sf_dir)
    status = F.when(~F.col("in_base"), "added").when(~F.col("in_target"), "removed").when(F.col("edited"), "modified").otherwise("unchanged")
    nodes = reached.join(repo.select(F.col("path").alias("id"), status.alias("status")), "id").select(
        "id", F.lit("module").alias("kind"), F.col("id").alias("path"), F.col("id").alias("label"), F.lit(0).alias("start_line"), "status", "depth", F.col("id").isin(*_ROOTS).alias("is_root"), paths.change_area(F.col("id")).alias("area"), F.lit(1).cast("long").alias("size")
    )
    links = found.select(F.col("importer").alias("from_id"), F.lit("imports").alias("relation"), F.col("target").alias("to_id"), "status")
    return durable(nodes), links


_GRAPH = f"""WITH st AS ({_STEPS["both"]}), w AS (SELECT r AS id, 0 AS depth FROM (VALUES {", ".join(f"('{r}')" for r in _ROOTS)}) v(r) UNION ALL SELECT st.b, w.depth + 1 FROM w JOIN st ON st.a = w.id WHERE w.depth < 3),
nd AS (SELECT id, min(w.depth) AS depth, any_value(CASE WHEN NOT in_base THEN 'added' WHEN NOT in_target THEN 'removed' WHEN edited THEN 'modified' ELSE 'unchanged' END) AS status FROM w JOIN repo ON repo.path = w.id GROUP BY id)"""
_IS_ROOT = "id IN (" + ", ".join(f"'{r}'" for r in _ROOTS) + ")"


@query(
    sql(
        f"""{_GRAPH}, t AS (SELECT * FROM nd ORDER BY NOT {_IS_ROOT}, status = 'unchanged', depth, id LIMIT 6)
SELECT id, 'n' || (row_number() OVER (ORDER BY id) - 1) AS key, status, CAST(depth AS INT) AS depth FROM t""",
        "imports",
        recursive=True,
    )
)
def graph_truncate(spark, sf_dir):
    nodes, links = _graph(spark, sf_dir)
    return graph.truncate(nodes, links, 6, 60)[0].select("id", "key", "status", "depth")


@query(
    sql(
        f"""{_GRAPH}, t AS (SELECT * FROM nd ORDER BY NOT {_IS_ROOT}, status = 'unchanged', depth, id LIMIT 6)
SELECT importer AS from_id, target AS to_id, status FROM edges WHERE importer IN (SELECT id FROM t) AND target IN (SELECT id FROM t) ORDER BY importer, target LIMIT 60""",
        "imports",
        recursive=True,
    )
)
def graph_edges(spark, sf_dir):
    nodes, links = _graph(spark, sf_dir)
    return graph.truncate(nodes, links, 6, 60)[1].select("from_id", "to_id", "status")


_MEMBERS = f"g AS (SELECT id, status, depth FROM nd WHERE starts_with(id, 'tests/') AND NOT ({_IS_ROOT})), gn AS (SELECT count(*) AS n FROM g)"


@query(
    sql(
        f"""{_GRAPH}, {_MEMBERS}
SELECT id, CAST(depth AS INT) AS depth, status, CAST(1 AS BIGINT) AS size FROM nd WHERE id NOT IN (SELECT id FROM g, gn WHERE n >= 2)
UNION ALL SELECT 'group:tests', CAST(min(depth) AS INT), CASE WHEN count(DISTINCT status) = 1 THEN min(status) ELSE 'unchanged' END, count(*) FROM g HAVING count(*) >= 2""",
        "imports",
        recursive=True,
    )
)
def group_collapse_tests(spark, sf_dir):
    nodes, links = _graph(spark, sf_dir)
    tests = nodes.filter(paths.classify(F.col("path")) == "test").select("id")
    return graph.collapse(nodes, links, "tests", tests)[0].select("id", "depth", "status", "size")


@query(
    sql(
        f"""{_GRAPH}, {_MEMBERS}, r AS (SELECT CASE WHEN n >= 2 AND importer IN (SELECT id FROM g) THEN 'group:tests' ELSE importer END AS from_id, CASE WHEN n >= 2 AND target IN (SELECT id FROM g) THEN 'group:tests' ELSE target END AS to_id, status, importer, target FROM edges, gn)
SELECT from_id, to_id, arg_min(status, importer || '|' || target) AS status FROM r WHERE NOT (from_id = to_id AND from_id = 'group:tests') GROUP BY from_id, to_id""",
        "imports",
        recursive=True,
    )
)
def group_collapse_edges(spark, sf_dir):
    nodes, links = _graph(spark, sf_dir)
    tests = nodes.filter(paths.classify(F.col("path")) == "test").select("id")
    return graph.collapse(nodes, links, "tests", tests)[1].select("from_id", "to_id", "status")


_STATES = """WITH x AS (SELECT event_type || '_' || (user_id % 6) AS a, user_id, ts, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) || '_' || ((user_id * 5 + 1) % 6) AS b FROM events),
t AS (SELECT a, b, bool_or(ts < TIMESTAMP '2024-01-01 02:00:00') AS early FROM x WHERE b IS NOT NULL GROUP BY a, b), s AS (SELECT a, b, 'target' AS side FROM t UNION ALL SELECT a, b, 'base' FROM t WHERE early)"""


def _transitions(spark, sf_dir):
    """Distinct steps of any user from an event to the next (from_id, to_id), and whether the first two hours have them."""
    from pyspark.sql import Window

    e = inputs.read(spark, sf_dir, "events")
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    u = F.col("user_id")
    rows = e.select(F.concat("event_type", F.lit("_"), u % 6).alias("from_id"), F.concat(after, F.lit("_"), (u * 5 + 1) % 6).alias("to_id"), (F.col("ts") < F.lit("2024-01-01 02:00:00").cast("timestamp_ntz")).alias("early"))
    return rows.filter("to_id is not null").groupBy("from_id", "to_id").agg(F.bool_or("early").alias("early"))


_CYCLES = "SELECT r.side, r.a AS member, min(r.b) AS key FROM r JOIN r q ON q.side = r.side AND q.a = r.b AND q.b = r.a GROUP BY r.side, r.a"
_REACH = "r AS (SELECT a, b, side FROM s UNION SELECT r.a, s.b, r.side FROM r JOIN s ON s.a = r.b AND s.side = r.side)"


@query(f"WITH RECURSIVE {_STATES[5:]}, {_REACH} SELECT key, member FROM ({_CYCLES}) WHERE side = 'target'")
def cycles(spark, sf_dir):
    return graph.cycles(_transitions(spark, sf_dir).select("from_id", "to_id"))


@query(
    f"""WITH RECURSIVE {_STATES[5:]}, {_REACH}, c AS ({_CYCLES}), l AS (SELECT side, key, string_agg(member, ',' ORDER BY member) AS members FROM c GROUP BY side, key)
SELECT key, members FROM l WHERE side = 'target' AND members NOT IN (SELECT members FROM l WHERE side = 'base')"""
)
def cycle_introduced(spark, sf_dir):
    rows = durable(_transitions(spark, sf_dir))
    return graph.introduced_cycles(rows.filter("early").select("from_id", "to_id"), rows.select("from_id", "to_id"))


@query(
    sql(
        """WITH p AS (SELECT importer AS root, importer AS id FROM edges UNION SELECT target, target FROM edges UNION SELECT importer, target FROM edges UNION SELECT target, importer FROM edges),
nd AS (SELECT root, id, CASE WHEN NOT contains(id, '/') THEN '<root>' ELSE split_part(id, '/', 1) END AS area, CASE WHEN root = id THEN 0 ELSE 1 END AS depth FROM p),
se AS (SELECT importer AS root, importer AS a, target AS b, status FROM edges UNION SELECT target, importer, target, status FROM edges),
a AS (SELECT root, count(DISTINCT area) AS areas, count(DISTINCT id) AS nodes FROM nd GROUP BY root),
dg AS (SELECT root, max(n) AS degree FROM (SELECT root, a, count(*) AS n FROM se GROUP BY root, a UNION ALL SELECT root, b, count(*) FROM se GROUP BY root, b) GROUP BY root),
b AS (SELECT root, count(*) FILTER (b = root) AS callers, count(*) FILTER (a = root) AS dependencies, count(*) FILTER (b = root AND status <> 'unchanged') AS ci, count(*) FILTER (a = root AND status <> 'unchanged') AS co FROM se GROUP BY root),
l AS (SELECT nd.root, count(DISTINCT depth) AS levels FROM nd JOIN (SELECT root, a AS id FROM se WHERE status <> 'unchanged' UNION SELECT root, b FROM se WHERE status <> 'unchanged') e ON e.root = nd.root AND e.id = nd.id GROUP BY nd.root)
SELECT a.root, callers, dependencies, areas, coalesce(levels, 0) AS levels, CASE WHEN nodes < 4 AND degree <= 1 THEN 'linear_and_small' ELSE concat_ws(',', CASE WHEN callers >= 3 THEN 'many_callers' END, CASE WHEN dependencies >= 3 THEN 'many_dependencies' END, CASE WHEN least(callers, dependencies) >= 2 THEN 'converges_and_branches' END, CASE WHEN areas >= 2 THEN 'crosses_areas' END,
CASE WHEN ci > 0 AND co > 0 THEN 'changed_on_both_sides' END, CASE WHEN levels >= 2 THEN 'multiple_levels' END) END AS codes FROM a JOIN b ON b.root = a.root JOIN dg ON dg.root = a.root LEFT JOIN l ON l.root = a.root""",
        "imports",
    )
)
def recommend_signals(spark, sf_dir):
    found = durable(inputs.import_edges(spark, sf_dir))
    a, b = F.col("importer"), F.col("target")
    seen = found.select(a.alias("root"), a.alias("from_id"), b.alias("to_id"), "status").union(found.select(b, a, b, "status")).distinct()
    pairs = F.array(F.struct(a.alias("root"), a.alias("id")), F.struct(a.alias("root"), b.alias("id")), F.struct(b.alias("root"), a.alias("id")), F.struct(b.alias("root"), b.alias("id")))
    nodes = found.select(F.explode(pairs).alias("p")).select("p.root", "p.id").distinct().select("root", "id", paths.change_area(F.col("id")).alias("area"), (F.col("root") != F.col("id")).cast("int").alias("depth"))
    return graph.recommendation(graph.measures(nodes, seen)).select("root", "callers", "dependencies", "areas", "levels", "codes")
