"""Two snapshots made of the driver's tables: a repository over documents, functions over order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths, scoring
from ..operators import compare


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document as a file: path, where it is on either side, whether it was edited."""
    d = F.col("doc_id")
    path = (
        F.when(d % 4 == 0, F.concat(F.lit("src/d"), d, F.lit(".ts")))
        .when(d % 4 == 1, F.concat(F.lit("src/d"), d, F.lit(".tsx")))
        .when(d % 4 == 2, F.concat(F.lit("src/d"), d, F.lit("/index.ts")))
        .otherwise(F.concat(F.lit("tests/d"), d, F.lit(".spec.ts")))
    )
    text = F.coalesce("text", F.lit(""))
    changed = F.concat(F.regexp_replace(text, r"^[^\n]*\n?", ""), F.lit("\nedited "), d)
    edited = d % 5 == 0
    return read(spark, sf_dir, "documents").select(
        "doc_id", path.alias("path"), (d % 11 != 0).alias("in_base"), (d % 13 != 0).alias("in_target"), edited.alias("edited"), text.alias("base_text"), F.when(edited, changed).otherwise(text).alias("target_text"), "lang", "source"
    )


def role_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under paths of every role: doc_id, path, lines."""
    d, kind = F.col("doc_id"), F.col("doc_id") % 9
    p = F.lit
    path = (
        F.when(kind == 0, F.concat(p("packages/"), "source", p("/src/d"), d, p(".ts")))
        .when(kind == 1, F.concat(p("packages/"), "source", p("/__tests__/d"), d, p(".spec.ts")))
        .when(kind == 2, F.concat(p("vendor/"), "lang", p("/d"), d, p(".js")))
        .when(kind == 3, F.concat(p("packages/"), "source", p("/dist/d"), d, p(".js")))
        .when(kind == 4, F.concat(p("docs/d"), d, p(".md")))
        .when(kind == 5, F.concat(p("apps/"), "source", p("/tsconfig."), d, p(".json")))
        .when(kind == 6, F.concat(p("apps/"), "source", p("/"), "lang", d, p("/yarn.lock")))
        .when(kind == 7, F.concat(p(".github/d"), d))
        .otherwise(F.concat(p("d"), d, p(".ts")))
    )
    return read(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.size(compare.text_lines(F.coalesce("text", F.lit("")))).cast("long").alias("lines"))


def imports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Specifiers (side, path, specifier, line, targets) and trees (side, path) of both sides."""
    repo = repository(spark, sf_dir).select("doc_id", "path", "in_base", "in_target", "edited")
    n = read(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    sides = F.filter(F.array(F.when(F.col("in_base"), "base"), F.when(F.col("in_target"), "target")), lambda x: x.isNotNull())
    files = repo.select("doc_id", "path", "edited", F.explode(sides).alias("side"))
    # One row.
    rows = files.join(F.broadcast(n))
    shift = ((F.col("side") == "target") & F.col("edited")).cast("int")
    one, two = (F.col("doc_id") * 7 + 3 + shift) % F.col("n"), (F.col("doc_id") * 13 + 5) % F.col("n")
    made = F.array(F.struct(F.concat(F.lit("src/d"), one).alias("t"), F.lit(1).alias("line")), F.struct(F.concat(F.lit("src/d"), two).alias("t"), F.lit(2).alias("line")))
    specs = rows.select("side", "path", F.explode(made).alias("m")).select("side", "path", F.col("m.t").alias("specifier"), F.col("m.line").alias("line"), F.array("m.t").alias("targets"))
    return specs, files.select("side", "path")


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """side, path, specifier, line, target (null where nothing exists)."""
    from ..operators.edges import resolve

    specs, tree = imports(spark, sf_dir)
    return resolve(specs, tree, ["side", "path", "specifier", "line"], (".ts", ".tsx"))


def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """importer, target, status, line over both sides."""
    from ..operators.edges import compare_edges

    rows = resolved(spark, sf_dir).filter("target is not null").select(F.col("path").alias("importer"), "target", "side", "line")
    return compare_edges(rows.filter("side = 'base'"), rows.filter("side = 'target'"), ["importer", "target"])


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their place in the order: file, name, pos, loc and columns of the line."""
    order = Window.partitionBy("file").orderBy("name", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    li = read(spark, sf_dir, "lineitem").withColumnsRenamed({"l_orderkey": "file", "l_linenumber": "name"})
    return li.select("file", "name", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", F.row_number().over(order).alias("pos"), F.col("l_quantity").cast("int").alias("loc"))


def both_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of both sides in one pass over the order lines, dealt by file: file, name, is_base, e (pos, first, last, cyc, cog, body, exported)."""
    li = order_lines(spark, sf_dir)
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    grown = s % 4 == 0

    def side(is_base, keep, shift, cyc, cog, exported):
        first = F.col("pos") * 60 + shift
        e = F.struct(F.col("pos"), first.alias("first"), (first + F.col("loc") - 1).alias("last"), cyc.cast("int").alias("cyc"), cog.cast("int").alias("cog"), (p % 50).alias("body"), exported.alias("exported"))
        return F.when(keep, F.struct(F.lit(is_base).alias("is_base"), e.alias("e")))

    base = side(True, (p + s) % 7 != 0, 0, 1 + p % 17, s % 40, F.col("l_returnflag") == "R")
    target = side(False, (p * 3 + s) % 9 != 0, 2, 1 + p % 17 + F.when(grown, p % 7).otherwise(0), s % 40 + F.when(grown, p % 13).otherwise(0), F.col("l_linestatus") == "O")
    return li.select("file", "name", F.explode(F.array_compact(F.array(base, target))).alias("x")).select("file", "name", "x.is_base", "x.e")


def entities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Functions of each side: file, name, pos, first, last, cyc, cog, body, exported."""
    rows = both_sides(spark, sf_dir)
    return rows.filter("is_base").select("file", "name", "e.*"), rows.filter("not is_base").select("file", "name", "e.*")


def hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hunks for each order: file, base_start, base_count, target_start, target_count."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")

    def hunk(shift: int, more: int):
        start = 1 + c % 700 + shift
        return F.struct(start.alias("base_start"), ((o + more) % 9).alias("base_count"), (start + 2).alias("target_start"), ((c + more) % 9).alias("target_count"))

    return read(spark, sf_dir, "orders").select(o.alias("file"), F.explode(F.array(hunk(0, 0), hunk(300, 4))).alias("h")).select("file", "h.*")


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.match_sides(both_sides(spark, sf_dir), ["file", "name"], ["pos"], "body")


def function_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched functions with churn, status, metrics and what became of their name among the exports."""
    named = Window.partitionBy("file", "name")
    seen = lambda side: F.coalesce(F.bool_or(F.col(f"{side}.exported")).over(named), F.lit(False))
    exported = F.when(seen("b") & ~seen("t"), "removed").when(seen("t") & ~seen("b"), "added").otherwise("unchanged")
    m = matched(spark, sf_dir).select(
        "file", "name", "confidence", exported.alias("exported"), F.col("b.pos").alias("b_pos"), F.col("t.pos").alias("t_pos"),
        F.col("b.first").alias("b_first"), F.col("b.last").alias("b_last"), F.col("t.first").alias("t_first"), F.col("t.last").alias("t_last"),
        F.col("b.cyc").alias("cyclomatic_before"), F.col("t.cyc").alias("cyclomatic_after"), F.col("b.cog").alias("cognitive_before"), F.col("t.cog").alias("cognitive_after"),
    )
    entity = [c for c in m.columns]
    rows = compare.churn(m, hunks(spark, sf_dir), "file", entity)
    changed = (F.col("changed_hunks") > 0) | (F.col("cyclomatic_before") != F.col("cyclomatic_after")) | (F.col("cognitive_before") != F.col("cognitive_after")) | ((F.col("b_last") - F.col("b_first")) != (F.col("t_last") - F.col("t_first")))
    return rows.withColumns({"status": compare.change_status(F.col("b_pos").isNotNull(), F.col("t_pos").isNotNull(), changed), "churn": F.col("lines_added") + F.col("lines_removed"), "changed_hunks": F.col("changed_hunks").cast("long")})


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files: file, path, classification, direct_importers."""
    o, kind = F.col("o_orderkey").cast("string"), F.substring("o_orderpriority", 1, 1)
    path = (
        F.when(kind == "1", F.concat(F.lit("packages/core/src/f"), o, F.lit(".ts")))
        .when(kind == "2", F.concat(F.lit("packages/core/__tests__/f"), o, F.lit(".spec.ts")))
        .when(kind == "3", F.concat(F.lit("vendor/lib/f"), o, F.lit(".js")))
        .when(kind == "4", F.concat(F.lit("docs/f"), o, F.lit(".md")))
        .otherwise(F.concat(F.lit("src/f"), o, F.lit(".ts")))
    )
    orders = read(spark, sf_dir, "orders")
    importers = orders.groupBy("o_custkey").agg(F.count("*").cast("int").alias("direct_importers"))
    return orders.join(importers, "o_custkey").select(F.col("o_orderkey").alias("file"), path.alias("path"), paths.classify(path).alias("classification"), "direct_importers")


def scored_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function changes with both assessments."""
    rows = function_changes(spark, sf_dir).join(order_files(spark, sf_dir), "file")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = rows.withColumns(
        {
            "cognitive_delta": (zero("cognitive_after") - zero("cognitive_before")).cast("long"),
            "cyclomatic_delta": (zero("cyclomatic_after") - zero("cyclomatic_before")).cast("long"),
            "_cog": F.col("cognitive_after"),
            "_cyc": F.col("cyclomatic_after"),
        }
    )
    rows = rows.withColumns({"cognitive_after": zero("_cog"), "cyclomatic_after": zero("_cyc"), "churned_lines": F.col("churn"), "match_confidence": F.col("confidence")})
    rows = rows.withColumns({"risk": scoring.risk(), "review_priority": scoring.review_priority()})
    side = F.when(F.col("t_pos").isNull(), F.concat(F.lit("base:"), F.col("b_first"))).otherwise(F.concat(F.lit("target:"), F.col("t_first")))
    return rows.withColumns(
        {
            "symbol": F.concat(F.lit("fn:"), F.col("name").cast("string")),
            "function_id": F.concat("path", F.lit("#fn:"), F.col("name").cast("string"), F.lit("@"), side, F.lit(":0")),
            "risk_score": F.col("risk.score"),
            "priority_score": F.col("review_priority.score"),
            "risk_level": F.col("risk.level"),
            "priority_level": F.col("review_priority.level"),
        }
    )
