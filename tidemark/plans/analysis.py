"""Two revisions of a repository compared: changed files, their functions, and what was noticed.

``analyze`` joins what the Git source and the parser give: functions of both
sides are matched within their file, changed lines are laid over them, and
diagnostics are gathered. All of it is tables; scores follow in ``scored``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths, scoring
from ..operators import compare
from ..operators.durable import durable
from ..sources import git, symbols

# Severities and codes in report order, and tags of symbols.
SEVERITIES = ("error", "warning", "info")
CODES = ("unsupported_language", "binary_file", "malformed_source", "parse_error", "invalid_utf8", "oversized_file", "missing_blob", "git_error", "ambiguous_function_match", "metric_unavailable")
TAGS = {"function": "fn", "method": "method", "constructor": "ctor", "arrow_function": "arrow"}
METRICS = ("physical_loc", "source_loc", "cyclomatic", "cognitive")


@dataclass
class Analysis:
    """Tables of one comparison; ``base`` and ``target`` are (commit, name as asked for).

    files: file_ix, base_path, target_path, path, status, language, is_binary, added_lines, removed_lines, exports_added, exports_removed, classification, area.
    hunks: file_ix, hunk_ix and spans. functions: file_ix, fn_ix, id, path, status, kind, qualified_name, symbol, function_id, confidence, b and t (place, metrics, fn_ix of the side), churn.
    calls: file_ix, side, fn_ix (of the side), seq, name, receiver, line. diagnostics: file_ix, path, code, severity, message, range, related.
    """

    root: str
    base: tuple[str, str]
    target: tuple[str, str]
    files: DataFrame
    hunks: DataFrame
    functions: DataFrame
    calls: DataFrame
    diagnostics: DataFrame


def symbol_id(kind: Column, name: Column) -> Column:
    """A function within its file, wherever its lines are."""
    tag = F.element_at(F.create_map(*[F.lit(x) for pair in TAGS.items() for x in pair]), kind)
    return F.concat(tag, F.lit(":"), name)


def function_id(path: Column, symbol: Column, status: Column, base: Column, target: Column) -> Column:
    """Path, symbol, side and place; ``base`` and ``target`` have start_line and start_column or are null.

    The target names a function that is there; one that was removed, or has no
    place there, is named where it was.
    """
    at_base = base.isNotNull() & ((status == "removed") | target.isNull())
    side = F.when(at_base, "base").when(target.isNotNull(), "target").otherwise("none")
    line = F.when(at_base, base["start_line"]).otherwise(target["start_line"])
    column = F.when(at_base, base["start_column"]).otherwise(target["start_column"])
    return F.concat(path, F.lit("#"), symbol, F.lit("@"), side, F.lit(":"), F.coalesce(line, F.lit(0)), F.lit(":"), F.coalesce(column, F.lit(0)))


def rank_in(value: Column, names: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in names]), value)


def diagnostic_order() -> list[Column]:
    """Severity, code, path, place (none last), message."""
    places = [F.col(f"range.{c}") for c in ("start_line", "start_column", "end_line", "end_column")]
    return [rank_in(F.col("severity"), SEVERITIES), rank_in(F.col("code"), CODES), F.col("path"), F.col("range").isNull(), *places, F.col("message")]


def distinct_diagnostics(rows: DataFrame) -> DataFrame:
    """One of each (file_ix, path, code, severity, message, range); of several related names the first stays."""
    return rows.groupBy("file_ix", "path", "code", "severity", "message", "range").agg(F.min("related").alias("related"))


def severity_counts(severity: Column) -> list[Column]:
    return [F.count_if(severity == "info").alias("info"), F.count_if(severity == "warning").alias("warnings"), F.count_if(severity == "error").alias("errors"), F.count(severity).alias("total")]


def support_counts(files: DataFrame) -> DataFrame:
    """supported and unsupported files: a language that is analysed, and not binary."""
    good = F.col("language").isNotNull() & ~F.col("is_binary")
    return files.agg(F.count_if(good).alias("supported"), F.count_if(~good).alias("unsupported"))


def numbered(rows: DataFrame, order: list) -> DataFrame:
    """Adds fn_ix within its file and ``id``, one number over all files in their order.

    Only counts, a row for each file, are summed up in one place.
    """
    inside = rows.withColumn("fn_ix", F.row_number().over(Window.partitionBy("file_ix").orderBy(*order)) - 1)
    counts = rows.groupBy("file_ix").agg(F.count("*").alias("k"))
    ahead = counts.select("file_ix", F.coalesce(F.sum("k").over(Window.orderBy("file_ix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    return inside.join(ahead, "file_ix").withColumn("id", F.concat(F.lit("function-"), F.col("ahead") + F.col("fn_ix") + 1)).drop("ahead")


def _sides(files: DataFrame) -> DataFrame:
    """file_ix, side, path and blob_id of what is to be parsed: sides that exist, of files that aren't binary."""
    side = lambda name, path, blob: F.struct(F.lit(name).alias("side"), F.col(path).alias("path"), F.col(blob).alias("blob_id"))
    rows = files.filter("status <> 'binary'").select("file_ix", F.explode(F.array(side("base", "base_path", "old_blob_id"), side("target", "target_path", "new_blob_id"))).alias("s"))
    return rows.select("file_ix", "s.*").filter("path is not null and blob_id is not null")


def match_functions(functions: DataFrame) -> DataFrame:
    """Functions (file_ix, side and fields) paired within their file: file_ix, language, kind, qualified_name, b, t, confidence."""
    key = ["file_ix", "language", "kind", "qualified_name"]
    keep = [*key, "fn_ix", "start_line", "start_column", "end_line", "end_column", *METRICS, "body_key"]
    side = lambda s: functions.filter(F.col("side") == s).select(*keep)
    return compare.match_entities(side("base"), side("target"), key, ["start_line", "start_column"], "body_key")


def function_changes(pairs: DataFrame, hunks: DataFrame) -> DataFrame:
    """Pairs with churn and status: a pair changed if a hunk touches either side or a metric differs."""
    rows = pairs.select("*", F.col("b.start_line").alias("b_first"), F.col("b.end_line").alias("b_last"), F.col("t.start_line").alias("t_first"), F.col("t.end_line").alias("t_last"))
    entity = rows.columns
    spans = hunks.select("file_ix", "base_start", "base_count", "target_start", "target_count")
    laid = compare.churn(rows, spans, "file_ix", entity)
    differs = F.lit(False)
    for m in METRICS:
        differs = differs | (F.col(f"b.{m}") != F.col(f"t.{m}"))
    changed = (F.col("changed_hunks") > 0) | F.coalesce(differs, F.lit(False))
    status = compare.change_status(F.col("b").isNotNull(), F.col("t").isNotNull(), changed)
    return laid.withColumn("status", status).drop("b_first", "b_last", "t_first", "t_last")


def analyze(spark: SparkSession, path: str, base: str, target: str) -> Analysis:
    """Compare two revisions of the repository around ``path``."""
    repo = git.Repository.open(path)
    commits = repo.resolve(base), repo.resolve(target)
    found = git.inventory(spark, repo.root, *commits)
    changes, hunks = durable(found["file_change"]), durable(found["hunk"])
    shown = paths.display_path(F.col("base_path"), F.col("target_path"))
    sides = _sides(changes)
    loaded = sides.join(found["blob"], "blob_id", "left").select("file_ix", "side", "path", F.coalesce("state", F.lit("missing")).alias("state"), "content")
    parsed = durable(symbols.parse_files(loaded.filter("state = 'available'").select("file_ix", "side", "path", "content")))
    functions = symbols.functions_of(parsed, "file_ix", "side", "path", "language")
    matched = durable(function_changes(match_functions(functions), hunks))

    delta = compare.export_delta(*[parsed.filter(F.col("side") == s).select(F.col("file_ix").alias("path"), F.explode("surface").alias("name")) for s in ("base", "target")]).withColumnRenamed("path", "file_ix")
    files = changes.join(delta, "file_ix", "left").select(
        "file_ix", "base_path", "target_path", shown.alias("path"), "status", paths.language(shown).alias("language"), (F.col("status") == "binary").alias("is_binary"), "added_lines", "removed_lines",
        F.coalesce("exports_added", F.array().cast("array<string>")).alias("exports_added"), F.coalesce("exports_removed", F.array().cast("array<string>")).alias("exports_removed"),
        paths.classify(shown).alias("classification"), paths.change_area(shown).alias("area"),
    )
    files = durable(files)

    start = [F.coalesce(F.col(f"t.{c}"), F.col(f"b.{c}")) for c in ("start_line", "start_column")]
    order = [*start, "qualified_name", "kind", F.col("confidence").desc(), F.col("b.start_line"), F.col("b.start_column")]
    rows = numbered(matched, order).join(files.select("file_ix", "path"), "file_ix")
    symbol = symbol_id(F.col("kind"), F.col("qualified_name"))
    rows = rows.withColumn("symbol", symbol).withColumn("function_id", function_id(F.col("path"), F.col("symbol"), F.col("status"), F.col("b"), F.col("t")))

    none = F.lit(None).cast(symbols.RANGE).alias("range")
    unnamed = F.lit(None).cast("string").alias("related")
    said = parsed.select("file_ix", F.inline("diagnostics")).select("file_ix", "code", "severity", "message", "range", unnamed)
    lost = loaded.filter("state = 'missing'").select("file_ix", F.lit("missing_blob").alias("code"), F.lit("error").alias("severity"), F.concat("side", F.lit(" blob is unavailable for function mapping")).alias("message"), none, unnamed)
    unclear = matched.filter("confidence < 1").select("file_ix", F.lit("ambiguous_function_match").alias("code"), F.lit("warning").alias("severity"), F.lit("multiple functions share the same semantic identity").alias("message"), none, F.col("qualified_name").alias("related"))
    binary = changes.filter("status = 'binary'").select("file_ix", F.lit("binary_file").alias("code"), F.lit("info").alias("severity"), F.lit("binary file is inventoried without source metrics").alias("message"), none, unnamed)
    noticed = said.union(lost).union(unclear).union(binary).join(files.select("file_ix", "path"), "file_ix")
    return Analysis(
        repo.root, (commits[0], base), (commits[1], target), files, hunks, durable(rows), durable(symbols.calls_of(functions, "file_ix", "side")), durable(distinct_diagnostics(noticed))
    )


def scored(analysis: Analysis, importers: DataFrame | None) -> DataFrame:
    """Functions with both assessments; ``importers`` (path, direct_importers) is None where no index was built."""
    files = analysis.files.select("file_ix", "classification", "exports_added", "exports_removed")
    rows = analysis.functions.join(files, "file_ix")
    if importers is None:
        rows = rows.withColumn("direct_importers", F.lit(None).cast("int"))
    else:
        rows = rows.join(importers, "path", "left").withColumn("direct_importers", F.coalesce("direct_importers", F.lit(0)).cast("int"))
    leaf = paths.leaf_name(F.col("qualified_name"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = rows.withColumns(
        {
            "exported": F.when(F.array_contains("exports_removed", leaf), "removed").when(F.array_contains("exports_added", leaf), "added").otherwise("unchanged"),
            "cognitive_before": F.col("b.cognitive"),
            "cyclomatic_before": F.col("b.cyclomatic"),
            "cognitive_after": zero("t.cognitive"),
            "cyclomatic_after": zero("t.cyclomatic"),
            "cognitive_delta": (zero("t.cognitive") - zero("b.cognitive")).cast("long"),
            "cyclomatic_delta": (zero("t.cyclomatic") - zero("b.cyclomatic")).cast("long"),
            "churned_lines": F.col("lines_added") + F.col("lines_removed"),
            "churn": F.col("lines_added") + F.col("lines_removed"),
            "match_confidence": F.col("confidence"),
            "hunk_overlap": compare.rounded_share(F.greatest("lines_added", "lines_removed"), F.coalesce("t.physical_loc", "b.physical_loc")),
        }
    )
    rows = rows.withColumns({"risk": scoring.risk(), "review_priority": scoring.review_priority()})
    return rows.withColumns({f"{short}_{what}": F.col(f"{name}.{what}") for short, name in (("risk", "risk"), ("priority", "review_priority")) for what in ("score", "level")})
