"""Source files read in parallel: declarations, imports, and the indexes made of them.

Files are rows (path, content, and any keys); each is parsed once, in Arrow
batches, to one row of nested facts that DataFrame code takes apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.paths import language
from ..functions.text import PARSE_BYTES, import_prefix, path_aliases
from ..operators.durable import durable
from ..operators.edges import resolve, specifier_targets
from . import git
from .typescript import read_imports, read_source

RANGE = "struct<start_line: int, start_column: int, end_line: int, end_column: int>"
CALL = "struct<name: string, receiver: string, line: int>"
FUNCTION = (
    "struct<kind: string, qualified_name: string, start_line: int, start_column: int, end_line: int, end_column: int, "
    f"physical_loc: int, source_loc: int, cyclomatic: int, cognitive: int, body_key: string, calls: array<{CALL}>>"
)
EXPORT = "struct<exported: string, local: string, from_specifier: string, line: int, fn_ix: int>"
DIAGNOSTIC = f"struct<code: string, severity: string, message: string, range: {RANGE}>"
FACTS = f"functions array<{FUNCTION}>, surface array<string>, exports array<{EXPORT}>, modules array<string>, diagnostics array<{DIAGNOSTIC}>"
IMPORTS = (
    "specifiers array<struct<specifier: string, line: int>>, "
    "bindings array<struct<local: string, imported_kind: string, imported: string, specifier: string, line: int>>, truncated boolean"
)


def _mapped(files: DataFrame, facts: str, read: Callable[[str, bytes], dict]) -> DataFrame:
    """``files`` with ``content`` replaced by what ``read(language, content)`` gives."""
    keys = [c for c in files.columns if c != "content"]
    schema = StructType([*(files.schema[c] for c in keys), *StructType.fromDDL(facts).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                rows = b.slice(at, 64).to_pylist()
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in keys} | read(r["language"], r["content"] or b"") for r in rows], schema=arrow)

    return files.select(*keys, "content").mapInArrow(run, schema)


def _not_utf8(error: UnicodeDecodeError) -> str:
    what = "incomplete utf-8 byte sequence" if "unexpected end" in error.reason else f"invalid utf-8 sequence of {error.end - error.start} bytes"
    return f"source is not valid UTF-8: {what} from index {error.start}"


def _facts(name: str | None, content: bytes) -> dict:
    def only(code: str, severity: str, message: str) -> dict:
        return {"functions": [], "surface": [], "exports": [], "modules": [], "diagnostics": [{"code": code, "severity": severity, "message": message, "range": None}]}

    if name is None:
        return only("unsupported_language", "info", "unsupported language")
    if len(content) > PARSE_BYTES:
        return only("oversized_file", "warning", f"source is {len(content)} bytes, above the {PARSE_BYTES} byte analysis limit; function metrics are unavailable")
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError as e:
        return only("invalid_utf8", "error", _not_utf8(e))
    found = read_source(text, name == "tsx")
    bad, found["diagnostics"] = found.pop("malformed"), []
    if bad:
        place = dict(zip(("start_line", "start_column", "end_line", "end_column"), bad))
        found["diagnostics"] = [{"code": "malformed_source", "severity": "warning", "message": "source contains syntax errors; function inventory may be incomplete", "range": place}]
    return found


def _imports(name: str | None, content: bytes) -> dict:
    head, cut = import_prefix(content)
    try:
        found = read_imports(head.decode("utf-8"), name == "tsx")
    except UnicodeDecodeError:
        found = {"specifiers": [], "bindings": []}
    return found | {"truncated": cut}


def parse_files(files: DataFrame) -> DataFrame:
    """Facts of files (path, content, further keys): functions, surface, exports, modules, diagnostics.

    Large texts are read by tasks of their own: rows are dealt by path first.
    """
    named = files.withColumn("language", language(F.col("path")))
    return _mapped(named.repartition(F.col("path")), FACTS, _facts)


def scan_imports(files: DataFrame) -> DataFrame:
    """Specifiers and bindings of source files (path, content), from the part that holds their imports."""
    named = files.withColumn("language", language(F.col("path"))).filter("language is not null")
    return _mapped(named.repartition(F.col("path")), IMPORTS, _imports)


def functions_of(parsed: DataFrame, *keys: str) -> DataFrame:
    """A row for each function: keys, fn_ix and its fields."""
    return parsed.select(*keys, F.posexplode("functions").alias("fn_ix", "f")).select(*keys, "fn_ix", "f.*")


def calls_of(functions: DataFrame, *keys: str) -> DataFrame:
    """A row for each call site: keys, fn_ix, seq, name, receiver, line."""
    return functions.select(*keys, "fn_ix", F.posexplode("calls").alias("seq", "c")).select(*keys, "fn_ix", "seq", "c.*")


def aliases_of(spark: SparkSession, root: str, tree: DataFrame) -> DataFrame | None:
    """Path aliases (rank, pattern, target) of the configuration at the root of a tree; None without one."""
    found = tree.filter("path = 'tsconfig.json'").select("blob_id").first()
    if found is None:
        return None
    (_, state, content), *_ = git.load_blobs(root, [found.blob_id])
    rows = path_aliases(content.decode("utf-8", "replace")) if state == "available" else []
    return spark.createDataFrame(rows, "rank int, pattern string, target string") if rows else None


def import_index(spark: SparkSession, root: str, commit: str) -> dict[str, DataFrame]:
    """What each source file of a commit imports.

    ``specifier`` (path, specifier, line, target: null where nothing answers),
    ``binding``, ``edge`` (importer, target, line: the first), ``file`` (path,
    truncated).
    """
    tree = git.tree(spark, root, commit)
    sources = tree.filter(language(F.col("path")).isNotNull())
    content = sources.join(git.blobs(root, sources.select("blob_id")).filter("state = 'available'"), "blob_id").select("path", "content")
    scanned = durable(scan_imports(content))
    specifiers = scanned.select("path", F.inline("specifiers"))
    resolved = durable(resolve(specifier_targets(specifiers, aliases_of(spark, root, tree)), tree.select("path"), ["path", "specifier", "line"]))
    edges = resolved.filter("target is not null").groupBy(F.col("path").alias("importer"), "target").agg(F.min("line").alias("line"))
    return {"file": scanned.select("path", "truncated"), "specifier": resolved, "binding": scanned.select("path", F.inline("bindings")), "edge": edges}


def symbol_index(spark: SparkSession, root: str, commit: str, admitted: DataFrame) -> DataFrame:
    """Facts of the admitted source files (path) of a commit, and of no others."""
    wanted = git.tree(spark, root, commit).join(admitted.select("path").distinct(), "path", "left_semi").filter(language(F.col("path")).isNotNull())
    content = wanted.join(git.blobs(root, wanted.select("blob_id")).filter("state = 'available'"), "blob_id").select("path", "content")
    return durable(parse_files(content))


def extend_symbols(spark: SparkSession, root: str, commit: str, known: DataFrame, admitted: DataFrame) -> DataFrame:
    """``known`` with the admitted files that it doesn't hold; what it holds is not read again."""
    missing = durable(admitted.select("path").distinct().join(known.select("path"), "path", "left_anti"))
    if missing.isEmpty():
        return known
    return known.unionByName(symbol_index(spark, root, commit, missing))
