"""What a path says about a file, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results are compared by these names.
LOCKFILES = ["Cargo.lock", "Gemfile.lock", "bun.lockb", "composer.lock", "go.sum", "package-lock.json", "pnpm-lock.yaml", "poetry.lock", "yarn.lock"]
VENDORED = ["node_modules", "third_party", "thirdparty", "vendor"]
GENERATED = [".next", "__snapshots__", "coverage", "dist", "generated"]
GENERATED_INFIXES = [".min.", ".generated.", ".g."]
TESTS = ["__mocks__", "__tests__", "e2e", "spec", "test", "tests", "testing"]
TEST_INFIXES = [".spec.", ".test.", "_test.", "-test.", ".test-d."]
CONFIG_FILES = ["Dockerfile", "Justfile", "Makefile", "package.json", "renovate.json"]
CONFIG_EXTENSIONS = ["cfg", "ini", "toml", "yaml", "yml"]
DOCS_EXTENSIONS = ["adoc", "md", "mdx", "rst", "txt"]
PACKAGE_ROOTS = ["apps", "crates", "libs", "modules", "packages", "packages-private", "services"]


def _any_of(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def _has(name: Column, infixes: list[str]) -> Column:
    found = F.lit(False)
    for x in infixes:
        found = found | name.contains(x)
    return found


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def classify(path: Column) -> Column:
    """The role of a file by its path; the first rule that holds decides."""
    parts = F.split(path, "/")
    name, folders = F.element_at(parts, -1), F.slice(parts, F.lit(1), F.size(parts) - 1)
    extension = F.when(name.contains("."), F.substring_index(name, ".", -1))
    config = (
        name.isin(CONFIG_FILES)
        | name.startswith(".")
        | F.exists(folders, lambda d: d.startswith("."))
        | (name.startswith("tsconfig") & (F.coalesce(extension, F.lit("")) == "json"))
        | name.contains(".config.")
        | F.coalesce(extension.isin(CONFIG_EXTENSIONS), F.lit(False))
    )
    return (
        F.when(name.isin(LOCKFILES), "lockfile")
        .when(F.arrays_overlap(folders, _any_of(VENDORED)), "vendored")
        .when(F.arrays_overlap(folders, _any_of(GENERATED)) | (F.coalesce(extension, F.lit("")) == "snap") | _has(name, GENERATED_INFIXES), "generated")
        .when(F.arrays_overlap(folders, _any_of(TESTS)) | _has(name, TEST_INFIXES) | name.startswith("test_"), "test")
        .when(config, "config")
        .when(F.coalesce(extension.isin(DOCS_EXTENSIONS), F.lit(False)), "docs")
        .otherwise("source")
    )


def change_area(path: Column) -> Column:
    """The project that a path belongs to."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) == 1, "<root>").when(parts[0].isin(PACKAGE_ROOTS), F.concat_ws("/", parts[0], parts[1])).otherwise(parts[0])


def language(path: Column) -> Column:
    """Source language by extension, null where there is none that is analysed."""
    extension = F.substring_index(basename(path), ".", -1)
    return F.when(~basename(path).contains("."), None).when(extension.isin("ts", "mts", "cts"), "typescript").when(extension == "tsx", "tsx")


def display_path(base: Column, target: Column) -> Column:
    return F.coalesce(target, base, F.lit("<unknown>"))


def renamed_path(base: Column, target: Column) -> Column:
    """Both paths where they differ, for people to read."""
    return F.when(base != target, F.concat(base, F.lit(" -> "), target)).otherwise(display_path(base, target))


def leaf_name(qualified: Column) -> Column:
    return F.substring_index(qualified, ".", -1)


def stem(path: Column) -> Column:
    """Base name up to its first dot."""
    return F.substring_index(basename(path), ".", 1)


def joined_specifier(folder: Column, specifier: Column) -> Column:
    """``folder/specifier`` with ``.`` and ``..`` resolved; surplus ``..`` are dropped."""
    parts = F.filter(F.split(F.concat_ws("/", folder, specifier), "/"), lambda p: (p != "") & (p != "."))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(walked, "/")


def alias_target(pattern: Column, target: Column, specifier: Column) -> Column:
    """What an alias makes of a specifier, null where it doesn't match; one ``*`` at most counts."""
    star = pattern.contains("*")
    head, tail = F.substring_index(pattern, "*", 1), F.substring_index(pattern, "*", -1)
    fits = specifier.startswith(head) & specifier.endswith(tail) & (F.length(specifier) >= F.length(head) + F.length(tail))
    middle = F.substr(specifier, F.length(head) + 1, F.length(specifier) - F.length(head) - F.length(tail))
    return F.when(star & fits, F.replace(target, F.lit("*"), middle)).when(~star & (specifier == pattern), target)
