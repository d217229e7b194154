"""Path roles, areas, specifiers and scores at their bounds."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import paths, scoring

ROLES = {
    "pnpm-lock.yaml": "lockfile",
    "vendor/project/Cargo.lock": "lockfile",
    "node_modules/x/index.js": "vendored",
    "packages/vue/dist/x.js": "generated",
    "src/__tests__/__snapshots__/a.ts": "generated",
    "a/b.snap": "generated",
    "src/x.min.js": "generated",
    "__tests__/x.spec.ts": "test",
    "types/x.test-d.ts": "test",
    "py/test_a.py": "test",
    ".github/workflows/ci": "config",
    "tsconfig.build.json": "config",
    "vite.config.ts": "config",
    "a/x.toml": "config",
    "CHANGELOG.md": "docs",
    "packages/a/src/x.ts": "source",
    "src/build/emitter.ts": "source",
    "README": "source",
}


def test_roles_and_areas(spark):
    got = spark.createDataFrame([(p,) for p in ROLES], "p string").select("p", paths.classify(F.col("p")).alias("c")).collect()
    assert {r.p: r.c for r in got} == ROLES
    areas = {"packages/core/src/a.ts": "packages/core", "crates/parser/x": "crates/parser", "src/index.ts": "src", "README.md": "<root>"}
    got = spark.createDataFrame([(p,) for p in areas], "p string").select("p", paths.change_area(F.col("p")).alias("a")).collect()
    assert {r.p: r.a for r in got} == areas


def test_specifiers(spark):
    rows = [("src/a", "./b", "src/a/b"), ("src/a", "../b/./c", "src/b/c"), ("", "./x", "x"), ("a", "../../x", "x"), ("a/b", "..", "a")]
    got = spark.createDataFrame(rows, "f string, s string, e string").select("e", paths.joined_specifier(F.col("f"), F.col("s")).alias("g")).collect()
    assert all(r.e == r.g for r in got)
    rows = [("vue", "src/vue", "vuex", None), ("vue", "src/vue", "vue", "src/vue"), ("@p/*", "packages/*/src", "@p/core", "packages/core/src"), ("a*b", "x*", "ab", "x"), ("a*a", "x*", "a", None)]
    got = spark.createDataFrame(rows, "p string, t string, s string, e string").select("e", paths.alias_target(F.col("p"), F.col("t"), F.col("s")).alias("g")).collect()
    assert all(r.e == r.g for r in got)


SIGNALS = "status string, cognitive_delta long, cyclomatic_delta long, cognitive_after int, cyclomatic_after int, churned_lines long, match_confidence double, exported string, direct_importers int, classification string"


@pytest.mark.parametrize(
    "signal, risk, priority",
    [
        (("modified", 12, 6, 40, 20, 40, 1.0, "removed", 25, "source"), 8, 14),
        (("added", 12, 6, 40, 20, 40, 1.0, "removed", 25, "source"), 6, 12),
        (("added", 12, 11, 12, 11, 0, 1.0, "unchanged", None, "test"), 2, 2),
        (("modified", 0, 0, 0, 0, 0, 1.0, "unchanged", 7, "source"), 0, 2),
        (("modified", 1, 1, 14, 99, 29, 0.6, "unchanged", 4, "docs"), 0, 0),
        (("modified", 2, 2, 15, 0, 30, 0.9, "added", 5, "docs"), 4, 6),
        (("removed", -9, -9, 0, 0, 30, 1.0, "removed", 20, "docs"), 1, 6),
    ],
)
def test_scores(spark, signal, risk, priority):
    row = spark.createDataFrame([signal], SIGNALS).select(scoring.risk().alias("r"), scoring.review_priority().alias("p")).first()
    assert (row.r.score, row.p.score) == (risk, priority)
    assert row.r.level == ("high" if risk >= 5 else "medium" if risk >= 2 else "low")
    assert ("match_confidence" in [x.code for x in row.r.reasons]) == (signal[6] < 1)
