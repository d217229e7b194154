"""Additive, explained scores of a changed function, as Column expressions.

A rule has steps, tried from the highest; the first that is reached gives its
points. Rules are data, so scores and reasons come from one table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

RISK_MODEL, PRIORITY_MODEL = "tidemark-risk-v1", "tidemark-review-priority-v1"
# Maxima, level bounds, thresholds and codes that results are compared by.
RISK_MAXIMUM, PRIORITY_MAXIMUM = 8, 14
HIGH, MEDIUM = 5, 2
LEVELS = ("low", "medium", "high")


@dataclass(frozen=True)
class Rule:
    code: str
    when: str  # SQL condition on the signals
    value: str  # SQL of the measured value, or "" for a state
    steps: tuple[tuple[int, int], ...]  # (threshold, points), highest first
    message: str  # {} is the value


INTRINSIC = (
    Rule("added_function_cognitive_complexity", "status = 'added'", "cognitive_after", ((30, 3), (15, 2), (10, 1)), "new function has cognitive complexity {}"),
    Rule("added_function_cyclomatic_complexity", "status = 'added'", "cyclomatic_after", ((20, 2), (10, 1)), "new function has cyclomatic complexity {}"),
    Rule("cognitive_complexity_increased", "status <> 'added'", "cognitive_delta", ((10, 3), (5, 2), (2, 1)), "cognitive complexity increased by {}"),
    Rule("cyclomatic_complexity_increased", "status <> 'added'", "cyclomatic_delta", ((5, 2), (2, 1)), "cyclomatic complexity increased by {}"),
    Rule("cognitive_complexity_after", "status <> 'added'", "cognitive_after", ((30, 2), (15, 1)), "cognitive complexity is {} after the change"),
    Rule("high_churn", "true", "churned_lines", ((30, 1),), "{} lines changed inside the function"),
)
EXPOSURE = (
    Rule("export_removed", "exported = 'removed'", "", ((0, 3),), "no longer exported; every importer of this name breaks"),
    Rule("export_added", "exported = 'added'", "", ((0, 1),), "newly part of the module's public surface"),
    Rule("containing_module_direct_importers", "direct_importers is not null", "direct_importers", ((20, 2), (5, 1)), "containing module is imported directly by {} modules"),
    Rule("production_source", "classification = 'source'", "", ((0, 1),), "production source file"),
)


def _points(rule: Rule) -> Column:
    out = F.lit(0)
    for threshold, points in reversed(rule.steps):
        reached = F.expr(rule.when) if not rule.value else F.expr(f"({rule.when}) and {rule.value} >= {threshold}")
        out = F.when(reached, F.lit(points)).otherwise(out)
    return out


def _reason(rule: Rule) -> Column:
    value = F.expr(rule.value).cast("long") if rule.value else F.lit(None).cast("long")
    head, _, tail = rule.message.partition("{}")
    message = F.concat(F.lit(head), value.cast("string"), F.lit(tail)) if rule.value else F.lit(rule.message)
    return F.when(_points(rule) > 0, F.struct(F.lit(rule.code).alias("code"), message.alias("message"), value.alias("value")))


def _caveat() -> Column:
    message = F.concat(F.lit("matched with "), F.format_number(F.col("match_confidence"), 1), F.lit(" confidence; verify it is the same function"))
    return F.when(F.col("match_confidence") < 1.0, F.struct(F.lit("match_confidence").alias("code"), message.alias("message"), F.lit(None).cast("long").alias("value")))


def score(rules: tuple[Rule, ...]) -> Column:
    total = F.lit(0)
    for r in rules:
        total = total + _points(r)
    return total.cast("int")


def reasons(rules: tuple[Rule, ...]) -> Column:
    """Reasons in rule order, then the caveat of an uncertain match."""
    return F.filter(F.array(*[_reason(r) for r in rules], _caveat()), lambda x: x.isNotNull())


def level(points: Column) -> Column:
    return F.when(points >= HIGH, "high").when(points >= MEDIUM, "medium").otherwise("low")


def level_rank(name: Column) -> Column:
    return F.when(name == "high", 2).when(name == "medium", 1).otherwise(0)


def level_of_rank(rank: Column) -> Column:
    return F.when(rank == 2, "high").when(rank == 1, "medium").otherwise("low")


def assessment(model: str, maximum: int, rules: tuple[Rule, ...]) -> Column:
    points = score(rules)
    return F.struct(F.lit(model).alias("model"), F.lit(maximum).alias("maximum_score"), points.alias("score"), level(points).alias("level"), reasons(rules).alias("reasons"))


def risk() -> Column:
    """Over columns status, cognitive_delta, cyclomatic_delta, cognitive_after, cyclomatic_after, churned_lines, match_confidence."""
    return assessment(RISK_MODEL, RISK_MAXIMUM, INTRINSIC)


def review_priority() -> Column:
    """As ``risk``, and over exported, direct_importers and classification."""
    return assessment(PRIORITY_MODEL, PRIORITY_MAXIMUM, INTRINSIC + EXPOSURE)
