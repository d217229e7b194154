"""Aggregates, ranked lists and pages of changed files and functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import level_of_rank, level_rank


def complexity_totals(functions: DataFrame, by: list[str]) -> DataFrame:
    """Sums of complexity before and after, and counts by status, over all functions."""
    sums = [F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in ("cognitive_before", "cognitive_after", "cyclomatic_before", "cyclomatic_after")]
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "modified", "unchanged")]
    return functions.groupBy(*by).agg(*sums, *counts)


def change_shape(functions: DataFrame, by: list[str]) -> DataFrame:
    """complexity_extraction where a function shrank, a substantial one came and the file didn't grow; else other."""
    delta = F.coalesce("cognitive_after", F.lit(0)) - F.coalesce("cognitive_before", F.lit(0))
    facts = functions.groupBy(*by).agg(
        F.sum(delta).alias("d"),
        F.bool_or((F.col("status") == "added") & (F.col("cognitive_after") >= 5)).alias("helper"),
        F.bool_or(F.col("status").isin("modified", "removed") & (delta < 0)).alias("shrunk"),
    )
    return facts.select(*by, F.when((F.col("d") <= 0) & F.col("helper") & F.col("shrunk"), "complexity_extraction").otherwise("other").alias("shape"))


def file_assessment(functions: DataFrame, by: list[str], order: str) -> DataFrame:
    """Highest score of each model over functions that changed; of equal ones the first in ``order`` gives the function.

    Files without one have score 0 and level low.
    """
    changed = F.col("status") != "unchanged"
    best = lambda c: F.max(F.when(changed, F.struct(F.col(c).alias("score"), (-F.col(order)).alias("at"))))
    rows = functions.groupBy(*by).agg(best("risk_score").alias("r"), best("priority_score").alias("p"))
    zero = lambda c: F.coalesce(F.col(f"{c}.score"), F.lit(0))
    return rows.select(*by, zero("r").alias("risk_score"), (-F.col("r.at")).alias("risk_at"), zero("p").alias("priority_score"), (-F.col("p.at")).alias("priority_at"))


def areas(files: DataFrame) -> DataFrame:
    """Per area: files, lines and the highest levels, over files (area, lines, risk_level, priority_level)."""
    top = lambda c: level_of_rank(F.max(level_rank(F.col(c))))
    return files.groupBy("area").agg(F.count("*").alias("files"), F.sum("lines").cast("long").alias("lines"), top("risk_level").alias("risk_level"), top("priority_level").alias("priority_level"))


def area_order() -> list[Column]:
    return [level_rank(F.col("priority_level")).desc(), level_rank(F.col("risk_level")).desc(), F.col("files").desc(), F.col("area")]


def file_order() -> list[Column]:
    return [level_rank(F.col("priority_level")).desc(), level_rank(F.col("risk_level")).desc(), F.col("lines").desc(), F.col("path")]


def inventory_order() -> list[Column]:
    """Files by the path they have now, else had; one without an earlier path goes first."""
    return [F.coalesce("target_path", "base_path"), F.col("base_path").asc_nulls_first()]


def placed(rows: DataFrame, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """Adds ``place`` from 1 within ``by``; without it ``rows`` is a page, ranked in one place."""
    spec = Window.partitionBy(*by) if by else Window.partitionBy()
    return rows.withColumn("place", F.row_number().over(spec.orderBy(*order)))


def function_order(tie: list[str]) -> list[Column]:
    """Priority, risk, complexity gained, churn, then path and symbol; ``tie`` makes the order total."""
    return [F.col("priority_score").desc(), F.col("risk_score").desc(), F.col("cognitive_delta").desc(), F.col("churn").desc(), F.col("path"), F.col("symbol"), *[F.col(c) for c in tie]]


def select_functions(functions: DataFrame, file: str | None = None, status: str | None = None, classification: str | None = None, minimum_risk: str | None = None, min_complexity_delta: int | None = None, include_unchanged: bool = False) -> DataFrame:
    """The filters of a function list. Unchanged ones go first unless they are asked for."""
    rows = functions
    if file is not None:
        rows = rows.filter(F.col("path") == file)
    if classification is not None:
        rows = rows.filter(F.col("classification") == classification)
    if not include_unchanged:
        rows = rows.filter("status <> 'unchanged'")
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    if minimum_risk is not None:
        rows = rows.filter(level_rank(F.col("risk_level")) >= level_rank(F.lit(minimum_risk)))
    if min_complexity_delta is not None:
        rows = rows.filter(F.greatest("cognitive_delta", "cyclomatic_delta") >= min_complexity_delta)
    return rows


def page(rows: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of a list; with a total order, Spark keeps only ``offset + limit`` rows a task."""
    if not 1 <= limit <= 200:
        raise ValueError("limit is 1 to 200")
    return rows.orderBy(*order).offset(offset).limit(limit)
