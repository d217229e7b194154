"""Two snapshots compared: files, lines, entities, and the changed lines inside entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def membership(in_base: Column, in_target: Column) -> Column:
    """added, removed or unchanged, by presence on the two sides."""
    return F.when(in_base & in_target, "unchanged").when(in_target, "added").otherwise("removed")


def file_status(base: DataFrame, target: DataFrame) -> DataFrame:
    """Changed files of two trees (path, blob): one full outer join on path."""
    b, t = base.select("path", F.col("blob").alias("old_blob")), target.select("path", F.col("blob").alias("new_blob"))
    both = b.join(t, "path", "full_outer")
    status = F.when(F.col("old_blob").isNull(), "added").when(F.col("new_blob").isNull(), "deleted").when(F.col("old_blob") != F.col("new_blob"), "modified")
    return both.withColumn("status", status).filter("status is not null")


def exact_renames(changes: DataFrame) -> DataFrame:
    """Deleted and added files of equal content become renames, k-th with k-th by path; the rest stay.

    base_path, target_path, status, old_blob, new_blob.
    """
    rank = lambda blob: F.row_number().over(Window.partitionBy(blob).orderBy("path"))
    gone = changes.filter("status = 'deleted'").select("old_blob", F.col("path").alias("base_path"), rank("old_blob").alias("k"), F.col("old_blob").alias("blob"))
    come = changes.filter("status = 'added'").select("new_blob", F.col("path").alias("target_path"), rank("new_blob").alias("k"), F.col("new_blob").alias("blob"))
    moved = gone.join(come, ["blob", "k"], "full_outer")
    status = F.when(F.col("base_path").isNull(), "added").when(F.col("target_path").isNull(), "deleted").otherwise("renamed")
    rows = moved.select("base_path", "target_path", status.alias("status"), "old_blob", "new_blob")
    same = changes.filter("status = 'modified'").select(F.col("path").alias("base_path"), F.col("path").alias("target_path"), "status", "old_blob", "new_blob")
    return rows.union(same)


def text_lines(text: Column) -> Column:
    """Lines of a text: the piece after a last line end is none, and a carriage return before one is dropped."""
    parts = F.split(text, "\n", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.transform(parts, lambda x: F.when(x.endswith("\r"), F.substr(x, F.lit(1), F.length(x) - 1)).otherwise(x))


def line_delta(pairs: DataFrame) -> DataFrame:
    """``pairs`` (id, before, after) to id, added and removed: differences of the line multisets.

    Each side's lines are counted together in one shuffle by (id, line). A line
    that only moved counts on neither side, where a diff counts it on both; the
    Git source has a diff's own counts.
    """
    sides = F.array(F.struct(F.lit(1).alias("side"), text_lines(F.coalesce("after", F.lit(""))).alias("lines")), F.struct(F.lit(-1).alias("side"), text_lines(F.coalesce("before", F.lit(""))).alias("lines")))
    rows = pairs.select("id", F.explode(sides).alias("x")).select("id", "x.side", F.explode("x.lines").alias("line"))
    net = rows.groupBy("id", "line").agg(F.sum("side").alias("net"))
    totals = net.groupBy("id").agg(F.sum(F.greatest("net", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("net"), F.lit(0))).alias("removed"))
    return pairs.select("id").join(totals, "id", "left").select("id", F.coalesce("added", F.lit(0)).cast("long").alias("added"), F.coalesce("removed", F.lit(0)).cast("long").alias("removed"))


def inventory_summary(files: DataFrame) -> DataFrame:
    """files, added and removed lines, and binary_files of files (added, removed, is_binary)."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return files.agg(F.count("*").alias("files"), total("added"), total("removed"), F.count_if("is_binary").alias("binary_files"))


def match_entities(base: DataFrame, target: DataFrame, key: list[str], order: list[str], body: str) -> DataFrame:
    """Pair entities of equal key across two sides: key, b, t (structs or null), confidence."""
    columns = [c for c in base.columns if c not in key]
    rows = base.select(*key, F.lit(True).alias("is_base"), F.struct(*columns).alias("e")).unionByName(target.select(*key, F.lit(False).alias("is_base"), F.struct(*columns).alias("e")))
    return match_sides(rows, key, order, body)


def match_sides(rows: DataFrame, key: list[str], order: list[str], body: str) -> DataFrame:
    """As ``match_entities``, of both sides in one table: key, is_base and e, a struct.

    A key that stands once on each side at most is exact (1.0). Otherwise equal
    bodies pair first, k-th with k-th (0.9), and what is left pairs by position
    (0.6), surplus included. Ranks, counts and pairs all follow from windows
    over the key, so rows that are dealt by a part of it are not dealt again.
    """
    place = [F.col(f"e.{c}") for c in order]
    by_key = Window.partitionBy(*key)
    by_body = Window.partitionBy(*key, F.col(f"e.{body}"))
    count = lambda side, w: F.count(F.when(F.col("is_base") == side, 1)).over(w)
    rows = rows.select(
        "*",
        F.greatest(count(True, by_key), count(False, by_key)).alias("most"),
        F.least(count(True, by_body), count(False, by_body)).alias("equal"),
        F.row_number().over(Window.partitionBy(*key, "is_base", F.col(f"e.{body}")).orderBy(*place)).alias("k"),
    )
    rows = rows.withColumn("stage", F.when(F.col("most") <= 1, 0).when(F.col("k") <= F.col("equal"), 1).otherwise(2))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy(*key, "is_base", "stage").orderBy(*place)))
    pair = F.when(F.col("stage") == 1, F.struct(F.col(f"e.{body}").cast("string").alias("body"), F.col("k").alias("n"))).otherwise(F.struct(F.lit(None).cast("string").alias("body"), F.col("r").alias("n")))
    paired = rows.withColumn("pair", pair).groupBy(*key, "stage", "pair").agg(F.max(F.when(F.col("is_base"), F.col("e"))).alias("b"), F.max(F.when(~F.col("is_base"), F.col("e"))).alias("t"))
    return paired.select(*key, "b", "t", F.when(F.col("stage") == 0, 1.0).when(F.col("stage") == 1, 0.9).otherwise(0.6).alias("confidence"))


def overlap(first: Column, last: Column, start: Column, count: Column) -> Column:
    """Lines of a hunk side inside a range; null ranges have none."""
    lines = F.least(start + count - 1, last) - F.greatest(start, first) + 1
    return F.when(first.isNotNull() & (count > 0), F.greatest(lines, F.lit(0))).otherwise(F.lit(0)).cast("long")


def touches(first: Column, last: Column, start: Column, count: Column) -> Column:
    """Whether a hunk side meets a range; an empty side meets it from the line above on."""
    empty = (start >= F.greatest(first - 1, F.lit(0))) & (start <= last)
    full = (start <= last) & (start + count - 1 >= first)
    return F.coalesce(F.when(count == 0, empty).otherwise(full), F.lit(False))


def nearby(first: Column, last: Column, start: Column, count: Column) -> Column:
    """As ``touches``, but also for a hunk that ends on the line above."""
    end = F.greatest(start + F.greatest(count, F.lit(1)) - 1, start)
    return F.coalesce((start <= last) & (end >= F.greatest(first - 1, F.lit(0))), F.lit(False))


def churn(pairs: DataFrame, hunks: DataFrame, by: str, entity: list[str]) -> DataFrame:
    """entity, lines_removed, lines_added and changed_hunks of pairs (b_first, b_last, t_first, t_last).

    Equal ``by`` makes it a hash join with the ranges as a residual; each
    entity's sums combine before they are shuffled.
    """
    near = pairs.join(hunks, by, "left")
    b = (F.col("b_first"), F.col("b_last"), F.col("base_start"), F.col("base_count"))
    t = (F.col("t_first"), F.col("t_last"), F.col("target_start"), F.col("target_count"))
    return near.groupBy(*entity).agg(
        F.sum(overlap(*b)).alias("lines_removed"),
        F.sum(overlap(*t)).alias("lines_added"),
        F.count_if(touches(*b) | touches(*t)).alias("changed_hunks"),
    )


def change_status(in_base: Column, in_target: Column, changed: Column) -> Column:
    return F.when(in_base & in_target, F.when(changed, "modified").otherwise("unchanged")).when(in_target, "added").otherwise("removed")


def rounded_share(lines: Column, length: Column) -> Column:
    """Share of a length, at most 1, to two decimals, halves away from zero; 0 of nothing."""
    return F.when(F.coalesce(length, F.lit(0)) > 0, F.round(F.least(lines, length) / length, 2)).otherwise(0.0)


def export_delta(base: DataFrame, target: DataFrame) -> DataFrame:
    """(path, name) sets of two sides to path, exports_added and exports_removed, sorted."""
    rows = base.select("path", "name", F.lit(True).alias("b")).union(target.select("path", "name", F.lit(False).alias("b"))).groupBy("path", "name").agg(F.bool_or("b").alias("was"), F.bool_or(~F.col("b")).alias("is"))
    pick = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("name"))))
    return rows.filter("was <> is").groupBy("path").agg(pick(F.col("is")).alias("exports_added"), pick(F.col("was")).alias("exports_removed"))
