"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable


EDGES_A_TASK = 10_000
#: Rows that a broadcast side has at most (two longs each), and the share of all rows that makes a key hot.
BROADCAST_ROWS, HOT_SHARE = 200_000, 1 / 1000


def with_value(rows: DataFrame, values: DataFrame, key: str, size: int) -> DataFrame:
    """``rows`` joined with ``values`` (key, value columns, n: rows of that key) whatever the skew of the key.

    ``size`` bounds the rows of both. Up to BROADCAST_ROWS the values are
    broadcast. Beyond, keys with more than HOT_SHARE of ``size`` rows, of which
    there are ``1 / HOT_SHARE`` at most, are; only the others are shuffled.
    """
    if size <= BROADCAST_ROWS:
        return rows.join(F.broadcast(values.drop("n")), key)
    values = durable(values)
    hot = values.filter(F.col("n") > size * HOT_SHARE).drop("n")
    cold = values.filter(F.col("n") <= size * HOT_SHARE).drop("n")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def _large_star(edges: DataFrame, size: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return with_value(both.filter("v > u"), least, "u", 2 * size).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, size: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    linked = with_value(down, least, "u", size).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (u, v): component is the smallest node reachable.

    Self-loops and null ends are dropped, repeated edges count once; no edges
    give no rows. Neighbours are reduced to their minimum before a shuffle, and
    a hub's rows get it by broadcast, so a hub costs no task more than its
    share. Two star steps a round; rounds grow with the logarithm of the
    largest diameter.
    """
    now = durable(edges.select("u", "v").filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    now = now.coalesce(1 + now.count() // EDGES_A_TASK)
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if mark == seen:
            break
        seen = mark
        if not mark[0]:
            break
        # Few edges need few files: each task of a later map writes its own.
        larger = durable(_large_star(now, mark[0]).coalesce(1 + mark[0] // EDGES_A_TASK))
        now = durable(_small_star(larger, mark[0]).coalesce(1 + mark[0] // EDGES_A_TASK))
    tree = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return tree.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
