"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source's rate is its target share of all characters over its own share. Each
document's count is the Poisson value of that mean at a number in (0, 1) drawn
by hashing the seed and doc_id: the count of cumulative probabilities that do
not exceed it. Documents are repeated by their counts and sorted by a second
hash, which shuffles them globally and deals copies of a hot source evenly.

A null source is a source of its own. Null texts have no characters; a source
of none has rate 0. Rows that share a doc_id draw the same count; null doc_ids
draw one together. Ties of the second hash are broken by doc_id and copy; rows that
share both are alike but for their other columns, in no fixed order. An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

SEED, ALPHA = 17, 0.7
#: Probabilities of all sources that are broadcast at most: 16 MB.
BROADCAST_NUMBERS = 2_000_000


def drawn(*parts: Column | str) -> Column:
    """A number in (0, 1) from a hash of the parts."""
    text = F.md5(F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("null")) if isinstance(p, str) else p for p in parts]))
    return (F.conv(F.substring(text, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def cumulative(rates: DataFrame) -> DataFrame:
    """``rates`` (source, rate) with ``cdf``: cumulative Poisson probabilities of 0, 1, ... as far as a number in (0, 1) of 52 bits can tell.

    Probabilities are rows that a window sums up, so the work follows the rate.
    """
    top = (F.ceil(F.col("rate") + 12 * F.sqrt("rate")) + 40).cast("int")
    ks = rates.filter("rate > 0").select("source", "rate", F.explode(F.sequence(F.lit(0), top)).alias("k"))
    up = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    log = F.sum(F.when(F.col("k") == 0, -F.col("rate")).otherwise(F.ln("rate") - F.ln(F.greatest("k", F.lit(1)).cast("double")))).over(up)
    total = ks.withColumn("log", log).withColumn("total", F.sum(F.exp("log")).over(up))
    tables = total.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "total"))), lambda x: x.total).alias("cdf"))
    # A source of no rate draws 0.
    return rates.join(tables.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").select("source", F.coalesce("cdf", F.array(F.lit(1.0))).alias("cdf"))


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = ALPHA) -> DataFrame:
    """source and rate: repetitions of a document on average.

    ``weights`` gives each source's target share (sources left out get none);
    without it shares go as the source's characters to the power ``alpha``.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).cast("double").alias("size"))
    if weights is None:
        wanted = sizes.withColumn("weight", F.pow("size", F.lit(alpha)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "s string, weight double")
        wanted = sizes.join(given, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    totals = wanted.agg(F.sum(F.when(F.col("size") > 0, F.col("weight"))).alias("w"), F.sum("size").alias("t"))
    # One row.
    rate = F.when((F.col("size") > 0) & (F.col("w") > 0), F.col("weight") / F.col("w") * F.col("t") / F.col("size")).otherwise(0.0)
    return wanted.join(F.broadcast(totals)).select("source", rate.alias("rate"))


def _mixed(docs: DataFrame, weights: dict[str | None, float] | None, alpha: float, seed: int) -> DataFrame:
    tables = durable(cumulative(durable(rates(docs, weights, alpha))).withColumnsRenamed({"source": "_source", "cdf": "_cdf"}))
    # Few sources are broadcast, which leaves the texts of a hot one where they are; many are joined, and none is hot for long:
    # the adaptive plan splits it, as both sides of the join are shuffled as they stand.
    small = tables.agg(F.coalesce(F.sum(F.size("_cdf")), F.lit(0))).first()[0] <= BROADCAST_NUMBERS
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.col("source").alias("_of"))
    rows = rows.join(F.broadcast(tables) if small else tables, F.col("_of").eqNullSafe(F.col("_source")))
    u = drawn(F.lit(str(seed)), "_id")
    rows = rows.withColumn("_n", F.transform(F.array(u), lambda v: F.size(F.filter("_cdf", lambda c: c <= v)))[0].cast("long")).filter("_n > 0")
    rows = rows.select("_row", "_id", "_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_copy"))
    key = F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), F.coalesce(F.col("_id").cast("string"), F.lit("null")), F.col("_copy").cast("string")))
    return rows.withColumn("_key", key).orderBy("_key", "_id", "_copy")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """The columns of ``docs``, then copy (from 1), n_copies and shuffle_key; globally shuffled.

    Where ``docs`` has a column of such a name, the new one gets an underscore more.
    """
    taken, names = {c.lower() for c in docs.columns}, []
    for name in ("copy", "n_copies", "shuffle_key"):
        while name in taken:
            name += "_"
        names.append(name)
    return _mixed(docs, weights, alpha, seed).select("_row.*", F.col("_copy").alias(names[0]), F.col("_n").alias(names[1]), F.col("_key").alias(names[2]))


def mixed_rows(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """As ``mix``, with the columns of ``docs`` alone."""
    return _mixed(docs, weights, alpha, seed).select("_row.*")


#: The same draws over ``documents`` in DuckDB.
DUCKDB_SQL = f"""
WITH RECURSIVE s AS (SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS size FROM documents GROUP BY source),
w AS (SELECT source, size, pow(size, {ALPHA}) AS weight FROM s),
t AS (SELECT sum(weight) FILTER (size > 0) AS w, sum(size) AS t FROM w),
r AS (SELECT source, CASE WHEN size > 0 AND w > 0 THEN weight / w * t / size ELSE 0.0 END AS rate FROM w, t),
c AS (SELECT source, rate, 0 AS k, -rate AS lg, exp(-rate) AS total FROM r WHERE rate > 0
  UNION ALL SELECT source, rate, k + 1, lg + ln(rate) - ln(k + 1), total + exp(lg + ln(rate) - ln(k + 1)) FROM c WHERE k < ceil(rate + 12 * sqrt(rate)) + 40),
d AS (SELECT doc_id, text, source, (CAST(('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM documents),
n AS (SELECT d.*, (SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM d.source AND c.total <= d.u) AS n_copies FROM d)
SELECT doc_id, text, source, CAST(i AS BIGINT) AS copy, n_copies, md5('{SEED}-order|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || CAST(i AS VARCHAR)) AS shuffle_key
FROM n, unnest(range(1, n_copies + 1)) v(i)
"""
