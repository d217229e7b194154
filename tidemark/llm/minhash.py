"""Near-duplicate documents by MinHash with tensored banding.

Each document has two small collections of sub-signatures. A table key joins
one of each, so ``2 * tables`` sub-signatures serve ``tables ** 2`` tables. Two
sets of similarity s share a table with probability
``(1 - (1 - s**band)**tables)**2``: 0.9998 at 0.75 and 0.006 at 0.24 with the
defaults. Candidates are confirmed on full shingle sets, so no false link
stays.

Documents with equal sets meet as one representative first. Each other one is
first compared with one centre: of the best connected documents of its tables
the one that it shares most tables with, which is its family. Tables that then
hold one component alone are done. The documents of the others are dealt into
blocks of their family, about ``BLOCK_ITEMS`` shingles each, and a document
visits another block only if it shares a table with a document there; a task
counts common shingles of a block and its visitors and emits a spanning forest.
So no pairs are emitted, tables that merely touch don't add up, and neither a
block nor its share of visitors outgrows a task.

Null or blank texts have no shingles, link with nothing and are kept, as are
rows without doc_id. Rows that repeat a doc_id are one node. Words are split at
ASCII white space and lower-cased A-Z; texts of fewer than ``words`` words are
one shingle. Further columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, WordHash, durable, mixed, slices, stored
from .components import components, forest, with_value

WORDS, PERCENT, BAND, TABLES, SEED = 5, 75, 4, 24, 20240607
#: Shingles of a block, about, and small blocks that share a task.
BLOCK_ITEMS, BLOCKS_A_TASK = 1 << 16, 16

_HASH = WordHash()
_ROLL = Rolling(0x9E3779B97F4A7C15)


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    return np.unique(_ROLL.windows(_HASH.of(parts), min(words, len(parts))))


def sign(docs: DataFrame, words: int = WORDS, band: int = BAND, tables: int = TABLES, seed: int = SEED) -> DataFrame:
    """doc_id, n_shingles, digest of the set, and both collections of sub-signatures."""
    n = 2 * tables * band
    rng = np.random.default_rng(seed)
    factor = rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1)
    shift = rng.integers(0, 1 << 32, n, np.uint32)
    spread = np.arange(1, 2 * tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    fields = [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("keys", pa.list_(pa.int64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sizes, digests, keys = [], [], []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                s = shingles(text, words)
                sizes.append(len(s))
                if not len(s):
                    digests.append(None)
                    continue
                weights = mixed(s ^ np.uint64(0x5851F42D4C957F2D))
                digests.append(np.array([s.sum(dtype=np.uint64), weights.sum(dtype=np.uint64), len(s)], np.uint64).tobytes())
                low, least = (s >> np.uint64(32)).astype(np.uint32), np.full(n, 0xFFFFFFFF, np.uint32)
                for at in range(0, len(low), 1024):
                    np.minimum(least, (low[at : at + 1024, None] * factor + shift).min(axis=0), out=least)
                out = spread.copy()
                for part in least.reshape(2 * tables, band).T.astype(np.uint64):
                    out = mixed(out ^ part)
                keys.append(out.view(np.int64))
            ends = np.cumsum([0] + [2 * tables if k else 0 for k in sizes]).astype(np.int32)
            values = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], schema=pa.schema(fields))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, digest binary, keys array<long>")


def confirm(pairs: DataFrame, docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs (u, v) of documents whose full sets have ``100 * common >= percent * union``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            held: dict[int, np.ndarray] = {}
            good = []
            for v, left, right in zip(b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), b.column(3).cast(pa.binary()).to_pylist()):
                x = shingles(left, words)
                if v not in held:
                    if len(held) > 200:
                        held.clear()
                    held[v] = shingles(right, words)
                y = held[v]
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(len(x) > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            yield b.select([0, 1]).filter(pa.array(good, pa.bool_()))

    text = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).filter("id is not null")
    left = pairs.join(text.withColumnsRenamed({"id": "u", "text": "left"}), "u")
    return left.join(text.withColumnsRenamed({"id": "v", "text": "right"}), "v").select("u", "v", "left", "right").mapInArrow(run, "u long, v long")


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, c) of the components ``labels`` after ``links`` (u, v) joined some."""
    for end in ("u", "v"):
        links = links.join(labels.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    merged = durable(components(links))
    grown = labels.join(merged.withColumnRenamed("node", "c"), "c", "left").select("node", F.coalesce("component", "c").alias("c"))
    return grown.union(merged.join(labels, "node", "left_anti").select("node", F.col("component").alias("c")))


def _linked(x: list[np.ndarray], y: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of ``x`` and ``y`` are similar, by counting common items column by column."""
    nx, ny = np.array([len(s) for s in x]), np.array([len(s) for s in y])
    fx, fy = np.concatenate(x), np.concatenate(y)
    shared = np.intersect1d(fx, fy)
    common = np.zeros((len(x), len(y)), np.float32)
    if len(shared):
        (rx, cx), (ry, cy) = ((row[ok], at[ok]) for row, at, ok in (_columns(fx, nx, shared), _columns(fy, ny, shared)))
        for at in range(0, len(shared), 4096):
            p, q = np.zeros((len(x), 4096), np.float32), np.zeros((len(y), 4096), np.float32)
            for m, r, c in ((p, rx, cx), (q, ry, cy)):
                inside = (c >= at) & (c < at + 4096)
                m[r[inside], c[inside] - at] = 1
            common += p @ q.T
    total = common.astype(np.int64)
    return 100 * total >= percent * (nx[:, None] + ny[None, :] - total)


def _columns(items: np.ndarray, sizes: np.ndarray, shared: np.ndarray):
    at = np.minimum(np.searchsorted(shared, items), len(shared) - 1)
    return np.repeat(np.arange(len(sizes)), sizes), at, shared[at] == items


def _block_links(percent: int):
    """Spanning links of each block's sets and, for a visit, of the block's with its visitors'."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        edges = [np.zeros((2, 0), np.int64)]
        for (_, visit), part in pdf.groupby(["block", "visit"], sort=False):
            ids = [part.rep[part.guest == g].to_numpy() for g in (False, True)]
            home, guest = ([np.frombuffer(v, np.uint64) for v in part["items"][part.guest == g]] for g in (False, True))
            if len(home) > 1 and visit == 0:
                edges.append(np.stack([np.concatenate([ids[0]] * 2), np.concatenate([ids[0]] * 2)[forest(_linked(home, home, percent))]]))
            if home and guest:
                both = np.concatenate(ids)
                edges.append(np.stack([both, both[forest(_linked(home, guest, percent))]]))
        found = np.unique(np.concatenate(edges, axis=1), axis=1)
        found = found[:, found[0] != found[1]]
        return pd.DataFrame({"u": found[0], "v": found[1]})

    return run


def _blocked(members: DataFrame, families: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (u, v) that span those between documents that share a table.

    ``members`` are (key, rep, n) of the tables, ``families`` (rep, family).
    """
    # Families of families, four steps up: what hangs together shares few blocks.
    for _ in range(2):
        up = families.select(F.col("rep").alias("family"), F.col("family").alias("above"))
        families = durable(families.join(up, "family", "left").select("rep", F.coalesce("above", "family").alias("family")))
    own = durable(members.select("rep", "n").distinct().join(families, "rep", "left").select("rep", "n", F.coalesce("family", "rep").alias("family")))
    parts = F.ceil(F.sum("n") / BLOCK_ITEMS).cast("long").alias("parts")
    sized = with_value(own, own.groupBy("family").agg(parts, F.count("*").alias("n")), "family", own.count())
    placed = durable(sized.select("rep", F.xxhash64("family", F.pmod(F.xxhash64("rep"), "parts")).alias("block"), "n"))
    there = durable(members.select("key", "rep", "n").join(placed.drop("n"), "rep"))
    # A table's blocks are a list, as long as its documents' shingles over BLOCK_ITEMS; a document has as many tables as the tensor.
    blocks = stored(there.groupBy("key").agg(F.collect_set("block").alias("to")))
    lower = F.array_sort(F.filter("to", lambda x: x < F.col("block")))
    visits = there.join(blocks, "key").select("rep", "n", lower.alias("to")).groupBy("rep", "n").agg(F.array_distinct(F.flatten(F.collect_set("to"))).alias("to"))
    visits = durable(visits.select("rep", "n", F.explode("to").alias("block")))
    # How many lots a block's visitors are dealt into, and whether a block is worth a task of its own.
    lots = visits.groupBy("block").agg(F.ceil(F.sum("n") / BLOCK_ITEMS).cast("long").alias("lots"), F.sum("n").alias("away"), F.count("*").alias("n"))
    homes = placed.groupBy("block").agg(F.count("*").alias("k"), F.sum("n").alias("items")).join(lots, "block", "left").filter("k > 1 or lots is not null")
    large = F.col("items") + F.coalesce("away", F.lit(0)) > BLOCK_ITEMS // 4
    homes = durable(homes.select("block", F.coalesce("lots", F.lit(1)).alias("lots"), large.alias("large"), F.greatest("k", F.coalesce("n", F.lit(0))).alias("n")))
    tasks = max(64, homes.count() // BLOCKS_A_TASK)
    at_home = placed.select("rep", "block").join(homes.drop("n"), "block").select("rep", "block", "large", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("visit"), F.lit(False).alias("guest"))
    away = with_value(visits.select("rep", "block"), homes, "block", visits.count()).select("rep", "block", "large", F.pmod(F.xxhash64("rep", F.lit(5)), "lots").alias("visit"), F.lit(True).alias("guest"))
    mix = F.xxhash64("block", "visit")
    task = F.when(F.col("large"), mix).otherwise(F.pmod(mix, F.lit(tasks)))
    places = at_home.unionByName(away).groupBy("rep").agg(F.collect_list(F.struct(task.alias("task"), "block", "visit", "guest")).alias("places"))
    fields = pa.schema([("rep", pa.int64()), ("items", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            items = pa.array([shingles(t, words).tobytes() for t in b.column(1).cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), items, b.column(2)], schema=fields.append(pa.field("places", b.column(2).type)))

    text = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text")).filter("rep is not null")
    full = text.join(places, "rep").select("rep", "text", "places").mapInArrow(sets, "rep long, items binary, places array<struct<task: long, block: long, visit: long, guest: boolean>>")
    spread = full.select("rep", "items", F.explode("places").alias("p")).select("p.*", "rep", "items")
    return spread.groupBy("task").applyInPandas(_block_links(percent), "u long, v long")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, band: int = BAND, tables: int = TABLES, seed: int = SEED) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked doc_id) and kept, one row for each row of ``docs``."""
    signed = stored(sign(docs, words, band, tables, seed))
    sets = signed.filter("n_shingles > 0 and doc_id is not null")
    # Equal sets: the smallest document stands for all.
    reps = stored(sets.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")))
    # Sub-signatures that one set alone has can't be part of a shared table key.
    subs = reps.select("rep", "n", F.posexplode("keys").alias("i", "key"))
    shared = subs.groupBy("key").agg(F.count("*").alias("sets")).filter("sets > 1").select("key")
    both = subs.join(shared, "key").groupBy("rep").agg(F.first("n").alias("n"), F.collect_list(F.when(F.col("i") < tables, F.col("key"))).alias("a"), F.collect_list(F.when(F.col("i") >= tables, F.col("key"))).alias("b"))
    tensor = F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.xxhash64(x, y))))
    keyed = stored(both.select("rep", "n", F.explode(tensor).alias("key")))
    # Written, so that the adaptive plan can split a hot key's side of each join.
    shared_keys = stored(keyed.groupBy("key").agg(F.count("*").alias("sets")).filter("sets > 1"))
    shares = stored(keyed.join(shared_keys, "key").select("key", "rep", "n", "sets"))
    weights = shares.groupBy("rep").agg(F.sum(F.col("sets") - 1).alias("w"))
    members = stored(shares.join(weights, "rep").select("key", "rep", "n", "w"))
    # The best connected document of each table, and of those the one that a document shares most tables with.
    centre = stored(members.groupBy("key").agg((-F.max(F.struct("w", (-F.col("rep")).alias("less")))["less"]).alias("family")))
    votes = members.join(centre, "key").filter("rep <> family").groupBy("rep", "family").agg(F.count("*").alias("tables"))
    families = durable(votes.groupBy("rep").agg(F.max_by("family", F.struct("tables", -F.col("family"))).alias("family")))
    first = confirm(families.select(F.greatest("rep", "family").alias("u"), F.least("rep", "family").alias("v")).distinct(), docs, words, percent)
    labels = durable(components(first).withColumnRenamed("component", "c"))
    # Tables of more than one component.
    own = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("c", "rep").alias("c"))
    open_keys = stored(own.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key"))
    still = stored(own.join(open_keys, "key").select("key", "rep", "n"))
    more = durable(_blocked(still, families, docs, words, percent))
    grouped = _relabelled(labels, more).select("node", F.col("c").alias("component"))
    named = reps.select("digest", "rep").join(grouped.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("c"))
    return (
        signed.select("doc_id", "n_shingles", "digest")
        .join(named, "digest", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose document is kept, columns as they came; of rows alike in doc_id and text one stays."""
    kept = near_duplicates(docs, **options).filter("kept and doc_id is not null").select(F.col("doc_id").alias("_kept")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_key"))
    known = rows.filter("_id is not null").join(kept, F.col("_id") == F.col("_kept"), "left_semi")
    return known.union(rows.filter("_id is null")).dropDuplicates(["_id", "_key"]).select("row.*")
