"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one kept per group.

A table of ``n`` distinct vectors gets about ``sqrt(n)`` cells, ``MAX_CELLS``
at most, whose centres are fitted on a bounded sample (``SAMPLE`` vectors and
``SAMPLE_BYTES``); every vector is placed and compared. A vector lives in the
cell of its nearest centre and visits the next nearest cells, ``PROBES`` in
all, unless none of their vectors can be within reach. Vectors of a cell meet
one another and its visitors, so a pair is compared if either visits the
other's cell, and is counted once. Tables of up to ``WHOLE`` vectors are one
cell, so they lose no link; beyond, pairs right at the threshold in evenly
spread vectors are the ones that may be missed (README has the recall).
Centres within the threshold of another are merged, so one dense group is one
cell, however large; cells and their visitors are dealt into blocks of bounded
size by hash, and a task compares two blocks.

Equal vectors meet first and are compared once. A task emits link counts and a
spanning forest, never its pairs. Vectors of different lengths never link, nor
do null, empty and zero vectors or those with null or non-finite components;
they are kept, as are rows without vec_id. Rows that repeat a vec_id count as
separate vectors of one node. Further columns are left out. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, stored
from .components import components, forest

THRESHOLD, SEED = 0.9, 7
#: The sample that centres are fitted on: vectors and bytes in double precision.
SAMPLE, SAMPLE_BYTES = 16_384, 1 << 26
#: Vectors of a block, on average; tables up to this size are one cell; cells that a vector is compared in.
BLOCK, WHOLE, MAX_CELLS, PROBES = 4096, 4096, 4096, 6
#: Rows of a product held at once.
_ROWS = 1024


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[at : at + _ROWS] @ centres.T).argmax(axis=1) for at in range(0, len(x), _ROWS)])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, merge: float = 1.0, seed: int = SEED) -> np.ndarray:
    """At most ``k`` unit centres of the unit rows ``x``; of centres with a cosine above ``merge`` the first stays."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for left in range(rounds, -1, -1):
        cell = _nearest(x, centres)
        order = np.argsort(cell, kind="stable")
        first = np.flatnonzero(np.diff(cell[order], prepend=-1))
        sums = np.add.reduceat(x[order], first)
        norm = np.linalg.norm(sums, axis=1)
        full = norm > 1e-12
        centres[cell[order][first[full]]] = sums[full] / norm[full, None]
        if left == 1:
            centres = _apart(centres, merge)
    return centres


def _apart(centres: np.ndarray, merge: float) -> np.ndarray:
    kept = np.ones(len(centres), bool)
    for i in range(len(centres)):
        if kept[i]:
            kept[i + 1 :] &= centres[i + 1 :] @ centres[i] < merge
    return centres[kept]


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    width = len(column.flatten()) // max(len(column), 1)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _products(x: np.ndarray, y: np.ndarray, threshold: float):
    """(row offset, links) of slices of ``x`` against ``y``."""
    for at in range(0, len(x), _ROWS):
        product = x[at : at + _ROWS] @ y.T
        linked = product >= threshold
        for i, j in np.argwhere(np.abs(product - threshold) < 1e-12):  # the order of additions must not decide
            linked[i, j] = float(np.sum(x[at + i].astype(np.longdouble) * y[j])) >= threshold
        yield at, linked


class _Side:
    """Vectors of one block with their link counts."""

    def __init__(self, rows: pd.DataFrame, kind: str):
        self.node, self.weight = rows.node.to_numpy(), rows.weight.to_numpy()
        self.x = _unit([np.frombuffer(v, kind) for v in rows.vector])
        self.cells = np.stack(rows.cells.to_list())
        self.counts = np.zeros(len(rows), np.int64)


def _compare(threshold: float, kind: str):
    """Links of a task: rows (node, n_links, root).

    Sides: 0 and 1 are two blocks of a cell, 2 a block that meets itself, 3 a
    block that visits 0 or 2.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[np.ndarray] = []
        sides = {k: _Side(rows.sort_values("node"), kind) for k, rows in pdf.groupby("side")}

        def meet(a: _Side, b: _Side, allowed=None) -> None:
            for at, linked in _products(a.x, b.x, threshold):
                if allowed is not None:
                    linked &= allowed(at, at + len(linked))
                a.counts[at : at + len(linked)] += linked @ b.weight
                if a is not b:
                    b.counts += a.weight[at : at + len(linked)] @ linked
                left, right = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
                if len(left):
                    ids = np.concatenate([a.node[at + left], b.node[right]])
                    found.append(np.stack([ids, ids[forest(linked[np.ix_(left, right)])]]))

        home = sides.get(2) or sides.get(0)
        if 2 in sides:
            meet(home, home, lambda i, j: home.node[i:j, None] != home.node[None, :])
        if home and 1 in sides:
            meet(home, sides[1])
        if home and 3 in sides:
            guest = sides[3]
            # A pair that visits both ways is compared in the cell of the smaller number.
            def once(i: int, j: int) -> np.ndarray:
                again = np.zeros((j - i, len(guest.node)), bool)
                for p in range(1, home.cells.shape[1]):
                    again |= home.cells[i:j, p, None] == guest.cells[None, :, 0]
                return ~(again & (guest.cells[None, :, 0] < home.cells[i:j, 0, None]))

            meet(home, guest, once)
        out = [np.stack([s.node, s.counts, s.node])[:, s.counts > 0] for s in sides.values()]
        if found:
            edges = np.unique(np.concatenate(found, axis=1), axis=1)
            edges = edges[:, edges[0] != edges[1]]
            out.append(np.stack([edges[0], np.zeros(edges.shape[1], np.int64), edges[1]]))
        both = np.concatenate(out, axis=1).astype(np.int64)
        return pd.DataFrame({"node": both[0], "n_links": both[1], "root": both[2]})

    return run


def _spread(rows: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of ``rows`` repeated ``count`` times, with first, first + 1, ..."""
    again = np.repeat(rows, count)
    step = np.arange(len(again)) - np.repeat(np.cumsum(count) - count, count)
    return again, np.repeat(first, count) + step


def _compared(vectors: DataFrame, n: int, width: int, threshold: float, kind: str, whole: int, probes: int) -> DataFrame:
    """node, n_links, root over distinct vectors of one length (node, weight, embedding)."""
    most = int(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width))))
    rate = min(1.0, 2 * most / n)
    centres = np.zeros((1, width))
    if n > whole:
        drawn = vectors.filter(F.pmod(F.xxhash64("node", F.lit(SEED)), F.lit(1 << 20)) < int(rate * (1 << 20)) + 1).select("embedding").limit(most).toArrow()
        sample = _unit(_matrix(drawn.column(0).combine_chunks()))
        centres = spherical_kmeans(sample, max(1, min(MAX_CELLS, int(n**0.5), len(sample) // 4)), merge=threshold)
    k = len(centres)
    probes = min(probes, k)
    reach = float(np.arccos(threshold)) + 1e-6

    def cells_of(x: np.ndarray) -> np.ndarray:
        """The nearest cells of unit rows, nearest first; -1 where no vector of a cell can be near enough."""
        to = x @ centres.T
        near = np.argpartition(-to, probes - 1, axis=1)[:, :probes]
        cosine = np.take_along_axis(to, near, axis=1)
        by = np.argsort(-cosine, axis=1, kind="stable")
        near, cosine = np.take_along_axis(near, by, axis=1), np.take_along_axis(cosine, by, axis=1)
        apart = np.linalg.norm(centres[near] - centres[near[:, :1]], axis=2)
        out = np.where(cosine[:, :1] - cosine <= np.sin(reach) * apart + 1e-9, near, -1)
        out[:, 0] = near[:, 0]
        return out.astype(np.int32)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                b = batch.slice(at, _ROWS)
                raw = _matrix(b.column(2))
                cells = cells_of(_unit(raw))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(cells.reshape(-1)), probes).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([v.tobytes() for v in raw.astype(kind)], pa.binary()), lists], names=["node", "weight", "vector", "cells"])

    assigned = stored(vectors.select("node", "weight", "embedding").mapInArrow(assign, "node long, weight long, vector binary, cells array<int>"))
    # One row for each cell, of which there are MAX_CELLS at most.
    sizes, guests = np.zeros(k, np.int64), np.zeros(k, np.int64)
    for r in assigned.select(F.posexplode("cells").alias("p", "cell")).filter("cell >= 0").groupBy("cell").agg(F.count_if(F.col("p") == 0).alias("own"), F.count_if(F.col("p") > 0).alias("guests")).collect():
        sizes[r.cell], guests[r.cell] = r.own, r.guests
    blocks, visits = -(-sizes // BLOCK), -(-guests // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                b = batch.slice(at, _ROWS)
                node, cells = b.column(0).to_numpy(), np.stack(b.column(3).to_pylist())
                mix = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).astype(np.int64)
                everyone, c = np.arange(len(node)), cells[:, 0]
                own = first[c] + mix % blocks[c]
                # Home blocks against one another, then against further blocks of visitors; right is -1, -2, ... there.
                i, to = _spread(everyone, first[c], blocks[c])
                parts = [(i, np.minimum(own[i], to), np.maximum(own[i], to), np.where(to == own[i], 2, np.where(to > own[i], 0, 1)))]
                i, g = _spread(everyone, np.ones(len(c), np.int64), np.maximum(visits[c] - 1, 0))
                parts.append((i, own[i], -g, np.zeros(len(i), np.int64)))
                for p in range(1, cells.shape[1]):
                    there = np.flatnonzero(cells[:, p] >= 0)
                    d = cells[there, p]
                    g = mix[there] // 31 % visits[d] if len(there) else d
                    i, to = _spread(np.arange(len(there)), first[d], blocks[d])
                    parts.append((there[i], to, np.where(g[i] == 0, to, -g[i]), np.full(len(i), 3)))
                rows, left, right, side = (np.concatenate(x).astype(np.int64) for x in zip(*parts))
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(left), pa.array(right), pa.array(side.astype(np.int32)), *(b.column(j).take(take) for j in range(4))],
                    names=["left", "right", "side", "node", "weight", "vector", "cells"],
                )

    dealt = assigned.mapInArrow(deal, "left long, right long, side int, node long, weight long, vector binary, cells array<int>")
    return dealt.groupBy("left", "right").applyInPandas(_compare(threshold, kind), "node long, n_links long, root long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, whole: int = WHOLE, probes: int = PROBES) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row for each row of ``vectors`` (vec_id, embedding)."""
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    good = e.isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists(e, lambda v: v != 0)
    # -0.0 and 0.0 are one value.
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e.cast("array<double>"), lambda v: v + F.lit(0.0)).alias("embedding"), F.coalesce(good, F.lit(False)).alias("good"))
    rows = rows.withColumn("digest", F.when(F.col("good"), F.sha2(F.array_join(F.transform("embedding", lambda v: v.cast("string")), ","), 256)))
    keyed = rows.select("vec_id", "digest")
    distinct = stored(rows.filter("good").groupBy("digest").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"), F.first("embedding").alias("embedding")))
    # Single-precision input travels as such; all arithmetic is in double precision.
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    parts = None
    for r in distinct.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).collect():
        one = _compared(distinct.filter(F.size("embedding") == r.d), r.n, r.d, threshold, kind, whole, probes)
        parts = one if parts is None else parts.union(one)
    if parts is None:
        return keyed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = durable(parts)
    counts = found.groupBy("node").agg(F.sum("n_links").alias("n"))
    grouped = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    named = distinct.select("digest", "node", "weight").join(counts, "node", "left").join(grouped, "node", "left").select("digest", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "node").alias("c"))
    return keyed.join(named, "digest", "left").select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("c", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("c", "vec_id"), F.lit(True)).alias("kept"),
    )
