"""Repeated passages across documents, found on a compacted De Bruijn graph.

Every window of ``window`` words is an edge of the graph. Runs of neighbouring
windows that share their least ``minimizer``-gram form nonbranching paths,
about one for each 18 words, and only these leave a task. Joins then compact:
equal paths meet at their smallest document; where one minimizer heads
different paths, which happens only at the ends of a repeated passage, the
windows of one copy of each path are compared one by one, and what is found
there holds for the path's other copies in that document too. Neighbouring spans
that continue the same source are joined into one. Paths are compared among
those of one minimizer, by a 64-bit digest of all their words at their source
coordinates; windows by two digests of different bases.

A span is removed if its windows also start in a document with a smaller
doc_id; windows are judged on the input. Null texts have no words. Rows
without doc_id, and texts of fewer than ``window`` words, lose nothing. Rows
that repeat a doc_id never remove each other's words. Words are split at ASCII
white space and otherwise unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Rolling, WordHash, mixed, slices, stored

WINDOW, MINIMIZER = 50, 16

_HASH = WordHash(seed=8)
_ONE, _TWO = Rolling(0xD1342543DE82EF95), Rolling(0x2545F4914F6CDD1D)
_ROWS = 200_000


def _digests(text: bytes | None):
    """Word hashes and both prefix sums of a text."""
    one = _HASH.of((text or b"").split())
    two = mixed(one ^ np.uint64(0xA0761D6478BD642F))
    return one, _ONE.prefix(one), _TWO.prefix(two)


def _batch(parts: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64) if c[0].dtype != np.uint64 else np.concatenate(c).view(np.int64)) for c in zip(*parts)], names=names)


def _keyed(docs: DataFrame) -> DataFrame:
    """Texts with the keys that tell rows apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash(text).cast("long").alias("text_key"), text.alias("text"))


def paths(docs: DataFrame, window: int = WINDOW, minimizer: int = MINIMIZER) -> DataFrame:
    """anchor, digest, doc_id, text_key, at, n: ``n`` windows from word ``at`` that share a minimizer."""
    names = ["anchor", "digest", "doc_id", "text_key", "at", "n"]
    reach = window - minimizer + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in slices(batches):
            for doc_id, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
                h, p1, p2 = _digests(text)
                if len(h) < window:
                    continue
                start = np.arange(len(h) - minimizer + 1)
                grams = _ONE.spans(p1, start, start + minimizer)
                n = len(h) - window + 1
                least = np.empty(n, np.int64)
                for at in range(0, n, 8192):
                    view = np.lib.stride_tricks.sliding_window_view(grams[at : at + 8192 + reach - 1], reach)[: n - at]
                    least[at : at + len(view)] = view.argmin(axis=1) + np.arange(at, at + len(view))
                at = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
                stop = np.append(at[1:], n) + window - 1
                parts.append([grams[least[at]], _TWO.spans(p2, at, stop), np.full(len(at), doc_id), np.full(len(at), key), at, stop - at - window + 1])
                held += len(at)
                if held >= _ROWS:
                    yield _batch(parts, names)
                    parts, held = [], 0
        if parts:
            yield _batch(parts, names)

    return _keyed(docs).filter("doc_id is not null and text is not null").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _windows(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """w1, w2, doc_id, text_key, at of each window of ``wanted`` (doc_id, text_key, at, n), and the ``start`` of its path."""
    names = ["w1", "w2", "doc_id", "text_key", "at", "start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in slices(batches):
            for doc_id, key, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist()):
                _, p1, p2 = _digests(text)
                at = np.concatenate([np.arange(x["at"], x["at"] + x["n"]) for x in spans])
                start = np.concatenate([np.full(x["n"], x["at"]) for x in spans])
                parts.append([_ONE.spans(p1, at, at + window), _TWO.spans(p2, at, at + window), np.full(len(at), doc_id), np.full(len(at), key), at, start])
                held += len(at)
                if held >= _ROWS:
                    yield _batch(parts, names)
                    parts, held = [], 0
        if parts:
            yield _batch(parts, names)

    per_doc = wanted.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    return _keyed(docs).join(per_doc, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "spans").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def repeated_spans(docs: DataFrame, window: int = WINDOW, minimizer: int = MINIMIZER) -> DataFrame:
    """doc_id, text_key, at, n_words, source_id, source_at: passages that also start in a smaller doc_id."""
    found = stored(paths(docs, window, minimizer))
    path, source = ["anchor", "digest"], F.min(F.struct("doc_id", "at", "text_key", "n")).alias("source")
    least = stored(found.groupBy(*path).agg(source, F.count("*").alias("copies")))
    sources = least.filter("copies > 1").select(*path, F.col("source.doc_id").alias("source_id"), F.col("source.at").alias("source_at"), F.col("source.text_key").alias("source_key"))
    copies = stored(found.join(sources, path).filter("source_id < doc_id or source_at <> at or source_key <> text_key").drop(*path))
    whole = copies.filter("source_id < doc_id").select("doc_id", "text_key", "at", F.col("n").alias("n_windows"), "source_id", "source_at")
    # A minimizer of more than one path: a branch, or the end of a passage.
    branching = least.groupBy("anchor").agg(F.count("*").alias("k")).filter("k > 1").select("anchor")
    ends = least.join(branching, "anchor").select("source.doc_id", "source.text_key", "source.at", "source.n")
    single = stored(_windows(docs, ends, window))
    first = single.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "at")).alias("s"), F.count("*").alias("copies")).filter("copies > 1")
    edges = stored(
        single.join(first.select("w1", "w2", F.col("s.doc_id").alias("source_id"), F.col("s.at").alias("source_at")), ["w1", "w2"])
        .filter("source_id < doc_id")
        .select("doc_id", "text_key", "at", "start", "source_id", "source_at")
    )
    # The path's other copies in its source's document: no smaller document has them whole, so its windows are theirs.
    again = copies.filter("source_id = doc_id").select("doc_id", F.col("source_key").alias("k"), F.col("source_at").alias("start"), "text_key", "at").distinct()
    per_path = edges.groupBy("doc_id", F.col("text_key").alias("k"), "start").agg(F.collect_set(F.struct("at", "source_id", "source_at")).alias("w"))
    carried = again.join(per_path, ["doc_id", "k", "start"]).select("doc_id", "text_key", (F.col("at") - F.col("start")).alias("shift"), F.explode("w").alias("w"))
    one = F.lit(1).cast("long").alias("n_windows")
    spans = whole.union(edges.select("doc_id", "text_key", "at", one, "source_id", "source_at")).union(
        carried.select("doc_id", "text_key", (F.col("w.at") + F.col("shift")).alias("at"), one, "w.source_id", "w.source_at")
    )
    # Compaction: a span that goes on where another ends, here and in the source, joins it.
    line = Window.partitionBy("doc_id", "text_key").orderBy("at", "n_windows", "source_id", "source_at")
    follows = F.struct((F.lag(F.col("at") + F.col("n_windows")).over(line)), F.lag("source_id").over(line), F.lag(F.col("source_at") + F.col("n_windows")).over(line)) == F.struct("at", "source_id", "source_at")
    marked = spans.withColumn("head", F.when(follows, 0).otherwise(1)).withColumn("path", F.sum("head").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("doc_id", "text_key", "path").agg(
        F.min("at").alias("at"), (F.sum("n_windows") + window - 1).alias("n_words"), F.min("source_id").alias("source_id"), F.min("source_at").alias("source_at")
    ).drop("path")


def _cut(text: bytes | None, spans: list[dict] | None) -> tuple[int, int, bytes]:
    """Words of a text, words removed, and the others joined by one space."""
    words = (text or b"").split()
    if not spans:
        return len(words), 0, b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    for x in spans:
        step[x["at"]] += 1
        step[x["at"] + x["n_words"]] -= 1
    stay = np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()
    return len(words), len(words) - len(stay), b" ".join([words[i] for i in stay])


def _spans_by_document(docs: DataFrame, window: int, minimizer: int) -> DataFrame:
    return repeated_spans(docs, window, minimizer).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("at", "n_words")).alias("spans"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, minimizer: int = MINIMIZER) -> DataFrame:
    """doc_id, n_words, n_removed and text (kept words joined by one space), one row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [_cut(t, x) for t, x in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "text"],
            )

    rows = _keyed(docs).join(_spans_by_document(docs, window, minimizer), ["doc_id", "text_key"], "left")
    return rows.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, text string")


def without_repeats(docs: DataFrame, window: int = WINDOW, minimizer: int = MINIMIZER) -> DataFrame:
    """``docs`` with repeated passages cut from its texts, columns as they came.

    Texts that lose nothing stay as they are, white space included. ``n_chars``,
    where there is one, is counted anew. Rows that lose every word go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [_cut(t, x)[2] for t, x in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary()).cast(pa.string())], names=["row", "cut"])

    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.hash(F.col("text").cast("string")).cast("long").alias("text_key")).alias("key")
    spans = _spans_by_document(docs, window, minimizer)
    whole = docs.select(F.struct("*").alias("row"), key).select("row", "key.doc_id", "key.text_key")
    rows = whole.join(spans, ["doc_id", "text_key"], "left").select("row", F.col("row.text").cast("string").alias("text"), "spans")
    kind = rows.select("row").schema
    changed = rows.filter("spans is not null").mapInArrow(run, kind.add("cut", "string")).filter("cut <> ''")
    fresh = {"text": F.col("cut").alias("text"), "n_chars": F.length("cut").cast(dict(docs.dtypes).get("n_chars", "long")).alias("n_chars")}
    return rows.filter("spans is null").select("row.*").unionByName(changed.select(*[fresh.get(c, F.col("row").getField(c).alias(c)) for c in docs.columns]))
