"""Token files: ids in patched frame-of-reference blocks, in ascending doc_id order.

A file set is a Parquet folder of segments, each self-contained: ``payload``
holds a header, a table of documents, an index of block starts, packed bits
and exception lists. A block keeps 128 ids as differences from its minimum at
a width that 90 % of them fit; the others lie in its exception list.

Null texts are empty documents. Null doc_ids sort first. Rows that share a
doc_id stay separate documents in the order of their texts. Further columns
are left out. An empty table gives an empty file set.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokenize import encoder

BLOCK = 128
PERCENTILE = 90
SEGMENT_TOKENS = 1 << 17
_HEAD = struct.Struct("<4sHHQII")
_MAGIC, _VERSION = b"PFOR", 1
_SEGMENT = "shard int, seq int, start_in_shard long, n_docs int, n_tokens long, payload binary"


def encode_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> bytes:
    """One segment's bytes: documents of ``lengths`` ids each, their ids one after another."""
    n = len(ids)
    n_blocks = -(-n // block)
    grid = np.full(n_blocks * block, 0, np.uint32)
    grid[:n] = ids
    if n % block:
        grid[n:] = ids[n - n % block :].min()
    grid = grid.reshape(n_blocks, block)
    low = grid.min(axis=1) if n_blocks else np.zeros(0, np.uint32)
    diff = grid - low[:, None]
    need = np.zeros(diff.shape, np.uint8)  # bits that each difference takes
    for bit in range(32):
        need += (diff >> np.uint32(bit)) > 0
    rank = min(block - 1, -(-block * percentile // 100) - 1)
    width = np.partition(need, rank, axis=1)[:, rank] if n_blocks else np.zeros(0, np.uint8)
    patched = need > width[:, None]
    n_patched = patched.sum(axis=1).astype(np.uint16)
    where = np.nonzero(patched)
    positions, values = where[1].astype(np.uint16), diff[where].astype("<u4")
    kept = np.where(patched, np.uint32(0), diff)
    size = width.astype(np.int64) * block // 8
    start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    packed = np.zeros(int(start[-1]), np.uint8)
    for w in np.unique(width[width > 0]):
        at = np.flatnonzero(width == w)
        bits = ((kept[at][:, :, None] >> np.arange(w, dtype=np.uint32)) & 1).astype(np.uint8)
        packed[start[at][:, None] + np.arange(int(w) * block // 8)] = np.packbits(bits.reshape(len(at), -1), axis=1, bitorder="little")
    known = np.array([x is not None for x in doc_ids], np.uint8)
    return b"".join([
        _HEAD.pack(_MAGIC, _VERSION, block, n, len(doc_ids), n_blocks),
        known.tobytes(), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array(lengths, "<u4").tobytes(),
        low.astype("<u4").tobytes(), width.astype(np.uint8).tobytes(), n_patched.astype("<u2").tobytes(), start[:-1].astype("<u8").tobytes(),
        positions.astype("<u2").tobytes(), values.tobytes(), packed.tobytes(),
    ])


class Segment:
    """Reads one segment; ``ids`` decodes all blocks, ``block`` one of them through the index."""

    def __init__(self, payload: bytes):
        magic, version, self.size, self.n, n_docs, self.n_blocks = _HEAD.unpack_from(payload)
        if magic != _MAGIC or version != _VERSION:
            raise ValueError("not a token segment of a known version")
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, count, at)
            at += out.nbytes
            return out

        known = take("u1", n_docs)
        self.doc_ids = [int(x) if k else None for x, k in zip(take("<i8", n_docs), known)]
        self.lengths = take("<u4", n_docs)
        self.low, self.width = take("<u4", self.n_blocks), take("u1", self.n_blocks)
        n_patched = take("<u2", self.n_blocks)
        self.start = take("<u8", self.n_blocks)
        self.patches = np.concatenate([[0], np.cumsum(n_patched, dtype=np.int64)])
        self.positions, self.values = take("<u2", int(self.patches[-1])), take("<u4", int(self.patches[-1]))
        self.packed = np.frombuffer(payload, "u1", offset=at)

    def _unpack(self, which: np.ndarray) -> np.ndarray:
        out = np.zeros((len(which), self.size), np.uint32)
        for w in np.unique(self.width[which]):
            if w:
                rows = np.flatnonzero(self.width[which] == w)
                raw = self.packed[self.start[which[rows]].astype(np.int64)[:, None] + np.arange(int(w) * self.size // 8)]
                bits = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(rows), self.size, int(w))
                out[rows] = bits.astype(np.uint32) @ (np.uint32(1) << np.arange(w, dtype=np.uint32))
        return out

    def block(self, k: int) -> np.ndarray:
        out = self._unpack(np.array([k]))[0]
        a, b = self.patches[k], self.patches[k + 1]
        out[self.positions[a:b]] = self.values[a:b]
        return (out + self.low[k])[: self.n - k * self.size]

    def ids(self) -> np.ndarray:
        out = self._unpack(np.arange(self.n_blocks))
        owner = np.repeat(np.arange(self.n_blocks), np.diff(self.patches))
        out[owner, self.positions] = self.values
        return (out + self.low[:, None]).reshape(-1)[: self.n].astype("<u4")


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode all documents (doc_id, text) and write them to ``path``, which any Hadoop file system may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, end = encoder(tokenizer_path), TaskContext.get().partitionId(), int(end_id).to_bytes(4, "little")
        doc_ids, raws, held, seq, before = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, seq, before
            ids = np.frombuffer(b"".join(raws), "<u4")
            payload = encode_segment(doc_ids, [len(r) // 4 for r in raws], ids)
            row = [[shard], [seq], [before], [len(doc_ids)], [len(ids)], [payload]]
            out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["shard", "seq", "start_in_shard", "n_docs", "n_tokens", "payload"])
            seq, before, held = seq + 1, before + len(ids), 0
            doc_ids.clear()
            raws.clear()
            return out

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for doc_id, raw in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist())):
                    doc_ids.append(doc_id)
                    raws.append(raw + end)
                    held += len(raw) // 4 + 1
                    if held >= segment_tokens:
                        yield flush()
        if raws:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Rows that share an id, or have none, are dealt by the head of their text, which agrees with the order by text.
    rows.repartitionByRange("doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text").mapInArrow(run, _SEGMENT).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a file set: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian binary).

    The driver sees one total for each shard, never a row for each document or segment.
    """
    files = spark.read.schema(_SEGMENT).parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()
    starts, at = [], 0
    for row in sorted(totals):
        starts.append((row.shard, at))
        at += row.n
    base = spark.createDataFrame(starts, "shard int, shard_start long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seg = Segment(payload)
                raw, ends = seg.ids().tobytes(), np.cumsum(seg.lengths, dtype=np.int64)
                begins = ends - seg.lengths
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seg.doc_ids, pa.int64()), pa.array(start + begins), pa.array(seg.lengths.astype(np.int64)), pa.array([raw[4 * a : 4 * e] for a, e in zip(begins, ends)], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    # One short row for each shard, so the broadcast is bounded by the number of write tasks.
    placed = files.join(F.broadcast(base), "shard").select((F.col("shard_start") + F.col("start_in_shard")).alias("start"), "payload")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
