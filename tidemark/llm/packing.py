"""Hierarchical multi-length packing of token sequences.

Documents are cut into full windows of the longest tier; what remains of each
is routed to the shortest tier that holds it. Tiers are packed longest first,
gaps of long windows are filled from shorter tiers, best fit first, and the
last gap of a window is closed by cutting the next document there. A partition's
final rest is laid out in windows of falling powers of two, so nothing is
padded; those below the shortest tier count to it. Packing is a map over
partitions: no shuffle, and memory bounded by the longest document and
``pool_tokens``, as the pool holds the bytes of rests alone.

Step groups are balanced over all partitions: sequences of a tier stand in one
line, and the line is cut into groups of ``step_tokens`` tokens on average, each
within one sequence of the same size. Only a count for each partition and tier
crosses partitions.

Null texts count as empty (the end id alone). Rows with equal or null doc_id
are packed as they come, each by itself. Further columns are left out. An empty
table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .tokenize import encoder

SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, "
    "sequence_id long, offset long, tier int, sequence_tokens int, step_group long"
)
TIERS = (512, 1024, 2048, 4096)
PIECES = SCHEMA.replace("step_group long", "part int, before long")
#: Tokens that each step group holds, whatever its tier, on average.
STEP_TOKENS = 1 << 18
POOL_TOKENS = 1 << 20


class Rest:
    """What full windows leave of a document's ids: its bytes from ``first`` on."""

    __slots__ = ("doc_id", "raw", "first", "total")

    def __init__(self, doc_id: int | None, raw: bytes, first: int, total: int):
        self.doc_id, self.raw, self.first, self.total = doc_id, raw, first, total

    def cut(self, at: int, length: int) -> bytes:
        return self.raw[4 * (at - self.first) : 4 * (at - self.first + length)]

    def tail(self, at: int) -> "Rest":
        return Rest(self.doc_id, self.cut(at, self.total - at), at, self.total) if at > self.first else self


class TierPacker:
    """Packs documents given by ``add`` and yields lists of pieces, a list for each sequence.

    A piece is (document, start, length); a document is any object that the
    caller keeps. The pool keeps ``document.tail(start)`` where there is one.
    ``tiers`` are powers of two in rising order.
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS, pool_tokens: int = POOL_TOKENS):
        if list(tiers) != sorted(set(tiers)) or any(t < 1 or t & (t - 1) for t in tiers):
            raise ValueError("tiers must be rising powers of two")
        self.tiers, self.longest, self.pool_tokens = tiers, tiers[-1], pool_tokens
        self.pool: list[tuple] = []
        self.held = 0

    def add(self, doc, length: int) -> Iterator[tuple[int, list[tuple]]]:
        at = 0
        while length - at >= self.longest:
            yield self.longest, [(doc, at, self.longest)]
            at += self.longest
        if at < length:
            if at and hasattr(doc, "tail"):
                doc = doc.tail(at)
            self.pool.append((doc, at, length - at))
            self.held += length - at
            if self.held >= self.pool_tokens:
                yield from self._pack()

    def _tier(self, length: int) -> int:
        return next(i for i, t in enumerate(self.tiers) if length <= t)

    def _pack(self) -> Iterator[tuple[int, list[tuple]]]:
        # Per tier, pieces by rising length; the serial number makes the order total.
        shelves: list[list[tuple]] = [[] for _ in self.tiers]
        serial = 0

        def shelve(piece: tuple) -> None:
            nonlocal serial
            insort(shelves[self._tier(piece[2])], (piece[2], serial, piece))
            serial += 1

        for piece in self.pool:
            shelve(piece)
        self.pool, self.held = [], 0
        for level in range(len(self.tiers) - 1, -1, -1):
            size = self.tiers[level]
            while shelves[level]:
                window, gap = [shelves[level].pop()[2]], 0
                gap = size - window[0][2]
                while gap:
                    piece = self._fitting(shelves, level, gap)
                    if piece is None:
                        piece = next((s.pop(0)[2] for s in shelves[: level + 1] if s), None)
                        if piece is None:
                            break
                        doc, at, length = piece
                        shelve((doc, at + gap, length - gap))
                        piece = (doc, at, gap)
                    window.append(piece)
                    gap -= piece[2]
                if gap:
                    self.pool += window
                    self.held += size - gap
                else:
                    yield size, window

    @staticmethod
    def _fitting(shelves: list[list[tuple]], level: int, gap: int) -> tuple | None:
        """The longest piece of at most ``gap`` tokens from this tier or a shorter one."""
        for i in range(level, -1, -1):
            if at := bisect_right(shelves[i], (gap, float("inf"))):
                return shelves[i].pop(at - 1)[2]
        return None

    def finish(self) -> Iterator[tuple[int, list[tuple]]]:
        """The rest, in windows of falling powers of two."""
        yield from self._pack()
        rest = list(reversed(self.pool))
        while self.held:
            size = min(self.longest, 1 << (self.held.bit_length() - 1))
            window, gap = [], size
            while gap:
                doc, at, length = rest.pop()
                if length > gap:
                    rest.append((doc, at + gap, length - gap))
                    length = gap
                window.append((doc, at, length))
                gap -= length
            self.held -= size
            yield size, window
        self.pool = []


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """Pieces of all documents (doc_id, text), each token id in exactly one.

    ``ids`` holds little-endian unsigned 32-bit ids. The pieces are written to
    the shared folder, so texts are encoded once; then step groups are dealt.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(tokenizer_path), TierPacker(tiers, pool_tokens)
        part = TaskContext.get().partitionId()
        base = part << 32
        before: dict[int, int] = {}
        rows: list[tuple] = []
        end = int(end_id).to_bytes(4, "little")
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("sequence_tokens", pa.int32()), ("part", pa.int32()), ("before", pa.int64())])
        serial = 0

        def place(sequences) -> None:
            nonlocal serial
            for size, pieces in sequences:
                tier = next(t for t in tiers if size <= t)
                offset = 0
                for doc, at, length in pieces:
                    rows.append((doc.doc_id, at, length, doc.cut(at, length), doc.total, base | serial, offset, tier, size, part, before.get(tier, 0)))
                    offset += length
                before[tier] = before.get(tier, 0) + size
                serial += 1

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows.clear()
            return out

        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                for doc_id, raw in zip(some.column(0).to_pylist(), enc.encode(some.column(1).to_pylist())):
                    raw += end
                    place(packer.add(Rest(doc_id, raw, 0, len(raw) // 4), len(raw) // 4))
                if len(rows) >= 2000:
                    yield batch()
        place(packer.finish())
        if rows:
            yield batch()

    pieces = stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES))
    # A row for each partition and tier: as many as tasks that packed, times the tiers.
    counts = pieces.filter("offset = 0").groupBy("tier", "part").agg(F.sum("sequence_tokens").alias("tokens"))
    by_tier = Window.partitionBy("tier")
    ahead = F.coalesce(F.sum("tokens").over(by_tier.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    line = counts.select("tier", "part", ahead.alias("ahead"), F.sum("tokens").over(by_tier).alias("whole"))
    groups = F.greatest(F.round(F.col("whole") / step_tokens), F.lit(1.0)).cast("long")
    group = F.expr("tier * bigint(1099511627776)") + F.floor((F.col("ahead") + F.col("before")) * groups / F.col("whole")).cast("long")
    return pieces.join(F.broadcast(line), ["tier", "part"]).select(*[c.split()[0] for c in SCHEMA.split(", ")[:-1]], group.alias("step_group"))
