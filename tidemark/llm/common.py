"""Shared helpers: durable intermediates, text columns, word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.durable import durable, shared_dir

__all__ = ["SPACE", "Rolling", "WordHash", "durable", "mixed", "shared_dir", "slices", "stored", "table", "words_of"]

#: The ASCII white space that separates words.
SPACE = " \t\n\x0b\f\r"


def stored(df: DataFrame) -> DataFrame:
    """As ``durable``, but columnar and compressed: for wide or large tables."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches a few rows at a time, so that a worker holds few texts twice; what they took is given back at the end."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    pa.default_memory_pool().release_unused()


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null and blank give an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+"))


class WordHash(dict):
    """Memo of 64-bit word hashes; emptied when it outgrows ``limit`` entries."""

    def __init__(self, seed: int = 0, limit: int = 500_000):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes of every run of ``width`` items, modulo 2**64.

    The multiplier is odd, so its powers can be divided out of prefix sums.
    """

    def __init__(self, multiplier: int):
        self.a = multiplier | 1
        self.inverse = pow(self.a, -1, 1 << 64)
        self.powers = np.ones(1, np.uint64)
        self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 2 * len(self.powers))
            ups = np.full(n, self.a, np.uint64)
            downs = np.full(n, self.inverse, np.uint64)
            ups[0] = downs[0] = 1
            self.powers, self.inverses = np.multiply.accumulate(ups), np.multiply.accumulate(downs)

    def prefix(self, items: np.ndarray) -> np.ndarray:
        self._grow(len(items) + 1)
        out = np.zeros(len(items) + 1, np.uint64)
        np.cumsum(items * self.powers[: len(items)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of each ``items[start:stop]``; equal sequences get equal hashes wherever they stand."""
        self._grow(len(prefix))
        return mixed((prefix[stop] - prefix[start]) * self.inverses[start] + (stop - start).astype(np.uint64))

    def windows(self, items: np.ndarray, width: int) -> np.ndarray:
        if len(items) < width:
            return np.zeros(0, np.uint64)
        p = self.prefix(items)
        start = np.arange(len(items) - width + 1)
        return self.spans(p, start, start + width)
