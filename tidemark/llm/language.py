"""Language identification by language-bitmask n-gram filters.

A filter maps each character n-gram, through a few hashes, to slots that hold
one bit for each language (bit-sliced Bloom filters: one lookup answers for all
languages). The AND of an n-gram's slots gives the languages that have it. A
text is scored by each language's count of n-grams, corrected for the false
positives that its share of set slots predicts; the highest count decides and
the alphabet breaks ties.

Learning counts n-grams over all learning texts. An n-gram is of a language if
it makes up ``MIN_SHARE`` of its n-grams and ``MIN_RATIO`` of the share that it
has where it is commonest, so the model has at most ``1 / MIN_SHARE`` n-grams a
language and is the same size for any corpus. Where so many languages would
make filters of more than ``MODEL_BYTES``, the share rises until they fit.

Null texts and texts without letters are ``und`` with score 0. Texts with
letters none of whose n-grams are known get the commonest language, score 0.
Rows without doc_id are never learned from. Without learning rows all is
``und``. Repeated rows count as often as they stand.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

MIN_SHARE, MIN_RATIO, HASHES, SLOTS_PER_GRAM = 1e-5, 0.25, 3, 12
SIZES = (2, 3)
UNKNOWN = "und"
#: Bytes of the filters at most: what is broadcast.
MODEL_BYTES = 1 << 27


def least_share(n_langs: int) -> float:
    """The share that an n-gram needs in its language: at most ``1 / share`` have it, so all fit in MODEL_BYTES."""
    planes = max(1, -(-n_langs // 64))
    # Slots are rounded up to a power of two.
    return max(MIN_SHARE, n_langs * 2 * 8 * planes * SLOTS_PER_GRAM / MODEL_BYTES)


def letters(token: str) -> list[str]:
    """Runs of letters in a token."""
    return [token] if token.isalpha() else "".join(c if c.isalpha() else " " for c in token).split()


def grams(token: str) -> list[str]:
    """Character n-grams of a token's runs of letters, edges marked by a space."""
    out = []
    for run in letters(token):
        marked = f" {run} "
        for n in SIZES:
            out += [marked[i : i + n] for i in range(len(marked) - n + 1)]
    return out


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of ``docs`` (lang, text); each task sums its own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, tokens in held.items():
                found: Counter = Counter()
                for token, n in tokens.items():
                    for g in grams(token):
                        found[g] += n
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(list(found)), pa.array(list(found.values()), pa.int64())], names=["lang", "gram", "n"])
            held.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.setdefault(lang, Counter()).update(text.lower().split())
            if sum(map(len, held.values())) > 300_000:
                yield from flush()
        yield from flush()

    rows = docs.select("lang", "text").filter("lang is not null and text is not null")
    return rows.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """``slots`` holds 64 languages to a plane; ``rates`` are false-positive rates."""

    langs: list[str]
    slots: np.ndarray
    rates: np.ndarray
    commonest: int

    @classmethod
    def build(cls, rows: list[tuple[str, str]], sizes: dict[str, int]) -> "Model":
        langs = sorted(sizes)
        planes = max(1, -(-len(langs) // 64))
        distinct = len({g for _, g in rows})
        m = 1 << max(10, (SLOTS_PER_GRAM * max(1, distinct) - 1).bit_length())
        slots = np.zeros((m, planes), np.uint64)
        at = {x: i for i, x in enumerate(langs)}
        for lang, gram in rows:
            i = at[lang]
            slots[_places(gram, m), i // 64] |= np.uint64(1 << (i % 64))
        share = np.array([float(((slots[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(langs))])
        return cls(langs, slots, share**HASHES, max(range(len(langs)), key=lambda i: (sizes[langs[i]], -i)) if langs else 0)

    def hits(self, found: list[str]) -> np.ndarray:
        """A row for each n-gram: 1 for each language that has it, and a last 1 that counts it."""
        out = np.ones((len(found), len(self.langs) + 1), np.int32)
        if found and self.langs:
            places = np.array([_places(g, len(self.slots)) for g in found])
            masks = np.bitwise_and.reduce(self.slots[places], axis=1)
            bits = (masks[:, :, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
            out[:, :-1] = bits.reshape(len(found), -1)[:, : len(self.langs)]
        return out

    def decide(self, sums: np.ndarray) -> tuple[str, float]:
        n = int(sums[-1])
        if not n or not self.langs:
            return UNKNOWN, 0.0
        counts = np.clip((sums[:-1] - n * self.rates) / (1 - self.rates), 0, n)
        best = int(counts.argmax())
        if counts[best] <= 0:
            return self.langs[self.commonest], 0.0
        return self.langs[best], float(counts[best] / counts.sum())


def _places(gram: str, m: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(gram.encode("utf-8", "surrogatepass"))
    a, b = h & 0xFFFFFFFFFFFFFFFF, h >> 64 | 1
    return [(a + i * b) % m for i in range(HASHES)]


def learn(docs: DataFrame) -> Model:
    """A model from all rows of ``docs`` (lang, text). The driver gets at most ``1 / least_share`` rows a language."""
    counted = durable(count_grams(docs))
    sizes = {r.lang: r.n for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counted.join(totals, "lang").withColumn("share", F.col("n") / F.col("total")).filter(F.col("share") >= least_share(len(sizes)))
    most = shares.groupBy("gram").agg(F.max("share").alias("most"))
    rows = shares.join(most, "gram").filter(F.col("share") >= MIN_RATIO * F.col("most")).select("lang", "gram").collect()
    return Model.build([(r.lang, r.gram) for r in rows], sizes)


class Scorer:
    """Sums of hits for texts; memos of n-grams and tokens are emptied beyond ``limit`` entries."""

    def __init__(self, model: Model, limit: int):
        self.model, self.limit = model, limit
        self._empty()

    def _empty(self) -> None:
        width = len(self.model.langs) + 1
        self.grams, self.tokens = {}, {}
        self.of_gram, self.of_token = np.zeros((0, width), np.int32), np.zeros((0, width), np.int32)

    def sums(self, texts: list[list[str]]) -> list[np.ndarray]:
        if max(len(self.tokens), len(self.grams)) > self.limit:
            self._empty()
        new = list(set().union(*texts).difference(self.tokens))
        if new:
            lists = [grams(w) for w in new]
            flat = [g for x in lists for g in x]
            fresh = list(set(flat).difference(self.grams))
            self.grams.update(zip(fresh, range(len(self.grams), len(self.grams) + len(fresh))))
            self.of_gram = np.concatenate([self.of_gram, self.model.hits(fresh)])
            rows = self.of_gram[np.fromiter(map(self.grams.__getitem__, flat), np.int64, len(flat))]
            ends = np.cumsum([0] + [len(x) for x in lists])
            total = np.concatenate([np.zeros((1, rows.shape[1]), np.int64), np.cumsum(rows, axis=0, dtype=np.int64)])
            self.tokens.update(zip(new, range(len(self.tokens), len(self.tokens) + len(new))))
            self.of_token = np.concatenate([self.of_token, (total[ends[1:]] - total[ends[:-1]]).astype(np.int32)])
        return [self.of_token[np.fromiter(map(self.tokens.__getitem__, ws), np.int64, len(ws))].sum(axis=0, dtype=np.int64) for ws in texts]


#: The scorer of the last model in this Python worker.
_SCORERS: dict[str, Scorer] = {}


def scorer(key: str, model: Model, limit: int) -> Scorer:
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(model, limit)
    return _SCORERS[key]


def predict(docs: DataFrame, model: Model, memo_bytes: int = 1 << 23) -> DataFrame:
    """doc_id, lang_pred, score, from whole texts alone, one row for each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex
    limit = max(1000, memo_bytes // (4 * (len(model.langs) + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from . import language

        found = language.scorer(key, shared.value, limit)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sums = found.sums([(t or "").lower().split() for t in part.column(1).to_pylist()])
                rows = [found.model.decide(x) for x in sums]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
