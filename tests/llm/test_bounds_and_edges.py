"""Bounds on memory, recall and accuracy against plain versions, and odd inputs of the operators."""

import collections
import math
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_text_operators import SCHEMA, brute_near, brute_quality, brute_repeats, whole_ids, words
from tidemark.llm import chat, language, licenses, minhash, mixing, packing, quality, substring, token_files
from tidemark.llm.tokenize import MEMO_CHARS, Encoder

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def sample():
    import pyarrow.parquet as pq

    return [tuple(r.values()) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]


# ---- packing


def test_pool_keeps_rests_alone():
    packer, raw = packing.TierPacker(), b"\0" * (4 * 4097)
    for i in range(5000):
        for _ in packer.add(packing.Rest(i, raw, 0, 4097), 4097):
            pass
    assert packer.held == 5000 and sum(len(doc.raw) for doc, *_ in packer.pool) == 4 * packer.held


def test_step_groups_are_balanced_over_partitions(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(words(rng, rng.choice([20, 150, 400, 900, 1500, 5000]))), None, None, 0) for i in range(150)]
    made = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(6), WORDS, step_tokens=20_000).collect()
    sequences = {r.sequence_id: r for r in made}
    tokens, sizes = collections.Counter(), collections.defaultdict(set)
    for r in sequences.values():
        tokens[r.tier, r.step_group] += r.sequence_tokens
        sizes[r.tier].add(r.sequence_tokens)
    for tier in sizes:
        groups = [n for (t, _), n in tokens.items() if t == tier]
        assert len(groups) == max(1, round(sum(groups) / 20_000)) and max(groups) - min(groups) <= 2 * max(sizes[tier])
    assert sum(r.length for r in made) == sum(r.doc_tokens for r in {r.doc_id: r for r in made}.values())


def test_packing_odd_tables(spark):
    """Nothing, repeated ids and clashing columns."""
    assert packing.pack(spark.createDataFrame([], SCHEMA), WORDS).count() == 0
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (None, "c")], "doc_id long, text string").selectExpr("*", "1 as ids", "2 as tier", "'x' as part")
    got = collections.Counter((r.doc_id, bytes(r.ids)) for r in packing.pack(docs, WORDS).collect() if r.length == r.doc_tokens)
    pieces = collections.Counter()
    for r in packing.pack(docs, WORDS).collect():
        pieces[r.doc_id] += r.length
    expected = [(1, "a b"), (1, "a b"), (None, ""), (None, "c")]
    assert pieces == collections.Counter({k: sum(len(whole_ids("word_bpe_49k.json", t)) for i, t in expected if i == k) for k in (1, None)})
    assert set(got) <= {(i, np.array(whole_ids("word_bpe_49k.json", t), "<u4").tobytes()) for i, t in expected}


# ---- tokenizers


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_encoder_remembers_short_parts_only(path):
    rng = random.Random(1)
    encoder = Encoder(path, limit=1000)
    for _ in range(10):
        texts = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(200)) for _ in range(50)] + [f"w{rng.random()} x{rng.random()} " + "y" * 300 for _ in range(100)]
        got = encoder.encode(texts)
        assert got[::37] == [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts[::37]]
    held = [k for d in (encoder.memo, encoder.older, encoder.heads) for k in d]
    assert max(map(len, held)) <= MEMO_CHARS and len(held) <= 2 * (1000 + 300)


def test_token_files_odd_tables(spark, tmp_path):
    """Nothing; then a very long text, repeated and missing ids and clashing columns."""
    path = f"file://{tmp_path}/none"
    token_files.write_token_files(spark.createDataFrame([], SCHEMA), path, BYTES)
    assert token_files.read_token_files(spark, path).count() == 0
    rng = random.Random(2)
    rows = [(None, f"no id {i % 7} é") for i in range(60)] + [(5, "same")] * 40 + [(9, " ".join(words(rng, 60_000))), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "2 as shard")
    path = f"file://{tmp_path}/odd"
    token_files.write_token_files(docs.repartition(5), path, BYTES)
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    at = 0
    for r, (doc_id, text) in zip(got, sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])), strict=True):
        ids = whole_ids("byte_bpe_50k.json", text)
        assert (r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


# ---- mixing


def test_cumulative_is_poisson(spark):
    rates = spark.createDataFrame([("a", 0.3), ("b", 7.5), (None, 40.0), ("none", 0.0)], "source string, rate double")
    given = {r.source: r.rate for r in rates.collect()}
    made = mixing.cumulative(rates).collect()
    assert len(made) == 4
    for r in made:
        rate = given[r.source]
        total, expected = 0.0, []
        for k in range(len(r.cdf)):
            total += math.exp(-rate + (k * math.log(rate) if rate else 0) - math.lgamma(k + 1))
            expected.append(total)
        assert np.allclose(r.cdf, expected, atol=1e-12) and r.cdf[-1] > 1 - 1e-12


def test_mixing_odd_tables(spark, monkeypatch):
    """Clashing columns keep their values, a large rate its mean, and many sources mix as few do."""
    many = spark.range(3000).selectExpr("id as doc_id", "repeat('t', 10) as text", "if(id < 10, null, if(id % 3 = 0, 'a', 'b')) as source", "5 as copy", "'k' as shuffle_key", "1 as _row")
    mixed = mixing.mix(many, {None: 0.5, "a": 0.25, "b": 0.25})
    assert mixed.columns == [*many.columns, "copy_", "n_copies", "shuffle_key_"]
    rows = mixed.collect()
    assert {(r.copy, r.shuffle_key) for r in rows} == {(5, "k")} and [r.shuffle_key_ for r in rows] == sorted(r.shuffle_key_ for r in rows)
    counts = collections.Counter(r.source for r in rows)
    assert abs(counts[None] - 1500) < 5 * 1500**0.5 and abs(counts["a"] - 750) < 150
    monkeypatch.setattr(mixing, "BROADCAST_NUMBERS", 0)
    again = mixing.mix(many, {None: 0.5, "a": 0.25, "b": 0.25}).collect()
    assert again == rows


# ---- language


def test_model_fits_its_bound():
    for n in (1, 4, 64, 65, 300, 2000):
        planes = -(-n // 64)
        grams = int(n / language.least_share(n))
        slots = 1 << max(10, (language.SLOTS_PER_GRAM * grams - 1).bit_length())
        assert slots * 8 * planes <= language.MODEL_BYTES
    assert language.least_share(4) == language.MIN_SHARE


@needs_tables
def test_language_against_plain_sets(spark, sample):
    """The filters decide as the plain sets of n-grams they stand for, and what is held out is told apart."""
    fold = lambda i: zlib.crc32(str(i).encode()) % 3
    docs = spark.createDataFrame(sample, SCHEMA)
    model = language.learn(docs.filter((F.crc32(F.col("doc_id").cast("string")) % 3 != 1) & F.col("lang").isNotNull()))
    counts = collections.defaultdict(collections.Counter)
    for i, text, lang, *_ in sample:
        if fold(i) != 1 and lang is not None and text is not None:
            for token in text.lower().split():
                counts[lang].update(language.grams(token))
    share = {x: {g: n / c.total() for g, n in c.items()} for x, c in counts.items()}
    least = language.least_share(len(share))
    kept = {x: {g: s for g, s in c.items() if s >= least} for x, c in share.items()}
    most = collections.Counter()
    for c in kept.values():
        for g, s in c.items():
            most[g] = max(most[g], s)
    known = {x: {g for g, s in c.items() if s >= language.MIN_RATIO * most[g]} for x, c in kept.items()}
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    same, right, held = 0, 0, 0
    for i, text, lang, *_ in sample:
        found = [g for token in (text or "").lower().split() for g in language.grams(token)]
        if not found:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        hits = {x: sum(g in s for g in found) for x, s in known.items()}
        best = max(sorted(hits), key=hits.get)
        same += got[i].lang_pred == best and abs(got[i].score - hits[best] / max(1, sum(hits.values()))) < 0.05
        if fold(i) == 1 and lang is not None:
            held, right = held + 1, right + (got[i].lang_pred == lang)
    assert same >= 0.98 * sum(bool((t or "").strip()) for _, t, *_ in sample)
    assert held > 200 and right >= 0.97 * held


def test_language_odd_rows(spark):
    """Rows without or with equal ids each get a row; ties go to the first in the alphabet; a very long text is read whole."""
    train = spark.createDataFrame([("bb", "aaa aaa"), ("aa", "aaa aaa"), ("cc", "zzz zzz zzz")], "lang string, text string").selectExpr("*", "1 as gram", "2 as n")
    model = language.learn(train)
    rows = [(None, "aaa"), (1, "aaa"), (1, "aaa"), (2, "aaa " + "zzz " * 50_000), (3, "qqq")]
    got = sorted((r.doc_id or 0, r.lang_pred) for r in language.predict(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as score"), model).collect())
    assert got == [(0, "aa"), (1, "aa"), (1, "aa"), (2, "cc"), (3, "cc")]


# ---- near duplicates


@needs_tables
def test_near_duplicates_of_the_documents(spark, sample):
    expected = brute_near(sample)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(sample, SCHEMA)).collect()}
    wrong = [i for i in expected if got[i] != expected[i]]
    assert len(wrong) <= 0.001 * len(expected)


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    """A family of texts on both sides of the bound, dealt into many blocks that visit one another."""
    monkeypatch.setattr(minhash, "BLOCK_ITEMS", 700)
    rng = random.Random(13)
    base, rows = words(rng, 120, 10**6), []
    for i in range(120):
        w = base[:]
        for k in rng.sample(range(120), rng.choice([1, 3, 6, 8, 12])):
            w[k] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), None, None, 0))
    expected = brute_near(rows)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: c for i, (_, c) in expected.items()}


def test_long_texts(spark):
    """Whole texts, never prefixes: near copies, a repeated passage at the very end, measures."""
    rng = random.Random(17)
    long, passage = words(rng, 40_000, 10**6), words(rng, 60)
    near = long[:30_000] + ["x"] + long[30_001:]
    rows = [(1, " ".join(long + passage)), (2, " ".join(near + passage)), (3, " ".join(words(rng, 30_000, 10**6) + passage)), (None, " ".join(long))]
    rows = [(i, t, None, None, 0) for i, t in rows]
    docs = spark.createDataFrame(rows, SCHEMA)
    expected = brute_near(rows)
    for r in minhash.near_duplicates(docs).collect():
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == expected[r.doc_id]
    removed = {(k[0], k[1]): k[2] for k in brute_repeats(rows)}
    assert {(r.doc_id, r.n_words): r.n_removed for r in substring.remove_repeats(docs).collect()} == removed
    for r in quality.ledger(docs).collect():
        if r.doc_id == 3:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(rows[2][1])


# ---- licences and chats


def test_licenses_of_repeated_ids(spark):
    """Rows that share an id share what is found; each row is answered; clashing columns are left out."""
    docs = spark.createDataFrame([(1, "Released under the MIT License."), (1, "nothing"), (2, "nothing")], "doc_id long, text string").selectExpr("*", "1 as unit", "2 as body", "3 as license")
    got = sorted((r.doc_id, r.licenses, r.n_license_lines) for r in licenses.licensed(docs).collect())
    assert got == [(1, "MIT", 1), (1, "MIT", 1), (2, "", 0)]


def test_chat_odd_turns(spark):
    """A very long turn is whole in a window of its own; columns that clash with the operator's are left out."""
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "a" * 300_000), (1, 2, "user", "x")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as at", "2 as tokens", "'x' as piece")
    windows = chat.format_windows(frame)
    got = chat.read_windows(windows).first()
    assert got.n_turns == 3 and got.loss_text == "a" * 300_000 and windows.columns[:3] == ["conv_id", "window_id", "text"]


# ---- pipeline


def test_stages_on_odd_tables(spark, tmp_path):
    """No rows give no rows; rows without an id, with clashing columns, pass each stage by its rules."""
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    rng = random.Random(4)
    text = " ".join(words(rng, 80))
    rows = [(None, text, "en", "s", 1), (None, text, "en", "s", 1), (None, None, None, None, None), (3, text, "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as row", "2 as rep", "'x' as spans", "3 as copy")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert out.filter("doc_id is null and text is not null").count() >= (1 if name != "source mixing" else 0), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).filter("doc_id is null").count() >= 3
