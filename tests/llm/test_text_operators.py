"""Brute-force comparisons and edge cases of the operators on documents."""

import collections
import hashlib
import random
import re
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import language, licenses, minhash, mixing, packing, quality, substring, token_files
from tidemark.llm.tokenize import Encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")


def words(rng, n, vocabulary=3000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, nulls, blanks, repeated rows and a long text."""
    rng = random.Random(5)
    base, passage = words(rng, 120), words(rng, 70)
    near = base[:]
    near[60] = "changed"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (4, None), (5, ""), (6, " \n\t "), (7, "one two three"), (8, "one  two\nthree"), (9, "ONE two three")]
    rows += [(i, " ".join(words(rng, 40) + passage + words(rng, 40))) for i in range(10, 16)]
    rows += [(16, " ".join(words(rng, 5000))), (17, "x " * 300), (18, "x " * 301), (19, "a\n\nb <|endoftext|> É été's 12 12"), (20, "same words " * 30), (20, "same words " * 30), (None, " ".join(base))]
    return [(i, t, "en" if i and i % 2 else None, "hot" if i and i > 9 else None, len(t or "")) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def whole_ids(name, text):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    texts = ["", " ", "  a  b ", "a\n\nb c\n", "a \n b", "don't I'll 123 x1 <|endoftext|> y", "\ttab\x0bx\x1cy\x85z", "İstanbul ǅ ﬁ é é 한글", "ΣΑΣ Σ", " lead", "trail ", "x\r\ny", "日本語", "a​b", "a　b", None]
    encoder = Encoder(public_tokenizers.path(name), limit=3)
    for _ in range(3):
        got = encoder.encode(texts)
        assert got == [np.array(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_packing_places_each_id_once(docs, corpus):
    rows = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert all(r.length == len(r.ids) // 4 for r in rows)
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for doc_id, text in {(r[0], r[1]) for r in corpus if r[0] not in (20, None)}:
        ids = whole_ids("word_bpe_49k.json", text)
        own = sorted(pieces[doc_id], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in own) == np.array(ids, "<u4").tobytes()
        assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own])[:-1])
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
    for s in by_sequence.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == list(np.cumsum([0] + [r.length for r in s])[:-1])
        total = sum(r.length for r in s)
        assert total <= 4096 and total & (total - 1) == 0 and total == s[0].sequence_tokens


def test_packer_is_exact_for_random_lengths():
    rng = random.Random(1)
    for trial in range(20):
        lengths = [rng.choice([1, 5, 100, 700, 2000, 4095, 4096, 4097, 9000]) + rng.randrange(3) for _ in range(rng.randrange(60))]
        packer, seen = packing.TierPacker(pool_tokens=20_000), collections.defaultdict(list)
        made = [x for i, n in enumerate(lengths) for x in packer.add(i, n)] + list(packer.finish())
        for size, pieces in made:
            assert sum(p[2] for p in pieces) == size
            for doc, at, n in pieces:
                seen[doc].append((at, n))
        for i, n in enumerate(lengths):
            assert sum(x[1] for x in seen[i]) == n and [x[0] for x in sorted(seen[i])] == list(np.cumsum([0] + [x[1] for x in sorted(seen[i])])[:-1])


def test_token_files_round_trip(spark, docs, corpus, tmp_path):
    path = f"file://{tmp_path}/files"
    token_files.write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"), segment_tokens=500)
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    expected = sorted(((i, t or "") for i, t, *_ in corpus), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    at = 0
    for r, (doc_id, text) in zip(got, expected, strict=True):
        ids = whole_ids("byte_bpe_50k.json", text)
        assert (r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) == (doc_id, at, len(ids), crc(ids))
        at += len(ids)


def test_blocks_decode_alone():
    rng = np.random.default_rng(3)
    for ids in (rng.integers(0, 50000, 1000, np.uint32), np.full(300, 7, np.uint32), np.array([2**32 - 1, 0, 5], np.uint32), np.zeros(0, np.uint32)):
        seg = token_files.Segment(token_files.encode_segment([1], [len(ids)], ids))
        assert (seg.ids() == ids).all()
        for k in range(seg.n_blocks):
            assert (seg.block(k) == ids[128 * k : 128 * (k + 1)]).all()


def brute_quality(text):
    w = WORD.findall(text or "")
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(tri)
    covered = {i + k for i, t in enumerate(tri) if n[t] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(docs, corpus):
    rows = quality.ledger(docs).collect()
    expected = collections.Counter((i, *brute_quality(t)) for i, t, *_ in corpus)
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == expected


def test_quality_policies(spark, docs, empty):
    rows = quality.ledger(docs)
    table = {(r.policy, r.rule): r for r in quality.ablations(rows).collect()}
    failed = [r.failed_bits for r in rows.collect()]
    for (policy, rule), r in table.items():
        bit = 1 << next(x.bit for x in quality.RULES if x.name == rule)
        mask = quality.POLICIES[policy]
        assert r.n_failed == sum(bool(f & bit) for f in failed) and r.n_only == sum(f & mask == bit for f in failed)
    assert quality.ledger(empty).count() == 0 and quality.filtered(empty).columns == empty.columns
    clash = docs.selectExpr("*", "'mine' as n_words", "1 as row")
    kept = quality.filtered(clash)
    assert kept.columns == clash.columns and {r.n_words for r in kept.collect()} == {"mine"}


def brute_near(corpus):
    sets = {}
    for i, t, *_ in corpus:
        if i is not None:
            w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates(docs, corpus):
    expected = brute_near(corpus)
    for r in minhash.near_duplicates(docs).collect():
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*expected[r.doc_id], expected[r.doc_id][1] == r.doc_id)


def test_near_duplicates_across_the_bound(spark):
    """Copies with ever more edits lie on both sides of 0.75, and only exact links count."""
    rng = random.Random(9)
    base = words(rng, 150, 10**6)
    rows = []
    for i in range(90):
        w = base[:]
        for k in rng.sample(range(150), i % 15):
            w[k] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), None, None, 0))
    expected = brute_near(rows)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: c for i, (_, c) in expected.items()}


def test_near_duplicates_empty(empty, docs):
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.one_of_each(docs.selectExpr("*", "'x' as rep", "2 as row"))
    assert kept.filter("doc_id = 20").count() == 1 and "rep" in kept.columns


def brute_repeats(corpus):
    first = {}
    docs = [(i, WORD.findall(t or "")) for i, t, *_ in corpus]
    for i, w in docs:
        if i is not None:
            for k in range(len(w) - 49):
                key = tuple(w[k : k + 50])
                first[key] = min(first.get(key, i), i)
    out = collections.Counter()
    for i, w in docs:
        stay = [True] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                stay[k : k + 50] = [False] * 50
        kept = [x for x, s in zip(w, stay) if s]
        out[(i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())] += 1
    return out


def test_repeated_passages(docs, corpus, empty):
    got = substring.remove_repeats(docs).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in got) == brute_repeats(corpus)
    spans = substring.repeated_spans(docs).collect()
    text = {i: WORD.findall(t or "") for i, t, *_ in corpus}
    for s in spans:
        assert s.source_id < s.doc_id and text[s.doc_id][s.at : s.at + s.n_words] == text[s.source_id][s.source_at : s.source_at + s.n_words]
    assert substring.remove_repeats(empty).count() == 0
    left = substring.without_repeats(docs.selectExpr("*", "1 as cut", "2 as spans"))
    assert left.columns == [*docs.columns, "cut", "spans"] and left.filter("doc_id = 3").count() == 0


def test_repeated_passages_inside_their_source(spark):
    """A path that stands twice in its source document loses its windows at each place."""
    rng = random.Random(21)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for k, size in enumerate((60, 120)):
        x, c = fresh(size), fresh(45)
        rows += [(10 * k + 1, fresh(40) + x + fresh(40)), (10 * k + 2, c + x + fresh(40) + c + x + fresh(40)), (10 * k + 3, c + x + fresh(9))]
    rows += [(30, ["y"] + ["x"] * 50), (31, ["x"] * 300), (31, ["z"] + ["x"] * 70), (31, ["z"] + ["x"] * 70)]
    rows = [(i, " ".join(w), None, None, 0) for i, w in rows]
    got = substring.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    expected = brute_repeats(rows)
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in got) == expected
    removed = collections.Counter((k[0], k[2]) for k in expected)
    assert removed[2, 120] == removed[12, 240] == removed[31, 300] == 1


def test_mixing(docs, empty, spark):
    rows = mixing.mix(docs.selectExpr("*", "7 as copy_of"), {"hot": 3.0, None: 1.0}).collect()
    assert {r.copy for r in rows} >= {1} and all(1 <= r.copy <= r.n_copies for r in rows)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_rows(docs).columns == docs.columns
    many = spark.range(20000).selectExpr("id as doc_id", "'text' as text", "if(id % 4 = 0, 'a', 'b') as source")
    counts = {r.source: r.n for r in mixing.mix(many, {"a": 0.5, "b": 0.5}).groupBy("source").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert abs(counts["a"] - 10000) < 400 and abs(counts["b"] - 10000) < 400


def test_licenses(spark, empty):
    mit = dict(licenses.CATALOGUE[:1])["MIT"]
    rows = [(1, "Copyright (c) 2020 Someone\n" + mit.upper().replace("NONINFRINGEMENT", "NON-INFRINGEMENT"), "", "", 0), (2, "text\nreleased under the MIT Licence!!\nmore", "", "", 0), (3, None, "", "", 0), (4, "Released under the MIT License. And more", "", "", 0), (None, "Released under the MIT License.", "", "", 0), (5, "Copyright MIT", "", "", 0)]
    got = {r.doc_id: (r.licenses, r.n_license_lines, r.whole_text) for r in licenses.licensed(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: ("MIT", 0, True), 2: ("MIT", 1, False), 3: ("", 0, False), 4: ("", 0, False), None: ("", 0, False), 5: ("", 0, False)}
    assert licenses.licensed(empty).count() == 0


def test_license_files(spark):
    """Files as they come: titled, wrapped anew at any width, with holders, as comments; prose about copyright stays."""
    full = {}
    for name, text in licenses.CATALOGUE:
        if len(text) > 500:
            full.setdefault(name, text)
    assert set(full) == {"MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-3.0", "MPL-2.0"}
    wrap = lambda text, n: "\n\n".join(textwrap.fill(" ".join(p.split()), n, break_long_words=False, break_on_hyphens=False) for p in re.split(r"\n\s*\n", text))
    titles = {"MIT": ["MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "ISC License (ISC)"], "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License']}
    bodies = []
    for name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause"):
        for n in (40, 60, 66, 72, 79):
            bodies += [(name, f"{title}\n\n{holder}\n\n{wrap(full[name], n)}\n") for title in titles[name] for holder in ("Copyright (c) 2020 Some One\nAll rights reserved.", "Copyright Some One and others\nCopyright Another")]
        bodies += [(name, "/*\n" + "\n".join(f" * {x}" for x in ("Copyright Some One\n\n" + wrap(full[name], 70)).split("\n")) + "\n */")]
    bodies += [(name, full[name]) for name in ("Apache-2.0", "GPL-3.0", "MPL-2.0")]
    bodies += [(name, full[name].partition("END OF TERMS")[0]) for name in ("Apache-2.0", "GPL-3.0")]
    bodies += [("Apache-2.0", full["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2020 Some One"))]
    bodies += [("", full["MIT"] + "\nOnly for good."), ("", "MIT License"), ("", "Copyright notices of " + full["ISC"])]
    rows = [(i, text, "", "", 0) for i, (_, text) in enumerate(bodies)]
    got = {r.doc_id: (r.licenses, r.whole_text) for r in licenses.licensed(spark.createDataFrame(rows, SCHEMA)).select("doc_id", F.col("licenses"), "whole_text").collect()}
    wrong = [(i, name, got[i], text[:80]) for i, (name, text) in enumerate(bodies) if got[i][1] != bool(name) or name not in got[i][0].split(",")]
    assert not wrong, wrong


def test_language(spark, docs, empty):
    train = spark.createDataFrame([("en", "the cat and the dog with this that"), ("de", "der hund und die katze mit nicht schön"), ("fr", "le chat et la chienne avec été où")] * 20, "lang string, text string")
    model = language.learn(train)
    texts = spark.createDataFrame([(1, "the dog that"), (2, "die Katze und der Hund"), (3, "la chienne été"), (4, None), (5, "123 !!"), (6, "日本語")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(texts, model).collect()}
    assert [got[i][0] for i in (1, 2, 3)] == ["en", "de", "fr"] and got[4] == got[5] == ("und", 0.0) and got[6][1] == 0.0
    assert all(0 <= s <= 1 for _, s in got.values())
    nothing = language.learn(empty)
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"} and language.predict(empty, model).count() == 0
