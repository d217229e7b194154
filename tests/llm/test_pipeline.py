"""The pipeline's stages against brute force, each on what the stage before it kept."""

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_text_operators import SCHEMA, brute_near, brute_quality, brute_repeats, words
from tidemark.llm import quality


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    base, passage = words(rng, 150), words(rng, 60)
    near = [*base[:70], "changed", *base[71:]]
    rows = [(i, " ".join(words(rng, 80 + i)), "en", f"s{i % 3}", 0) for i in range(20)]
    rows += [(30, " ".join(base), "en", "s0", 0), (31, " ".join(near), "en", "s0", 0), (32, " ".join(base), "en", "s1", 0)]
    rows += [(i, " ".join(words(rng, 30) + passage + words(rng, 30)), "en", "s2", 0) for i in (40, 41, 42)]
    rows += [(50, None, "en", "s0", 0), (51, "too short", "en", "s0", 0), (52, "same word " * 60, None, None, 0), (53, "# $ % " * 60, "en", "s1", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append(docs.collect())
    good = [r for r in rows if (m := brute_quality(r[1]))[0] >= 50 and 2 * m[4] <= m[0] and 10 * m[2] <= m[0]]
    assert Counter(r.doc_id for r in kept[0]) == Counter(r[0] for r in good) and quality.POLICIES["default-1"] & 1
    near_ids = brute_near(good)
    left = [r for r in good if near_ids[r[0]][1] == r[0]]
    assert Counter(r.doc_id for r in kept[1]) == Counter(r[0] for r in left)
    removed = {k[0]: k[2] for k in brute_repeats(left)}
    cut = {r.doc_id: r for r in kept[2]}
    for doc_id, text, *_ in left:
        assert len(text.split()) - len(cut[doc_id].text.split()) == removed[doc_id]
        assert cut[doc_id].text == text if not removed[doc_id] else cut[doc_id].n_chars == len(cut[doc_id].text)
    assert {r.doc_id for r in kept[3]} <= set(cut) and all(r.text == cut[r.doc_id].text for r in kept[3])
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = defaultdict(int)
    for r in kept[4]:
        got[r.doc_id] += r.length
        ids = tokenizer.encode(cut[r.doc_id].text, add_special_tokens=False).ids + [2]
        assert bytes(r.ids) == np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
    copies = Counter(r.doc_id for r in kept[3])
    for doc_id, n in copies.items():
        assert got[doc_id] == n * (len(tokenizer.encode(cut[doc_id].text, add_special_tokens=False).ids) + 1)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter((r.doc_id, r.length) for r in whole.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "length").collect()) == Counter(got.items())
