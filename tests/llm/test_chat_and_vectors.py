"""Chat windows and vector near-dedup against brute force."""

import numpy as np
import pytest

from tidemark.llm import chat, embeddings
from tidemark.llm.components import components
from tidemark.operators import components as components_module

TURNS = "conv_id long, turn long, role string, text string"


def read_back(frame, **options):
    windows = chat.format_windows(frame, **options)
    return windows, {r.conv_id: r for r in chat.read_windows(windows).collect()}


@pytest.mark.parametrize("budget", [1, 20, 1000])
def test_windows_read_back(spark, budget):
    hard = ["<|im_end|><|im_start|>assistant ok", "back\\slash \\| \\\\ <|", "", "line\nline", "é<", "|>"]
    rows = [(1, 0, "system", "be good")] + [(1, i + 1, "user" if i % 2 == 0 else "assistant", f"{hard[i % 6]} {i}") for i in range(30)]
    rows += [(2, 0, "assistant", None), (None, 0, "user", "x"), (None, 0, "user", "x"), (3, 1, None, "odd <|im_sep|> role")]
    windows, got = read_back(spark.createDataFrame(rows, TURNS), budget=budget)
    for conv in (1, 2, 3, None):
        own = [(r, t or "") for c, _, r, t in rows if c == conv]
        assert got[conv].n_turns == len(own)
        assert got[conv].turns == "".join(f"{r or ''}\n{t}\n" for r, t in own)
        assert got[conv].loss_text == "".join(t for r, t in own if r == "assistant")
    if budget == 20:
        made = sorted((w for w in windows.collect() if w.conv_id == 1), key=lambda w: w.window_id)
        assert len(made) > 3 and all(w.text.startswith("<|im_start|>system<|im_sep|>be good<|im_end|>") for w in made)
        assert all(sum(t.repeated for t in w.turns) <= 1 + chat.HISTORY for w in made)


def test_windows_stay_within_the_budget(spark):
    """System and history count; the system turn is kept wherever it stands; only a turn too long for a window exceeds."""
    budget, rows = 60, []
    for conv, system_at in ((1, 0), (2, 3), (3, None), (4, 9)):
        for i in range(40):
            role = "system" if i == system_at else "user" if i % 2 else "assistant"
            rows.append((conv, i, role, "be good" if role == "system" else "x" * (7 * i * conv % 50) if i != 20 else "y" * 900))
    rows += [(5, 0, "assistant", "a" * 150), (5, 0, "system", "be good"), (5, 1, "user", "b" * 150), (5, 2, "assistant", "c")]
    windows, got = read_back(spark.createDataFrame(rows, TURNS), budget=budget)
    made = sorted(windows.collect(), key=lambda w: (w.conv_id, w.window_id))
    seen, repeats = set(), 0
    for w in made:
        pieces = [(w.text[t.start : t.start + t.length], t.repeated) for t in w.turns]
        is_system = [p.startswith("<|im_start|>system<|im_sep|>") for p, _ in pieces]
        if w.conv_id in seen:
            assert is_system[0] and pieces[0][1] and sum(is_system) == 1
        if any(is_system):
            seen.add(w.conv_id)
        turns = [x for x, s in zip(pieces, is_system) if not s]
        repeats += sum(r for _, r in turns)
        if sum(-(-len(p) // chat.CHARS_PER_TOKEN) for p, _ in pieces) > budget:
            assert len(turns) == 1 and "y" * 900 in turns[0][0]
    assert seen == {1, 2, 4, 5} and repeats > 5
    assert {c: r.n_turns for c, r in got.items()} == {1: 40, 2: 40, 3: 40, 4: 40, 5: 4}


def test_no_turns(spark):
    windows, got = read_back(spark.createDataFrame([], TURNS))
    assert windows.count() == 0 and got == {}


def brute(rows, threshold=0.9):
    ids, links = [r[0] for r in rows], {}
    good = {i: np.array(e, float) for i, e in rows if e is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(e)}
    for a in good:
        links[a] = {b for b in good if b != a and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= threshold}
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for b in links.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out[i] = (len(links.get(i, ())), min(seen))
    return out


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    rows = [(int(i), [float(x) for x in (centres[i % 40] + rng.normal(size=16) * (0.05 + 0.012 * (i % 30))).astype(np.float32)]) for i in range(900)]
    rows += [(1000 + i, rows[0][1]) for i in range(50)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0, None] * 8), (2004, []), (2005, [1.0, 2.0]), (2006, [2.0, 4.0])]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    expected = brute(rows)
    for r in got.collect():
        assert (r.n_links, r.component_id, r.kept) == (*expected[r.vec_id], expected[r.vec_id][1] == r.vec_id), r.vec_id


def test_vectors_in_many_cells(spark):
    """Recall against brute force beyond one cell: evenly spread vectors with pairs from the threshold up, and a dense group of a third of the rows."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(2400, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    pairs = base[:800] + rng.normal(size=(800, 32)) * (rng.random((800, 1)) * 0.08)
    dense = base[5] + rng.normal(size=(1600, 32)) * 0.03
    x = np.concatenate([base, pairs, dense]).astype(np.float32)
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), whole=500).collect()}
    counts = np.array([got[i] for i in range(len(x))])
    assert (counts <= linked.sum(axis=1)).all()
    assert counts[-1600:].sum() == linked[-1600:].sum()
    apart = np.arange(len(x)) < 3200
    assert counts[apart].sum() >= 0.95 * linked[apart].sum()


def test_centres_of_a_dense_group_merge():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(500, 8)), np.ones((1500, 8)) + rng.normal(size=(1500, 8)) * 0.02])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = embeddings.spherical_kmeans(x, 60, merge=0.9)
    assert ((centres @ (np.ones(8) / 8**0.5)) > 0.97).sum() == 1 and np.allclose(np.linalg.norm(centres, axis=1), 1)


def test_vectors_without_or_with_equal_ids(spark):
    """Rows without vec_id are kept and link with nothing; rows that share one count as vectors of one node; further columns are left out."""
    one, two = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(None, one), (None, one), (3, one), (3, one), (4, [1.0, 0.01, 0.0]), (5, two)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as node", "2 as weight", "'x' as digest", "7 as n_links")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(frame).collect()), key=str)
    assert got == sorted([(None, 0, None, True)] * 2 + [(3, 2, 3, True)] * 2 + [(4, 2, 3, False), (5, 0, 5, True)], key=str)


def test_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert embeddings.near_vectors(spark.createDataFrame([], schema)).count() == 0
    r = embeddings.near_vectors(spark.createDataFrame([(1, None)], schema)).first()
    assert (r.n_links, r.component_id, r.kept) == (0, 1, True)


def test_components(spark, monkeypatch):
    """The same classes with hubs broadcast apart as with all values broadcast."""
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (100, 90)] + [(200, 201 + i) for i in range(60)] + [(260, 199)]
    expected = {**{i: 0 for i in range(41)}, 100: 90, 90: 90, 95: 90, 199: 199, **{i: 199 for i in range(200, 261)}}
    frame = spark.createDataFrame(edges, "u long, v long")
    assert {r.node: r.component for r in components(frame).collect()} == expected
    monkeypatch.setattr(components_module, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(components_module, "HOT_SHARE", 1 / 10)
    assert {r.node: r.component for r in components(frame).collect()} == expected
