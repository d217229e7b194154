"""Matching, churn and walks against plain Python; a Git comparison against numstat."""

import random
import subprocess
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidemark.operators import compare, edges, graph
from tidemark.plans import queries
from tidemark.sources import git


def brute_match(base, target):
    out, groups = Counter(), defaultdict(lambda: ([], []))
    for side, rows in enumerate((base, target)):
        for key, pos, body in sorted(rows):
            groups[key][side].append((pos, body))
    for key, (b, t) in groups.items():
        if len(b) <= 1 and len(t) <= 1:
            out[(key, b[0][0] if b else None, t[0][0] if t else None, 1.0)] += 1
            continue
        b, t = b[:], t[:]
        for x in b[:]:
            y = next((y for y in t if y[1] == x[1]), None)
            if y:
                out[(key, x[0], y[0], 0.9)] += 1
                b.remove(x)
                t.remove(y)
        for k in range(max(len(b), len(t))):
            out[(key, b[k][0] if k < len(b) else None, t[k][0] if k < len(t) else None, 0.6)] += 1
    return out


def test_matching(spark):
    rng = random.Random(4)
    make = lambda: [(rng.randrange(60), p, rng.randrange(4)) for p in range(150)]
    base, target = make(), make()
    schema = "key long, pos long, body long"
    got = compare.match_entities(spark.createDataFrame(base, schema), spark.createDataFrame(target, schema), ["key"], ["pos"], "body")
    assert Counter((r.key, r.b and r.b.pos, r.t and r.t.pos, r.confidence) for r in got.collect()) == brute_match(base, target)


def test_overlap_and_touch(spark):
    rows = [(12, 3, 3), (8, 4, 2), (19, 5, 2), (1, 40, 11), (21, 3, 0), (15, 0, 0)]
    df = spark.createDataFrame(rows, "s int, c int, e long")
    got = df.select("e", compare.overlap(F.lit(10), F.lit(20), F.col("s"), F.col("c")).alias("g")).collect()
    assert all(r.e == r.g for r in got)
    rows = [(9, 0, True), (8, 0, False), (20, 0, True), (21, 0, False), (21, 1, False), (20, 1, True), (8, 2, False), (8, 3, True)]
    got = spark.createDataFrame(rows, "s int, c int, e boolean").select("e", compare.touches(F.lit(10), F.lit(20), F.col("s"), F.col("c")).alias("g")).collect()
    assert all(r.e == r.g for r in got)


def test_walk_depths(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("c", "e")], "from_id string, to_id string")
    root = spark.createDataFrame([("a",)], "id string")
    depths = lambda direction, n: {r.id: r.depth for r in graph.walk(links, root, direction, n).collect()}
    assert depths("downstream", 3) == {"a": 0, "b": 1, "c": 2, "e": 3}
    assert depths("upstream", 2) == {"a": 0, "c": 1, "d": 1, "b": 2}
    assert depths("both", 1) == {"a": 0, "b": 1, "c": 1, "d": 1}
    found = {r.member: r.key for r in graph.cycles(links).collect()}
    assert found == {"a": "a", "b": "a", "c": "a"}


def test_resolution_order(spark):
    tree = spark.createDataFrame([("src/renderer.ts",), ("src/shared/index.ts",), ("src/vnode.tsx",), ("src/legacy.js",)], "path string")
    specs = spark.createDataFrame([("src/a.ts", s, 1) for s in ("./vnode", "./shared", "./legacy", "pkg", "./none", "./renderer.ts")], "path string, specifier string, line int")
    got = edges.resolve(edges.specifier_targets(specs), tree, ["path", "specifier"])
    assert {r.specifier: r.target for r in got.collect()} == {"./vnode": "src/vnode.tsx", "./shared": "src/shared/index.ts", "./legacy": "src/legacy.js", "pkg": None, "./none": None, "./renderer.ts": "src/renderer.ts"}


def test_reexports_stop(spark):
    rows = [("a", "x", "b", "y"), ("b", "y", None, None), ("s", "x", "b", "*"), ("l0", "x", "l1", "x"), ("l1", "x", "l2", "x"), ("l2", "x", "l3", "x"), ("l3", "x", "l4", "x"), ("l4", "x", "l5", "x"), ("l5", "x", None, None)]
    exports = spark.createDataFrame(rows, "path string, name string, from_path string, from_name string")
    got = {(r.path, r.name): (r.def_path, r.hops) for r in edges.chase_reexports(exports.select("path", "name"), exports).collect()}
    assert got[("a", "x")] == ("b", 1) and ("s", "x") not in got and ("l0", "x") not in got and got[("l1", "x")] == ("l5", 4)


def test_git_inventory(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "modified.txt").write_text("one\ntwo\nthree\n")
    (tmp_path / "deleted.txt").write_text("gone\n")
    (tmp_path / "old name.txt").write_text("".join(f"line {i}\n" for i in range(20)))
    (tmp_path / "image.bin").write_bytes(b"\x00\x01\x02\x03")
    run("add", "-A")
    run("commit", "-qm", "base")
    (tmp_path / "modified.txt").write_text("one\n2\nand\nthree\n")
    (tmp_path / "deleted.txt").unlink()
    (tmp_path / "old name.txt").rename(tmp_path / "new name.txt")
    (tmp_path / "added.txt").write_text("new\n")
    (tmp_path / "image.bin").write_bytes(b"\x00\x09")
    run("add", "-A")
    run("commit", "-qm", "target")
    tables = git.inventory(spark, str(tmp_path), "HEAD~1", "HEAD")
    got = {r.target_path or r.base_path: (r.status, r.added_lines, r.removed_lines) for r in tables["file_change"].collect()}
    assert got == {"modified.txt": ("modified", 2, 1), "deleted.txt": ("deleted", 0, 1), "new name.txt": ("renamed", 0, 0), "added.txt": ("added", 1, 0), "image.bin": ("binary", 0, 0)}
    assert tables["hunk"].count() == 3 and tables["blob"].filter("state = 'available'").count() == 5


def test_cycles_of_any_length(spark):
    """A ring of more hops than seven doublings cover is one cycle."""
    ring = [(f"r{k:03d}", f"r{(k + 1) % 300:03d}") for k in range(300)]
    got = {r.member: r.key for r in graph.cycles(spark.createDataFrame(ring, "from_id string, to_id string")).collect()}
    assert got == {f"r{k:03d}": "r000" for k in range(300)}


def test_cycles_alike_in_place_and_by_colors(spark, monkeypatch):
    rng = random.Random(8)
    pairs = {(f"a{rng.randrange(25):02d}", f"a{rng.randrange(25):02d}") for _ in range(30)} | {(f"b{k}", f"b{(k + 1) % 7}") for k in range(7)} | {("c", "c"), ("d", "e")}
    frame = spark.createDataFrame(sorted(pairs), "from_id string, to_id string")
    reach = {a: {a2 for a2 in [b for x, b in pairs if x == a]} for a, _ in pairs}
    while True:
        more = {a: r | {y for x in r for y in reach.get(x, ())} for a, r in reach.items()}
        if more == reach:
            break
        reach = more
    expected = {a: min(x for x in r if a in reach.get(x, ())) for a, r in reach.items() if a in r}
    assert {r.member: r.key for r in graph.cycles(frame).collect()} == expected and len(set(expected.values())) >= 3
    monkeypatch.setattr(graph, "LOCAL_EDGES", 0)
    assert {r.member: r.key for r in graph.cycles(frame).collect()} == expected
    assert graph.cycles(spark.createDataFrame([], "from_id string, to_id string")).count() == 0


def test_cycles_see_every_user(spark, tmp_path):
    """Transitions of all users count; brute force walks each state's successors."""
    rng, rows = random.Random(4), []
    for user in range(60):
        for k in range(rng.randrange(1, 5)):
            rows.append((len(rows), f"2024-01-{rng.choice([1, rng.randrange(1, 31)]):02d} 00:00:00", user, rng.choice("abcd")))
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    links, by_user = {True: defaultdict(set), False: defaultdict(set)}, defaultdict(list)
    for event_id, ts, user, kind in rows:
        by_user[user].append((ts, event_id, kind))
    for u, own in by_user.items():
        own.sort()
        for (ts, _, a), (_, _, b) in zip(own, own[1:]):
            for early in {False, ts < "2024-01-01 02:00:00"}:
                links[early][f"{a}_{u % 6}"].add(f"{b}_{(u * 5 + 1) % 6}")

    def brute(out):
        reach = {}
        for x in list(out):
            todo, seen = [x], set()
            while todo:
                new = out.get(todo.pop(), set()) - seen
                seen |= new
                todo += new
            reach[x] = seen
        return {x: min(y for y in r if x in reach.get(y, ())) for x, r in reach.items() if x in r}

    late, early = brute(links[False]), brute(links[True])
    got = {r.member: r.key for r in queries.cycles(spark, str(tmp_path)).collect()}
    assert got == late and len(late) > 3
    lists = [{k: ",".join(sorted(m for m in c if c[m] == k)) for k in set(c.values())} for c in (late, early)]
    new = {(k, m) for k, m in lists[0].items() if m not in lists[1].values()}
    assert {(r.key, r.members) for r in queries.cycle_introduced(spark, str(tmp_path)).collect()} == new != set()
