"""Two revisions of a Git repository as tables.

Git is asked a fixed number of times for a comparison, whatever its size: raw
diff, patch, numstat and two trees. Their output is parsed on the driver; the
tables hold one row for each changed file, hunk or tree entry. Contents are read
by tasks, one batch process each, so the driver holds none; the repository's
folder must be there for them too.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ZERO = re.compile(r"^0+$")
_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
FILE_SCHEMA = "file_ix int, base_path string, target_path string, status string, old_blob_id string, new_blob_id string, added_lines int, removed_lines int"
HUNK_SCHEMA = "file_ix int, hunk_ix int, base_start int, base_count int, target_start int, target_count int, added_lines int, removed_lines int"
BLOB_SCHEMA = "blob_id string, state string, content binary"
_STATUS = {"A": "added", "D": "deleted", "M": "modified", "R": "renamed"}


class GitError(RuntimeError):
    """A Git command failed or said what this reader doesn't know."""


@dataclass(frozen=True)
class Repository:
    root: str

    @classmethod
    def open(cls, path: str) -> "Repository":
        """The repository around any path inside it."""
        return cls(_git(path, "rev-parse", "--show-toplevel").decode().strip())

    def resolve(self, revision: str) -> str:
        """Commit id of a revision."""
        return _git(self.root, "rev-parse", "--verify", "--end-of-options", revision + "^{commit}").decode().strip()


def _git(root: str, *args: str, data: bytes | None = None) -> bytes:
    done = subprocess.run(["git", "-C", root, *args], input=data, capture_output=True)
    if done.returncode:
        raise GitError(done.stderr.decode("utf-8", "replace").strip())
    return done.stdout


def parse_raw(out: bytes) -> list[dict]:
    """Records of ``diff --raw -z``: added, deleted, modified and renamed files."""
    parts, rows, i = out.split(b"\0"), [], 0
    while i < len(parts) and parts[i]:
        fields = parts[i].decode().lstrip(":").split(" ")
        if len(fields) != 5 or fields[4][:1] not in _STATUS:
            raise GitError(f"unknown change record {parts[i]!r}")
        kind, old, new = fields[4][0], *(None if ZERO.match(x) else x for x in fields[2:4])
        first = parts[i + 1].decode("utf-8", "replace")
        second = parts[i + 2].decode("utf-8", "replace") if kind == "R" else first
        i += 3 if kind == "R" else 2
        rows.append({"base_path": None if kind == "A" else first, "target_path": None if kind == "D" else second, "status": _STATUS[kind], "old_blob_id": old, "new_blob_id": new})
    return rows


def parse_numstat(out: bytes) -> dict[str, tuple[int, int] | None]:
    """Line counts by target path of ``diff --numstat -z``, None for binary files."""
    parts, counts, i = out.split(b"\0"), {}, 0
    while i < len(parts) and parts[i]:
        added, removed, path = parts[i].split(b"\t", 2)
        if not path:  # a rename: both paths follow
            path, i = parts[i + 2], i + 2
        counts[path.decode("utf-8", "replace")] = None if added == b"-" else (int(added), int(removed))
        i += 1
    return counts


def _unquoted(path: str) -> str:
    """A path of a patch header without Git's trailing tab, quotes and escapes."""
    path = path.rstrip("\t")
    if path.startswith('"') and path.endswith('"'):
        raw = re.sub(rb'\\([0-7]{3}|.)', lambda m: bytes([int(m[1], 8)]) if len(m[1]) == 3 else {b"n": b"\n", b"t": b"\t", b"r": b"\r"}.get(m[1], m[1]), path[1:-1].encode("utf-8", "surrogateescape"))
        return raw.decode("utf-8", "replace")
    return path


def parse_patch(text: str) -> dict[str, list[dict]]:
    """Hunks by path (the target's, or the base's of a deleted file) of a patch without context lines."""
    found: dict[str, list[dict]] = {}
    base = target = None
    left = [0, 0]
    for line in text.split("\n"):
        if left[0] > 0 or left[1] > 0:
            hunk = found[target or base][-1]
            if line.startswith("+"):
                left[1] -= 1
                hunk["added_lines"] += 1
            elif line.startswith("-"):
                left[0] -= 1
                hunk["removed_lines"] += 1
            continue
        if line.startswith("diff --git "):
            base = target = None
        elif line.startswith("--- "):
            base = None if line[4:] == "/dev/null" else _unquoted(line[4:]).removeprefix("a/")
        elif line.startswith("+++ "):
            target = None if line[4:] == "/dev/null" else _unquoted(line[4:]).removeprefix("b/")
        elif m := _HUNK.match(line):
            counts = [int(m[2]) if m[2] is not None else 1, int(m[4]) if m[4] is not None else 1]
            found.setdefault(target or base, []).append({"base_start": int(m[1]), "base_count": counts[0], "target_start": int(m[3]), "target_count": counts[1], "added_lines": 0, "removed_lines": 0})
            left = counts[:]
    return found


def load_blobs(root: str, ids: list[str]) -> list[tuple[str, str, bytes | None]]:
    """Each distinct id with available content or missing, through one batch process."""
    ids = sorted(set(ids))
    out = _git(root, "cat-file", "--batch", data="".join(f"{i}\n" for i in ids).encode()) if ids else b""
    rows, at = [], 0
    for i in ids:
        end = out.index(b"\n", at)
        head = out[at:end].decode().split(" ")
        at = end + 1
        if head[-1] == "missing":
            rows.append((i, "missing", None))
            continue
        if head[1] != "blob":
            raise GitError(f"{i} is a {head[1]}")
        size = int(head[2])
        rows.append((i, "available", out[at : at + size]))
        at += size + 1
    return rows


def list_tree(root: str, commit: str) -> list[tuple[str, str]]:
    """(path, blob_id) of a commit, by path."""
    rows = []
    for record in _git(root, "ls-tree", "-r", "-z", commit).split(b"\0"):
        if record:
            head, path = record.split(b"\t", 1)
            rows.append((path.decode("utf-8", "replace"), head.decode().split(" ")[2]))
    return sorted(rows)


def tree(spark: SparkSession, root: str, commit: str) -> DataFrame:
    """path and blob_id of a commit's files."""
    return spark.createDataFrame(list_tree(root, commit), "path string, blob_id string")


def blobs(root: str, ids: DataFrame) -> DataFrame:
    """blob_id, state and content of each distinct id of ``ids`` (blob_id), read by one batch process a task and 256 ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = load_blobs(root, b.column(0).slice(at, 256).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.binary()))], names=["blob_id", "state", "content"])

    return ids.select("blob_id").filter("blob_id is not null").distinct().mapInArrow(run, BLOB_SCHEMA)


def inventory(spark: SparkSession, path: str, base: str, target: str) -> dict[str, DataFrame]:
    """Tables file_change, hunk, blob and tree of a comparison."""
    repo = Repository.open(path)
    a, b = repo.resolve(base), repo.resolve(target)
    common = ("-c", "core.quotePath=false", "diff", "--find-renames")
    files = parse_raw(_git(repo.root, *common, "--raw", "-z", "--no-abbrev", a, b))
    hunks = parse_patch(_git(repo.root, *common, "--unified=0", "--no-ext-diff", "--no-color", a, b).decode("utf-8", "replace"))
    counts = parse_numstat(_git(repo.root, *common, "--numstat", "-z", a, b))
    # The base path of null sorts first, as none before some.
    files.sort(key=lambda f: (f["target_path"] or f["base_path"], f["base_path"] is not None, f["base_path"] or ""))
    rows, lines, ids = [], [], set()
    for ix, f in enumerate(files):
        key = f["target_path"] or f["base_path"]
        binary = key in counts and counts[key] is None
        own = [] if binary else hunks.get(key, [])
        rows.append((ix, f["base_path"], f["target_path"], "binary" if binary else f["status"], f["old_blob_id"], f["new_blob_id"], sum(h["added_lines"] for h in own), sum(h["removed_lines"] for h in own)))
        lines += [(ix, k, *h.values()) for k, h in enumerate(own)]
        if not binary:
            ids |= {x for x in (f["old_blob_id"], f["new_blob_id"]) if x}
    trees = [("base", *x) for x in list_tree(repo.root, a)] + [("target", *x) for x in list_tree(repo.root, b)]
    return {
        "file_change": spark.createDataFrame(rows, FILE_SCHEMA),
        "hunk": spark.createDataFrame(lines, HUNK_SCHEMA),
        "blob": blobs(repo.root, spark.createDataFrame([(x,) for x in sorted(ids)], "blob_id string")),
        "tree": spark.createDataFrame(trees, "side string, path string, blob_id string"),
    }
