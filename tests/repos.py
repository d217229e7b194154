"""Small Git repositories with two commits, for tests."""

import subprocess

NEAR = "import { score } from './util';\nexport function use{0}() {{ return score({0}); }}\n"


def _git(root, *args):
    fixed = {"GIT_AUTHOR_DATE": "2024-01-01T00:00:00Z", "GIT_COMMITTER_DATE": "2024-01-01T00:00:00Z", "PATH": "/usr/bin:/bin:/usr/local/bin", "HOME": str(root)}
    names = ["-c", "user.name=t", "-c", "user.email=t@example.org", "-c", "commit.gpgsign=false", "-c", "init.defaultBranch=main"]
    return subprocess.run(["git", "-C", str(root), *names, *args], check=True, capture_output=True, env=fixed).stdout.decode().strip()


def repository(root, base: dict, target: dict) -> tuple[str, str, str]:
    """A repository at ``root`` whose two commits hold the files given (None: deleted): path, base and target commit."""
    root.mkdir(parents=True, exist_ok=True)
    _git(root, "init", "-q")
    commits = []
    for files in (base, target):
        for path, content in files.items():
            at = root / path
            if content is None:
                at.unlink()
                continue
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_bytes(content if isinstance(content, bytes) else content.encode())
        _git(root, "add", "-A")
        _git(root, "commit", "-q", "-m", "x")
        commits.append(_git(root, "rev-parse", "HEAD"))
    return str(root), *commits


def sample(root):
    """A utility whose export comes new and whose caller moves to it, with importers, a test, calls over a barrel, and odd files."""
    deep = "export function deep(a, b) {\n  if (a) {\n    if (b) {\n      for (const x of a) {\n        if (x) { return a && b; }\n      }\n    }\n  }\n  return 0;\n}\n"
    base = {
        "src/util.ts": "export function old(a) {\n  return a;\n}\nfunction helper() {\n  return 1;\n}\n",
        "src/legacy.ts": "export function legacy(a) { return a; }\n",
        "src/barrel.ts": "export { legacy as relic } from './legacy';\nexport * from './util';\n",
        "src/app.ts": "import { legacy } from './legacy';\nimport { relic } from './barrel';\nimport * as lib from './legacy';\nfunction helper() {\n  return 1;\n}\nexport function run(x) {\n  helper();\n  return legacy(relic(x));\n}\nconst dup = [() => 1, () => 2];\n",
        "src/broken.ts": "export const x = 1;\n",
        "README.md": "one\n",
        "image.bin": b"\x00\x01\x02\x03",
        "tsconfig.json": '{\n  // paths\n  "compilerOptions": { "paths": { "@lib/*": ["./src/*"], }, },\n}\n',
        "tests/app.spec.ts": "import { run } from '@lib/app';\ntest('runs', () => { run(1); });\n",
    }
    base |= {f"src/near{i}.ts": f"import {{ old }} from './util';\nexport function use{i}() {{ return old({i}); }}\n" for i in range(5)}
    target = {
        "src/util.ts": "export function score(a) {\n  return a ? 1 : 2;\n}\nfunction helper() {\n  return 1;\n}\n",
        "src/app.ts": "import { score } from './util';\nimport { relic } from './barrel';\nimport * as lib from './legacy';\nfunction helper() {\n  return 1;\n}\nexport function run(x) {\n  helper();\n  lib.legacy(x);\n  return score(relic(x));\n}\nconst dup = [() => 1, () => 2];\n",
        "src/added.ts": deep,
        "src/broken.ts": "export function broken(a {\n",
        "src/bytes.ts": b"export const \xe9 = 1;\n",
        "README.md": "two\n",
        "image.bin": b"\x00\x01\x02\x04",
    }
    target |= {f"src/near{i}.ts": f"import {{ score }} from './util';\nexport function use{i}() {{ return score({i}); }}\n" for i in range(5)}
    return repository(root, base, target)
