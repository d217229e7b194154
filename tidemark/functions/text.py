"""Source text: comments, line counts, identities, import prefixes, and JSON with comments.

Patterns do the work of scanners: strings are matched before comments, so a
comment mark inside a string is none. Column forms run on Arrow batches.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

# Bytes of an identity segment, of a scanned prefix and of what is read after its last import.
SEGMENT_BYTES, PREFIX_BYTES, PREFIX_MARGIN, PARSE_BYTES = 64, 64 * 1024, 512, 5 * 1024 * 1024

_QUOTED = {q: rf"{q}(?:\\.|[^{q}\\])*(?:{q}|\\?\Z)" for q in "\"'`"}
_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_CODE = re.compile(f"({'|'.join(_QUOTED.values())})|{_COMMENT}", re.S)
_JSONC = re.compile(f"({_QUOTED[chr(34)]})|{_COMMENT}", re.S)
_TRAILING = re.compile(rf"({_QUOTED[chr(34)]})|,(?=\s*[}}\]])", re.S)


def without_comments(source: str) -> str:
    """Source with comments gone and its lines kept; regular expressions aren't told from divisions."""
    return _CODE.sub(lambda m: m[1] if m[1] is not None else "\n" * m[0].count("\n") or " ", source)


def source_lines(source: str) -> int:
    """Lines that hold more than comments and white space."""
    return sum(bool(x.strip()) for x in without_comments(source).split("\n"))


def physical_lines(source: str) -> int:
    return source.count("\n") + (not source.endswith("\n")) if source else 0


def segment(text: str) -> str:
    """One bounded piece of an identity: white space collapsed, 64 bytes at most."""
    flat = " ".join(text.split())
    raw = flat.encode()
    return flat if len(raw) <= SEGMENT_BYTES else raw[:SEGMENT_BYTES].decode(errors="ignore") + "..."


def import_prefix(source: bytes) -> tuple[bytes, bool]:
    """The part of a file that holds its imports, and whether the bound cut it short."""
    wanted = max(source.rfind(b"import"), source.rfind(b"from"), 0) + PREFIX_MARGIN
    end = min(wanted, PREFIX_BYTES, len(source))
    while 0 < end < len(source) and source[end] & 0xC0 == 0x80:
        end -= 1
    return source[:end], wanted > PREFIX_BYTES


def read_jsonc(text: str):
    """JSON that may hold comments and trailing commas."""
    plain = _JSONC.sub(lambda m: m[1] or " ", text)
    return json.loads(_TRAILING.sub(lambda m: m[1] or "", plain))


def path_aliases(config: str) -> list[tuple[int, str, str]]:
    """(rank, pattern, target) of a configuration's path aliases: longest pattern first, then by name.

    Only the first target of each counts; a text that can't be read has none.
    """
    try:
        found = read_jsonc(config)["compilerOptions"]["paths"]
        pairs = [(p, t[0]) for p, t in found.items() if isinstance(t, list) and t and isinstance(t[0], str)]
    except (ValueError, KeyError, TypeError, AttributeError):
        return []
    ordered = sorted(pairs, key=lambda x: (-len(x[0].encode()), x[0]))
    return [(i, p, t.removeprefix("./")) for i, (p, t) in enumerate(ordered)]


def body_key(text: Column) -> Column:
    """Identity of a body up to white space: a digest, so equal keys mean equal text."""
    return F.sha2(F.btrim(F.regexp_replace(text, r"[ \t\n\f\r]+", " "), F.lit(" ")), 256)


@F.pandas_udf(IntegerType())
def source_loc(texts: pd.Series) -> pd.Series:
    return texts.map(source_lines, na_action="ignore").astype("Int32")


def source_state(path: Column, content: Column) -> Column:
    """What parsing a file would come to, before it is parsed."""
    from .paths import language

    return F.when(language(path).isNull(), "unsupported_language").when(F.length(content) > PARSE_BYTES, "oversized_file").when(~F.is_valid_utf8(content.cast("string")), "invalid_utf8").otherwise("parse")
