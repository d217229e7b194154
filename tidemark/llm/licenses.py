"""Licence scan: canonical digests of entire texts, hash-joined to a catalogue of known digests.

The units looked up are a document's whole text and each of its lines, each as
one entire text. Canonical form: lower case, holder and year lines gone,
equivalent spellings made one, every run of other characters than letters and
digits one space, a licence's title at the start gone. A unit matches where its
SHA-256 is in the catalogue.

Null and blank units match nothing. A line that repeats counts each time. Rows
that share a doc_id share what was found in any of them; rows without doc_id
find nothing. An empty table gives no rows.
"""

from __future__ import annotations

import re
from importlib.resources import files

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

#: Licence id and a text that states it.
STATEMENTS = (
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)


def _full_texts() -> tuple[tuple[str, str], ...]:
    """Licence id and full text, in each form that licence files have."""
    out = [("ISC", _ISC.replace("and/or distribute", "and distribute"))]
    for name in ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-3.0", "MPL-2.0"):
        text = (files(__package__) / "license_texts" / f"{name}.txt").read_text("utf-8")
        out.append((name, text))
        if name.startswith("BSD"):
            out.append((name, re.sub(r"(?m)^[123]\.", "*", text)))
        terms, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        if end:  # Without the guide on how to apply it.
            out += [(name, terms), (name, terms + end)]
    return tuple(out)


#: Statements and full texts. Fixed, and so is the size of their digests.
CATALOGUE = (*STATEMENTS, *_full_texts())
#: Spellings that mean the same: pattern in lower case, and what it becomes.
EQUIVALENT = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-infringement", "noninfringement"),
    ("non-commercial", "noncommercial"),
    ("copyright owner", "copyright holder"),
    ("http://", "https://"),
    ("&", " and "),
)
_MARKS, _HOLDER = r"[^\p{L}\p{N}\n]*", r"copyright[ \t:]+(?!(?:notices?|holders?|owners?|laws?|licen[sc]es?|statements?|permission)\b)\p{L}"
#: Lines that name holders or years rather than terms: with a sign or year
#: anywhere, with a name at the start of a paragraph or right below another.
#: Prose that breaks before the word copyright stays.
COPYRIGHT = (
    rf"(?md)^(?:{_MARKS}(?:copyright[ \t:,]*(?:\(c\)|©|&copy;|[\[<{{]|[12]\d\d\d)|\(c\)[ \t]*(?:copyright|[12]\d\d\d)|©|&copy;|all rights reserved)"
    rf"|(?<=\A|(?:\A|\n)[ \t\r*#/;]{{0,9}}\n){_MARKS}{_HOLDER}|(?<=\A){_MARKS}\(c\)[ \t]*\p{{L}})[^\n]*(?:\n{_MARKS}{_HOLDER}[^\n]*)*"
)
#: Titles that open a canonical text and are no terms.
TITLE = (
    r"^(?:the )?(?:(?:mit|expat) license(?: mit| expat)?|isc license(?: isc)?|(?:[23] clause bsd|bsd [23] clause|bsd|(?:new|modified|revised|simplified) bsd)(?: new| revised| modified| simplified| or){0,3} license"
    r"|apache license version 2 0(?: january 2004)?(?: https www apache org licenses)?|gnu general public license version 3(?: 29 june 2007)?|mozilla public license version 2 0) "
)


def canonical(text: Column) -> Column:
    """Canonical form of a text; of several lines, without copyright lines."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT, "")
    for a, b in EQUIVALENT:
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.btrim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    # Again, for what a line break parted.
    out = F.replace(out, F.lit("copyright owner"), F.lit("copyright holder"))
    return F.regexp_replace(out, TITLE, "")


def scan(docs: DataFrame, catalogue: tuple[tuple[str, str], ...] = CATALOGUE) -> DataFrame:
    """doc_id, unit (-1 for the whole text, else the line's number from 0) and license, one row for each match."""
    spark = docs.sparkSession
    known = spark.createDataFrame(list(catalogue), "license string, text string").select("license", F.sha2(canonical(F.col("text")), 256).alias("digest")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    units = docs.filter("doc_id is not null").select("doc_id", F.posexplode(F.concat(F.array(text), F.split(text, "\n", -1))).alias("unit", "body"))
    units = units.select("doc_id", (F.col("unit") - 1).alias("unit"), canonical(F.col("body")).alias("body")).filter("body <> ''")
    # The catalogue is a constant of this module or a driver-side tuple: a few digests.
    return units.select("doc_id", "unit", F.sha2("body", 256).alias("digest")).join(F.broadcast(known), "digest").select("doc_id", "unit", "license")


def licensed(docs: DataFrame, catalogue: tuple[tuple[str, str], ...] = CATALOGUE) -> DataFrame:
    """doc_id, licenses (sorted, joined by commas), n_license_lines and whole_text, one row for each row of ``docs``."""
    found = scan(docs, catalogue).groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
        F.count_if(F.col("unit") >= 0).alias("n_license_lines"),
        F.bool_or(F.col("unit") < 0).alias("whole_text"),
    )
    return docs.select("doc_id").join(found, "doc_id", "left").select(
        "doc_id", F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines"), F.coalesce("whole_text", F.lit(False)).alias("whole_text")
    )


_SQL_COPYRIGHT = r"^[^\p{L}\p{N}]*(copyright|\(c\)|©|all rights reserved)"


def duckdb_sql(catalogue: tuple[tuple[str, str], ...] = STATEMENTS) -> str:
    """The scan over ``documents`` in DuckDB, for statements only: it knows no full texts but two, no titles, and takes every line that opens with copyright as a holder's."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def form(x: str) -> str:
        out = f"array_to_string(list_filter(string_split(lower({x}), chr(10)), lambda y: NOT regexp_matches(y, {quoted(_SQL_COPYRIGHT)})), chr(10))"
        for a, b in EQUIVALENT:
            out = f"replace({out}, {quoted(a)}, {quoted(b)})"
        return f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"

    rows = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in catalogue)
    return f"""
WITH known AS (SELECT DISTINCT license, sha256({form("t")}) AS digest FROM (VALUES {rows}) v(license, t)),
u AS (SELECT doc_id, -1 AS unit, coalesce(text, '') AS b FROM documents UNION ALL
  SELECT doc_id, i - 1, l[i] FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) r(i)),
n AS (SELECT doc_id, unit, {form("b")} AS b FROM u),
f AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(*) FILTER (unit >= 0) AS n, bool_or(unit < 0) AS w
  FROM n JOIN known ON digest = sha256(b) WHERE b <> '' GROUP BY doc_id)
SELECT doc_id, coalesce(licenses, '') AS licenses, CAST(coalesce(n, 0) AS BIGINT) AS n_license_lines, coalesce(w, false) AS whole_text
FROM documents LEFT JOIN f USING (doc_id)
"""
