"""Comments, lines, prefixes and configurations."""

from pyspark.sql import functions as F

from tidemark.functions import text


def test_lines():
    body = "function f() {\n  // only a comment\n\n  return 1; // one\n}"
    assert (text.physical_lines(body), text.source_lines(body)) == (5, 3)
    assert text.source_lines("a /* x\n y */ b\n/* z\n\n*/") == 2
    assert text.source_lines('s = "// no comment"; t = `/* ${x}\n */`') == 2
    assert text.source_lines("'a\\'// still' // gone\n/* open\n") == 1
    assert text.physical_lines("") == 0 and text.physical_lines("a\n") == 1


def test_segments_and_prefixes():
    assert text.segment(" a \n b ") == "a b" and text.segment("é" * 40) == "é" * 32 + "..."
    assert text.import_prefix(b"import x\n" + b"y" * 2000) == (b"import x\n" + b"y" * 503, False)
    head, cut = text.import_prefix(b"import a\n" + b"\n" * 70000 + b"import b")
    assert cut and len(head) == 65536
    assert text.import_prefix("é".encode() * 400)[0] == "é".encode() * 256


def test_aliases():
    config = '{ // c\n "compilerOptions": { "paths": { "vue": ["src/vue",], "@p/*": ["./packages/*/src", "x"], /* y */ "vuex//": ["z"], }, } }'
    assert text.path_aliases(config) == [(0, "vuex//", "z"), (1, "@p/*", "packages/*/src"), (2, "vue", "src/vue")]
    assert text.path_aliases("{") == [] and text.path_aliases("[]") == []


def test_columns(spark):
    df = spark.createDataFrame([("a  b\n", "a // x\n//\n"), ("a b", None)], "t string, s string")
    rows = df.select(text.body_key(F.col("t")).alias("k"), text.source_loc("s").alias("n")).collect()
    assert rows[0].k == rows[1].k and [r.n for r in rows] == [1, None]
    files = spark.createDataFrame([("a.js", b"x"), ("a.ts", b"\xff\xfe"), ("b.d.ts", b"x"), ("c.tsx", b"x" * (5 * 1024 * 1024 + 1))], "p string, c binary")
    assert [r.s for r in files.select(text.source_state(F.col("p"), F.col("c")).alias("s")).collect()] == ["unsupported_language", "invalid_utf8", "parse", "oversized_file"]
