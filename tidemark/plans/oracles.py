"""DuckDB SQL for the change-analytics queries, written apart from the operators.

Statements share common table expressions; ``sql(body, *names)`` puts the
chain that ``body`` needs before it.
"""

from __future__ import annotations

_CTE = {
    "repo": """repo AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'src/d'||doc_id||'.ts' WHEN 1 THEN 'src/d'||doc_id||'.tsx' WHEN 2 THEN 'src/d'||doc_id||'/index.ts' ELSE 'tests/d'||doc_id||'.spec.ts' END AS path,
  doc_id % 11 <> 0 AS in_base, doc_id % 13 <> 0 AS in_target, doc_id % 5 = 0 AS edited, coalesce(text, '') AS base_text,
  CASE WHEN doc_id % 5 = 0 THEN regexp_replace(coalesce(text, ''), '^[^\\n]*\\n?', '') || chr(10) || 'edited ' || doc_id ELSE coalesce(text, '') END AS target_text FROM documents)""",
    "trees": """bt AS (SELECT path, md5(base_text) AS blob FROM repo WHERE in_base),
tt AS (SELECT CASE WHEN doc_id % 7 = 3 THEN 'moved/' || path ELSE path END AS path, md5(target_text) AS blob FROM repo WHERE in_target),
fs AS (SELECT coalesce(b.path, t.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN t.path IS NULL THEN 'deleted' ELSE 'modified' END AS status, b.blob AS old_blob, t.blob AS new_blob
  FROM bt b FULL OUTER JOIN tt t ON b.path = t.path WHERE b.blob IS DISTINCT FROM t.blob)""",
    "roles": """roles AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'packages/'||source||'/src/d'||doc_id||'.ts' WHEN 1 THEN 'packages/'||source||'/__tests__/d'||doc_id||'.spec.ts'
  WHEN 2 THEN 'vendor/'||lang||'/d'||doc_id||'.js' WHEN 3 THEN 'packages/'||source||'/dist/d'||doc_id||'.js' WHEN 4 THEN 'docs/d'||doc_id||'.md' WHEN 5 THEN 'apps/'||source||'/tsconfig.'||doc_id||'.json'
  WHEN 6 THEN 'apps/'||source||'/'||lang||doc_id||'/yarn.lock' WHEN 7 THEN '.github/d'||doc_id ELSE 'd'||doc_id||'.ts' END AS path,
  (CASE WHEN text IS NULL OR text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + (CASE WHEN right(text, 1) = chr(10) THEN 0 ELSE 1 END) END)::BIGINT AS lines FROM documents),
cls AS (SELECT *, CASE WHEN regexp_matches(path, '(^|/)yarn\\.lock$') THEN 'lockfile' WHEN regexp_matches(path, '(^|/)vendor/') THEN 'vendored' WHEN regexp_matches(path, '(^|/)dist/') THEN 'generated'
  WHEN regexp_matches(path, '(^|/)__tests__/') THEN 'test' WHEN regexp_matches(path, '^\\.') OR regexp_matches(path, '/tsconfig[^/]*\\.json$') THEN 'config' WHEN path LIKE '%.md' THEN 'docs' ELSE 'source' END AS classification,
  CASE WHEN NOT contains(path, '/') THEN '<root>' WHEN split_part(path, '/', 1) IN ('apps', 'packages') THEN split_part(path, '/', 1) || '/' || split_part(path, '/', 2) ELSE split_part(path, '/', 1) END AS area FROM roles)""",
    "imports": """n AS (SELECT count(*) AS n FROM documents),
files AS (SELECT 'base' AS side, doc_id, path, edited FROM repo WHERE in_base UNION ALL SELECT 'target', doc_id, path, edited FROM repo WHERE in_target),
specs AS (SELECT side, path, 'src/d' || ((doc_id * 7 + 3 + CASE WHEN side = 'target' AND edited THEN 1 ELSE 0 END) % n) AS specifier, 1 AS line FROM files, n
  UNION ALL SELECT side, path, 'src/d' || ((doc_id * 13 + 5) % n), 2 FROM files, n),
res AS (SELECT side, path, specifier, line, CASE
  WHEN EXISTS (SELECT 1 FROM files f WHERE f.side = s.side AND f.path = s.specifier || '.ts') THEN specifier || '.ts'
  WHEN EXISTS (SELECT 1 FROM files f WHERE f.side = s.side AND f.path = s.specifier || '.tsx') THEN specifier || '.tsx'
  WHEN EXISTS (SELECT 1 FROM files f WHERE f.side = s.side AND f.path = s.specifier || '/index.ts') THEN specifier || '/index.ts' END AS target FROM specs s),
be AS (SELECT path AS importer, target, min(line) AS line FROM res WHERE side = 'base' AND target IS NOT NULL GROUP BY ALL),
te AS (SELECT path AS importer, target, min(line) AS line FROM res WHERE side = 'target' AND target IS NOT NULL GROUP BY ALL),
edges AS (SELECT coalesce(b.importer, t.importer) AS importer, coalesce(b.target, t.target) AS target, CASE WHEN b.importer IS NULL THEN 'added' WHEN t.importer IS NULL THEN 'removed' ELSE 'unchanged' END AS status,
  CAST(coalesce(t.line, b.line) AS INT) AS line FROM be b FULL OUTER JOIN te t ON b.importer = t.importer AND b.target = t.target)""",
    "sides": """li AS (SELECT l_orderkey AS file, l_linenumber AS name, l_partkey AS p, l_suppkey AS s, l_returnflag, l_linestatus, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS pos, CAST(l_quantity AS INT) AS loc FROM lineitem),
bs AS (SELECT file, name, pos, pos * 60 AS first, pos * 60 + loc - 1 AS last, 1 + p % 17 AS cyc, s % 40 AS cog, p % 50 AS body, l_returnflag = 'R' AS ex FROM li WHERE (p + s) % 7 <> 0),
ts AS (SELECT file, name, pos, pos * 60 + 2 AS first, pos * 60 + 1 + loc AS last, 1 + p % 17 + CASE WHEN s % 4 = 0 THEN p % 7 ELSE 0 END AS cyc, s % 40 + CASE WHEN s % 4 = 0 THEN p % 13 ELSE 0 END AS cog, p % 50 AS body, l_linestatus = 'O' AS ex FROM li WHERE (p * 3 + s) % 9 <> 0),
k AS (SELECT file, name, max(nb) AS nb, max(nt) AS nt FROM (SELECT file, name, count(*) AS nb, 0 AS nt FROM bs GROUP BY ALL UNION ALL SELECT file, name, 0, count(*) FROM ts GROUP BY ALL) GROUP BY ALL),
ex1 AS (SELECT k.file, k.name, bs.pos AS b_pos, ts.pos AS t_pos, 1.0 AS confidence FROM k LEFT JOIN bs ON bs.file = k.file AND bs.name = k.name LEFT JOIN ts ON ts.file = k.file AND ts.name = k.name WHERE nb <= 1 AND nt <= 1),
ab AS (SELECT bs.*, row_number() OVER (PARTITION BY bs.file, bs.name, body ORDER BY pos) AS r FROM bs JOIN k ON k.file = bs.file AND k.name = bs.name WHERE nb > 1 OR nt > 1),
tb AS (SELECT ts.*, row_number() OVER (PARTITION BY ts.file, ts.name, body ORDER BY pos) AS r FROM ts JOIN k ON k.file = ts.file AND k.name = ts.name WHERE nb > 1 OR nt > 1),
s1 AS (SELECT a.file, a.name, a.pos AS b_pos, t.pos AS t_pos FROM ab a JOIN tb t ON a.file = t.file AND a.name = t.name AND a.body = t.body AND a.r = t.r),
lb AS (SELECT file, name, pos, row_number() OVER (PARTITION BY file, name ORDER BY pos) AS r FROM ab WHERE NOT EXISTS (SELECT 1 FROM s1 WHERE s1.file = ab.file AND s1.b_pos = ab.pos)),
lt AS (SELECT file, name, pos, row_number() OVER (PARTITION BY file, name ORDER BY pos) AS r FROM tb WHERE NOT EXISTS (SELECT 1 FROM s1 WHERE s1.file = tb.file AND s1.t_pos = tb.pos)),
m AS (SELECT * FROM ex1 UNION ALL SELECT file, name, b_pos, t_pos, 0.9 FROM s1 UNION ALL SELECT coalesce(lb.file, lt.file), coalesce(lb.name, lt.name), lb.pos, lt.pos, 0.6 FROM lb FULL OUTER JOIN lt ON lb.file = lt.file AND lb.name = lt.name AND lb.r = lt.r)""",
    "churn": """h AS (SELECT o_orderkey AS file, 1 + o_custkey % 700 + x AS base_start, (o_orderkey + y) % 9 AS base_count, 3 + o_custkey % 700 + x AS target_start, (o_custkey + y) % 9 AS target_count FROM orders, (VALUES (0, 0), (300, 4)) v(x, y)),
d AS (SELECT m.*, b.first AS bf, b.last AS bl, b.cyc AS bcyc, b.cog AS bcog, t.first AS tf, t.last AS tl, t.cyc AS tcyc, t.cog AS tcog FROM m LEFT JOIN bs b ON b.file = m.file AND b.pos = m.b_pos LEFT JOIN ts t ON t.file = m.file AND t.pos = m.t_pos),
o AS (SELECT d.file, d.b_pos, d.t_pos, h.*, d.bf, d.bl, d.tf, d.tl,
  CASE WHEN bf IS NULL OR base_count = 0 THEN 0 ELSE greatest(0, least(bl, base_start + base_count - 1) - greatest(bf, base_start) + 1) END AS rem,
  CASE WHEN tf IS NULL OR target_count = 0 THEN 0 ELSE greatest(0, least(tl, target_start + target_count - 1) - greatest(tf, target_start) + 1) END AS add,
  coalesce(CASE WHEN base_count = 0 THEN base_start BETWEEN bf - 1 AND bl ELSE base_start <= bl AND base_start + base_count - 1 >= bf END, false)
  OR coalesce(CASE WHEN target_count = 0 THEN target_start BETWEEN tf - 1 AND tl ELSE target_start <= tl AND target_start + target_count - 1 >= tf END, false) AS touch,
  coalesce(base_start <= bl AND base_start + greatest(base_count, 1) - 1 >= bf - 1, false) OR coalesce(target_start <= tl AND target_start + greatest(target_count, 1) - 1 >= tf - 1, false) AS near
  FROM d JOIN h ON h.file = d.file),
c AS (SELECT file, b_pos, t_pos, sum(rem) AS rem, sum(add) AS add, count(*) FILTER (touch) AS touched FROM o GROUP BY ALL),
fc AS (SELECT d.*, CAST(coalesce(rem, 0) AS BIGINT) AS lines_removed, CAST(coalesce(add, 0) AS BIGINT) AS lines_added, CAST(coalesce(touched, 0) AS BIGINT) AS changed_hunks,
  CASE WHEN d.b_pos IS NULL THEN 'added' WHEN d.t_pos IS NULL THEN 'removed' WHEN coalesce(touched, 0) > 0 OR bcyc <> tcyc OR bcog <> tcog OR bl - bf <> tl - tf THEN 'modified' ELSE 'unchanged' END AS status
  FROM d LEFT JOIN c ON c.file = d.file AND c.b_pos IS NOT DISTINCT FROM d.b_pos AND c.t_pos IS NOT DISTINCT FROM d.t_pos)""",
    "scores": """imp AS (SELECT o_custkey, count(*) AS direct_importers FROM orders GROUP BY o_custkey),
ofile AS (SELECT o_orderkey AS file, CASE left(o_orderpriority, 1) WHEN '1' THEN 'packages/core/src/f'||o_orderkey||'.ts' WHEN '2' THEN 'packages/core/__tests__/f'||o_orderkey||'.spec.ts' WHEN '3' THEN 'vendor/lib/f'||o_orderkey||'.js' WHEN '4' THEN 'docs/f'||o_orderkey||'.md' ELSE 'src/f'||o_orderkey||'.ts' END AS path,
  CASE left(o_orderpriority, 1) WHEN '2' THEN 'test' WHEN '3' THEN 'vendored' WHEN '4' THEN 'docs' ELSE 'source' END AS classification, direct_importers FROM orders JOIN imp USING (o_custkey)),
exb AS (SELECT DISTINCT file, name FROM bs WHERE ex), ext AS (SELECT DISTINCT file, name FROM ts WHERE ex),
xd AS (SELECT file, name, 'removed' AS x FROM (SELECT * FROM exb EXCEPT SELECT * FROM ext) UNION ALL SELECT file, name, 'added' FROM (SELECT * FROM ext EXCEPT SELECT * FROM exb)),
sg AS (SELECT fc.*, ofile.path, ofile.classification, direct_importers, coalesce(x, 'unchanged') AS exported, lines_added + lines_removed AS churn,
  CAST(coalesce(tcog, 0) - coalesce(bcog, 0) AS BIGINT) AS cognitive_delta, CAST(coalesce(tcyc, 0) - coalesce(bcyc, 0) AS BIGINT) AS cyclomatic_delta, coalesce(tcog, 0) AS cog_after, coalesce(tcyc, 0) AS cyc_after
  FROM fc JOIN ofile ON ofile.file = fc.file LEFT JOIN xd ON xd.file = fc.file AND xd.name = fc.name),
sp AS (SELECT *, CASE WHEN status = 'added' THEN (cog_after >= 10)::INT + (cog_after >= 15)::INT + (cog_after >= 30)::INT + (cyc_after >= 10)::INT + (cyc_after >= 20)::INT
  ELSE (cognitive_delta >= 2)::INT + (cognitive_delta >= 5)::INT + (cognitive_delta >= 10)::INT + (cyclomatic_delta >= 2)::INT + (cyclomatic_delta >= 5)::INT + (cog_after >= 15)::INT + (cog_after >= 30)::INT END + (churn >= 30)::INT AS risk_score FROM sg),
sc AS (SELECT *, risk_score + CASE exported WHEN 'removed' THEN 3 WHEN 'added' THEN 1 ELSE 0 END + (direct_importers >= 5)::INT + (direct_importers >= 20)::INT + (classification = 'source')::INT AS priority_score FROM sp),
sl AS (SELECT *, CASE WHEN risk_score >= 5 THEN 'high' WHEN risk_score >= 2 THEN 'medium' ELSE 'low' END AS risk_level, CASE WHEN priority_score >= 5 THEN 'high' WHEN priority_score >= 2 THEN 'medium' ELSE 'low' END AS priority_level,
  path || '#fn:' || name || '@' || CASE WHEN t_pos IS NULL THEN 'base:' || bf ELSE 'target:' || tf END || ':0' AS function_id, 'fn:' || name AS symbol FROM sc)""",
}
_NEEDS = {"repo": (), "trees": ("repo",), "roles": (), "imports": ("repo",), "sides": (), "churn": ("sides",), "scores": ("sides", "churn")}


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """``body`` after the common table expressions that it needs, each once, in order."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS[name]:
            add(n)
        if name not in wanted:
            wanted.append(name)

    for n in names:
        add(n)
    head = ",\n".join(_CTE[n] for n in wanted)
    rest = body.strip()
    if rest.upper().startswith("WITH "):
        rest = ",\n" + rest[5:]
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{rest if rest.startswith(',') else chr(10) + rest}"
