"""Oracle SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

_LINES = r"""
notes AS (SELECT DISTINCT ON (id) id, trim(regexp_replace(lower(fuente), '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g')) AS source, cuerpo FROM noticias WHERE fuente IS NOT NULL),
kept AS (SELECT * FROM notes WHERE source <> ''),
lines AS (SELECT id, source, unnest(string_split(cuerpo, chr(10))) AS line, generate_subscripts(string_split(cuerpo, chr(10)), 1) AS line_no FROM kept WHERE cuerpo IS NOT NULL),
keys AS (SELECT id, source, line_no, regexp_replace(regexp_replace(regexp_replace(lower(line), '[\s\x{00A0}]+', ' ', 'g'), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'), '[0-9]+', '0', 'g') AS key FROM lines),
totals AS (SELECT source, count(*) AS n FROM kept GROUP BY source),
repeated AS (SELECT k.source, k.key FROM keys k JOIN totals t USING (source) WHERE k.key <> '' GROUP BY k.source, k.key, t.n HAVING count(DISTINCT k.id) >= 4 AND count(DISTINCT k.id) >= 0.03 * t.n),
gone AS (SELECT DISTINCT k.id, k.line_no FROM keys k JOIN repeated r USING (source, key))
"""

P3_FOUND = f"WITH {_LINES} SELECT id, CAST(line_no AS INTEGER) AS line_no FROM gone"

P3_CLEAN = f"""WITH {_LINES},
everything AS (SELECT DISTINCT ON (id) id, cuerpo FROM noticias),
each AS (SELECT id, unnest(string_split(cuerpo, chr(10))) AS line, generate_subscripts(string_split(cuerpo, chr(10)), 1) AS line_no FROM everything WHERE cuerpo IS NOT NULL),
joined AS (SELECT e.id, string_agg(e.line, chr(10) ORDER BY e.line_no) AS cuerpo FROM each e WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.id = e.id AND g.line_no = e.line_no) GROUP BY e.id)
SELECT e.id, CASE WHEN e.cuerpo IS NULL THEN NULL ELSE coalesce(j.cuerpo, '') END AS cuerpo FROM everything e LEFT JOIN joined j USING (id)"""


P9_FOUND = r"""WITH
d AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM d),
bg AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM b)
SELECT DISTINCT doc_id, item_id FROM dg JOIN bg USING (g)"""


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3_FOUND, "p3_clean": P3_CLEAN, "p9_found": P9_FOUND}
