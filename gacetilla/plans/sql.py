"""Oracle SQL (DuckDB) of the queries, over the same tables."""

from __future__ import annotations

from gacetilla.functions import constants as K

_N = "n AS (SELECT DISTINCT ON (id) * FROM noticias)"
_S = r"[\s\x{00A0}]"


def _list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^{_S}+|{_S}+$', '', 'g')"


def _section(c: str) -> str:
    low = f"lower({_strip(f'coalesce({c}, chr(32))')})"
    return "CASE " + " ".join(f"WHEN contains({low}, '{k}') THEN '{v}'" for k, v in K.SECTION_OF) + " ELSE 'Local' END"


def _class(c: str) -> str:
    low = f"lower({_strip(f'coalesce({c}, $$Local$$)')})"
    return "CASE " + " ".join(f"WHEN {low} IN ({_list([s.lower() for s in g])}) THEN '{g[0].lower()}'" for g in K.SECTION_GROUPS) + f" ELSE {low} END"


def _tokens(key: str, c: str, source: str) -> str:
    return rf"""(SELECT DISTINCT {key}, t FROM (SELECT {key}, unnest(string_split_regex(regexp_replace(lower({c}), '[^a-záéíóúüñ\s\x{{00A0}}]', '', 'g'), '{_S}+')) AS t FROM {source}) WHERE length(t) > 2 AND t NOT IN ({_list(K.STOPWORDS)}))"""


def _entities(key: str, c: str, source: str) -> str:
    places = ", ".join(f"('{p}')" for p in K.PLACES)
    return rf"""(SELECT {key}, unnest(regexp_extract_all({c}, '\b(\d+(?:[.,]\d+)?)\b', 1)) AS e FROM {source}
  UNION SELECT {key}, lower(w) FROM (SELECT {key}, unnest(p) AS w, generate_subscripts(p, 1) AS i FROM (SELECT {key}, list_filter(string_split_regex({c}, '{_S}+'), lambda x: x <> '') AS p FROM {source})) WHERE i > 1 AND length(w) > 3 AND regexp_matches(w, '^\p{{Lu}}') AND lower(w) NOT IN ({_list(K.STOPWORDS)})
  UNION SELECT {key}, p FROM {source}, (VALUES {places}) v(p) WHERE contains(lower({c}), p))"""


_PAIRS = f"""
cl AS (SELECT card_id AS ord, {_class("seccion")} AS class, titulo FROM cards),
tk AS (SELECT ord, t AS token FROM {_tokens("ord", "titulo", "cl")} WHERE t NOT IN ({_list(K.LOW_SIGNAL)})),
idf AS (SELECT token, count(*) AS df, ln(((SELECT count(*) FROM cards) + 1)::DOUBLE / (count(*) + 1)) + 1 AS idf FROM tk GROUP BY token),
big AS (SELECT ord FROM tk GROUP BY ord HAVING count(*) >= 4),
wt AS (SELECT ord, class, token, idf, sum(idf) OVER (PARTITION BY ord) AS w FROM tk JOIN big USING (ord) JOIN idf USING (token) JOIN cl USING (ord)),
sims AS (SELECT x.ord AS a, y.ord AS b, sum(x.idf) / least(min(x.w), min(y.w)) AS sim FROM wt x JOIN wt y ON x.token = y.token AND x.class = y.class AND x.ord < y.ord GROUP BY 1, 2),
ents AS (SELECT * FROM {_entities("ord", "titulo", "cl")}),
shared AS (SELECT a, b, count(*) AS k FROM sims JOIN ents x ON x.ord = a JOIN ents y ON y.ord = b AND x.e = y.e GROUP BY a, b),
pairs AS (SELECT a, b, sim, coalesce(k, 0) AS shared FROM sims LEFT JOIN shared USING (a, b) WHERE sim >= 0.40 OR sim >= 0.25 AND coalesce(k, 0) >= 2)"""

_LEADERS = f"""{_PAIRS},
nodes AS (SELECT ord, row_number() OVER (ORDER BY ord) AS rn FROM cl),
nb AS (SELECT b AS ord, list(a) AS l FROM pairs GROUP BY b),
step(rn, leaders) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT n.rn, CASE WHEN nb.l IS NOT NULL AND list_has_any(s.leaders, nb.l) THEN s.leaders ELSE list_append(s.leaders, n.ord) END FROM step s JOIN nodes n ON n.rn = s.rn + 1 LEFT JOIN nb USING (ord)),
led AS (SELECT unnest(leaders) AS l FROM step WHERE rn = (SELECT max(rn) FROM step)),
leaders AS (SELECT ord, CASE WHEN ord IN (SELECT l FROM led) THEN ord ELSE (SELECT min(a) FROM pairs p JOIN led ON l = a WHERE p.b = ord) END AS leader FROM cl)"""

_KNOWN = f"known AS (SELECT DISTINCT {_strip('url_original')} AS url FROM noticias WHERE {_strip('url_original')} <> '')"
_SLUG_PATH = r"regexp_replace(regexp_replace(coalesce({u}, ''), '^([a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*|[?#].*$', '', 'g'), '/+$', '')"


def _slug(u: str, t: str) -> str:
    base = f"coalesce(nullif(regexp_extract({_SLUG_PATH.format(u=u)}, '([^/]*)$', 1), ''), nullif({t}, ''), 'nota')"
    return f"coalesce(nullif(regexp_replace(regexp_replace(lower({base}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'nota')"


_DENY = " OR ".join(f"contains(lower({{u}}), '{p}')" for p in K.NOT_ARTICLES)
_MONTHS = "CASE lower({c}) " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in K.MONTHS) + " END"
_NAMES = "CASE {c} " + " ".join(f"WHEN {n} THEN '{k.capitalize()}'" for k, n in K.MONTHS if k != "setiembre") + " ELSE CAST({c} AS VARCHAR) END"
_NUM, _TXT = K.NUMERIC_DATE, K.WRITTEN_DATE


def _dates(key: str, c: str, source: str) -> str:
    """CTEs ending in dated(key, anio, mes)."""
    return rf"""
txt AS (SELECT {key}, {c} AS c, nullif(regexp_extract({c}, '{_TXT}', 0), '') AS t0, {_MONTHS.format(c=f"regexp_extract({c}, '{_TXT}', 2)")} AS tm, try_cast(regexp_extract({c}, '{_TXT}', 3) AS INTEGER) AS ty FROM {source}),
nums AS (SELECT {key}, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM (SELECT {key}, regexp_extract_all(c, '{_NUM}', 0) AS a FROM txt)),
good AS (SELECT {key}, x, i, CAST(regexp_extract(x, '{_NUM}', 2) AS INTEGER) AS nm, CAST(regexp_extract(x, '{_NUM}', 3) AS INTEGER) AS ny FROM nums WHERE CAST(regexp_extract(x, '{_NUM}', 1) AS INTEGER) BETWEEN 1 AND 31 AND CAST(regexp_extract(x, '{_NUM}', 2) AS INTEGER) BETWEEN 1 AND 12),
fst AS (SELECT DISTINCT ON ({key}) * FROM good ORDER BY {key}, i),
placed AS (SELECT txt.*, CASE WHEN tm IS NOT NULL THEN strpos(c, t0) END AS tat, strpos(c, x) AS nat, nm, CASE WHEN ny < 100 THEN ny + 2000 ELSE ny END AS ny, x FROM txt LEFT JOIN fst USING ({key})),
dated AS (SELECT {key}, CASE WHEN x IS NOT NULL AND (tat IS NULL OR nat < tat) THEN ny WHEN tat IS NOT NULL THEN ty END AS anio, CASE WHEN x IS NOT NULL AND (tat IS NULL OR nat < tat) THEN nm WHEN tat IS NOT NULL THEN tm END AS mes FROM placed)"""


_NOTICES = rf"""
raw AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL)),
ln AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM (SELECT doc_id, i, {_strip("line")} AS line FROM raw) WHERE line <> ''),
mk AS (SELECT *, regexp_matches(line, '^(Actualizado|Publicado)') AS t, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS name FROM ln),
st AS (SELECT doc_id, pos AS start, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS until, name FROM mk WHERE t),
bd AS (SELECT s.doc_id, s.start, min(s.name) AS nombre, string_agg(m.line, chr(10) ORDER BY m.pos) AS cuerpo FROM st s JOIN mk m ON m.doc_id = s.doc_id AND m.pos >= s.start AND m.pos < coalesce(s.until, 1000000000) WHERE s.start > 0 GROUP BY 1, 2),
keyed AS (SELECT *, doc_id || '-' || start AS k FROM bd),
{_dates("k", "cuerpo", "keyed").lstrip()},
notices AS (SELECT doc_id, CAST(start AS INTEGER) AS start, nombre, cuerpo, anio, mes FROM keyed JOIN dated USING (k) WHERE mes IS NOT NULL)"""

_LETTERS = "abcdefghijklmnopqrstuvwxyzáéíóúñ"

_OBITUARIES = """c AS (SELECT c_custkey, c_name, c_custkey % 12 + 1 AS k FROM customer),
o AS (SELECT c_custkey, 2 AS start, c_name AS nombre, 'Falleció el 3/' || k || '/24' || chr(10) || 'Casa de duelo en la avenida' AS cuerpo, 2024 AS anio, CAST(k AS INTEGER) AS mes FROM c
UNION ALL SELECT c_custkey, 5, 'Otro ' || c_name, 'fallecio el 5 de setiembre de 2023' || chr(10) || 'Sus restos descansan', 2023, 9 FROM c WHERE k > 6)"""

_COHERENT = rf"(SELECT id, unnest(string_split_regex(regexp_replace(lower(titulo), '[^a-záéíóúñ ]', '', 'g'), ' +')) AS w FROM n)"


def oracle_sql() -> dict[str, str]:
    as_of = "TIMESTAMPTZ '2026-01-15 00:00:00+00'"
    short = f"length(w) > 3 AND w NOT IN ({_list(K.SHORT_STOPWORDS)})"
    merged = """v AS (SELECT grupo_id, id, left(cuerpo, 2200) AS t, row_number() OVER (PARTITION BY grupo_id ORDER BY id) AS i FROM n WHERE grupo_id IS NOT NULL AND length(cuerpo) >= 60),
g AS (SELECT grupo_id, count(*) AS k, string_agg('[Versión ' || i || ']:' || chr(10) || t, chr(10) || chr(10) || '--- VERSIÓN SIGUIENTE ---' || chr(10) || chr(10) ORDER BY i) AS texto FROM v GROUP BY grupo_id)"""
    return {
        "lifecycle_stats": "SELECT count(*) FILTER (estado = 'publicada') AS publicadas, count(*) FILTER (estado = 'pendiente') AS pendientes, count(*) FILTER (estado = 'descartada') AS descartadas FROM noticias",
        "expire_rows": f"SELECT id, CASE WHEN estado IN ('pendiente', 'raw') AND created_at < {as_of} - INTERVAL 15 DAY THEN 'descartada' ELSE estado END AS estado FROM noticias",
        "discard_orphans": "SELECT id, CASE WHEN estado = 'pendiente' AND grupo_id IS NULL THEN 'descartada' ELSE estado END AS estado FROM noticias",
        "discard_siblings": "WITH c AS (SELECT grupo_id, min(id) AS chosen FROM noticias WHERE grupo_id IS NOT NULL GROUP BY grupo_id) SELECT n.id, CASE WHEN n.id <> chosen AND estado = 'raw' THEN 'descartada' ELSE estado END AS estado FROM noticias n LEFT JOIN c USING (grupo_id)",
        "front_page_swap": f"SELECT id, CASE WHEN id = (SELECT min(id) FROM noticias) THEN true WHEN fecha_publicacion >= {as_of} AND fecha_publicacion <= {as_of} + INTERVAL 86399 SECOND THEN false ELSE es_portada END AS es_portada FROM noticias",
        "publish_rows": "WITH t AS (SELECT DISTINCT id FROM noticias ORDER BY id LIMIT 3) SELECT id, CASE WHEN id IN (SELECT id FROM t) THEN 'publicada' ELSE estado END AS estado, CASE WHEN id IN (SELECT id FROM t) THEN '2026-01-15 00:00:00' ELSE strftime(fecha_publicacion AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') END AS fecha FROM noticias",
        "upsert_by_key": "SELECT coalesce(c_custkey, s_suppkey) AS c_custkey, coalesce(s_name, c_name) AS c_name, coalesce(s_nationkey, c_nationkey) AS c_nationkey, coalesce(s_acctbal, c_acctbal) AS c_acctbal, c_mktsegment FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey",
        "rewrite_update": f"WITH {_N} SELECT id, CASE WHEN estado = 'raw' THEN upper(titulo) ELSE titulo END AS titulo, CASE WHEN estado = 'raw' THEN 'resumen' ELSE resumen_seo END AS resumen_seo, fuente, CASE WHEN estado = 'raw' AND grupo_id IS NULL THEN 'Cultura' ELSE seccion END AS seccion, CASE WHEN estado = 'raw' THEN 'pendiente' ELSE estado END AS estado FROM n",
        "raw_insert": f"SELECT CAST(card_id AS VARCHAR) AS id, titulo, coalesce(seccion, 'Local') AS seccion, 'raw' AS estado, {_slug('url', 'titulo')} AS slug, '' AS resumen_seo, false AS es_portada FROM cards",
        "seed_config": "SELECT id, activo FROM scraper_config UNION ALL SELECT id, activo FROM (VALUES (1, false), (2, false)) v(id, activo) WHERE id NOT IN (SELECT id FROM scraper_config)",
        "last_k": f"WITH {_N} SELECT id, titulo FROM n ORDER BY created_at DESC, id LIMIT 5",
        "point_lookup": "SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey = 7",
        "group_lookup": f"WITH {_N} SELECT grupo_id, id, titulo FROM n WHERE grupo_id = (SELECT min(grupo_id) FROM noticias) AND estado = 'raw'",
        "in_list_lookup": "SELECT CAST(place AS INTEGER) AS place, p_partkey, p_name FROM part JOIN (VALUES (5, 0), (3, 1), (11, 2), (3000000, 3)) v(k, place) ON p_partkey = k",
        "active_source_union": f"WITH {_N}, act AS (SELECT clave, {_strip('lower(nombre)')} AS f FROM fuentes WHERE clave IN (SELECT unnest(fuentes_activas) FROM scraper_config WHERE id = 1) OR (SELECT coalesce(len(fuentes_activas), 0) FROM scraper_config WHERE id = 1) = 0), every AS (SELECT fuente FROM cards UNION ALL SELECT fuente FROM n) SELECT clave, count(*) AS notas FROM every JOIN act ON {_strip('lower(fuente)')} = f GROUP BY clave",
        "run_gate": f"SELECT coalesce(activo, true) AND coalesce(fecha_inicio <= {as_of}, true) AS may_run FROM scraper_config WHERE id = 1",
        "known_url_anti": f"WITH {_KNOWN}, u AS (SELECT card_id, lote, url FROM cards WHERE length(titulo) >= 8 AND url <> '' AND NOT ({_DENY.format(u='url')}) AND url NOT IN (SELECT url FROM known)), r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY lote, card_id) AS k FROM u) SELECT card_id, url FROM r WHERE k = 1",
        "url_slug": f"WITH {_N} SELECT id, {_slug('url_original', 'titulo')} AS slug FROM n",
        "url_domain": rf"WITH {_N} SELECT id, regexp_replace(lower(regexp_extract(coalesce(url_original, ''), '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1)), '^www\.', '') AS domain FROM n",
        "url_denylist": f"WITH {_N} SELECT id, url_original FROM n WHERE url_original IS NOT NULL AND NOT ({_DENY.format(u='url_original')})",
        "section_normalize": f"WITH {_N}, s AS (SELECT id, {_section('seccion')} AS section FROM n) SELECT id, section, {_class('section')} AS class FROM s",
        "title_tokens": f"WITH {_N} SELECT id, coalesce(tokens, '') AS tokens FROM n LEFT JOIN (SELECT id, string_agg(t, ' ' ORDER BY t) AS tokens FROM {_tokens('id', 'titulo', 'n')} GROUP BY id) USING (id)",
        "title_entities": f"WITH {_N} SELECT id, coalesce(entities, '') AS entities FROM n LEFT JOIN (SELECT id, string_agg(e, ' ' ORDER BY e) AS entities FROM {_entities('id', 'titulo', 'n')} GROUP BY id) USING (id)",
        "query_terms": f"WITH {_N}, p AS (SELECT id, list_filter(string_split_regex(regexp_replace(lower(titulo), '[^a-záéíóúñ ]', '', 'g'), ' +'), lambda w: {short}) AS l FROM n) SELECT id, CASE WHEN len(l) > 0 THEN array_to_string(l[1:3], ' ') END AS terms FROM p",
        "token_idf": f"WITH {_PAIRS} SELECT token, df, round(idf, 6) AS idf FROM idf",
        "similar_pairs": f"WITH {_PAIRS} SELECT a, b, round(sim, 6) AS sim, CAST(shared AS INTEGER) AS shared FROM pairs",
        "leader_clusters": f"WITH RECURSIVE {_LEADERS} SELECT ord, leader FROM leaders",
        "group_limit": f"WITH RECURSIVE {_LEADERS}, {_KNOWN}, f AS (SELECT DISTINCT leader FROM leaders ORDER BY leader LIMIT 12), m AS (SELECT leader, leaders.ord, url FROM leaders JOIN f USING (leader) JOIN cards ON card_id = leaders.ord) SELECT leader, ord, url FROM m WHERE leader IN (SELECT leader FROM m WHERE url <> '' AND url NOT IN (SELECT url FROM known))",
        "stored_once": f"WITH {_N}, r AS (SELECT id, url_original AS url, row_number() OVER (PARTITION BY url_original ORDER BY created_at NULLS FIRST, id) AS k FROM n WHERE url_original IS NOT NULL AND length(cuerpo) >= 60) SELECT id, url FROM r WHERE k = 1",
        "source_list": f"WITH {_N} SELECT grupo_id, min(id) AS lider, coalesce(string_agg(DISTINCT fuente, ', ' ORDER BY fuente) FILTER (fuente <> ''), '') AS fuentes, CAST(count(*) FILTER (url_original <> '') AS INTEGER) AS direcciones FROM n WHERE grupo_id IS NOT NULL GROUP BY grupo_id",
        "versions_concat": f"WITH {_N}, {merged} SELECT grupo_id, CAST(coalesce(k, 0) AS INTEGER) AS versiones, coalesce(texto, '') AS texto FROM (SELECT DISTINCT grupo_id FROM n WHERE grupo_id IS NOT NULL) LEFT JOIN g USING (grupo_id)",
        "prompts": f"WITH {_N.replace('*', "* REPLACE (coalesce(titulo, '') AS titulo, coalesce(seccion, '') AS seccion, coalesce(cuerpo, '') AS cuerpo)")} SELECT id, 'Sección: ' || seccion || chr(10) || 'Título original: ' || titulo || chr(10) || CASE WHEN coalesce(fuente, '') <> '' THEN 'Fuente original (para atribución opcional, no la copies textualmente): ' || fuente || chr(10) ELSE '' END || 'Cuerpo original:' || chr(10) || CASE WHEN length(cuerpo) > 4500 THEN left(cuerpo, 4500) || '...' ELSE cuerpo END || chr(10) AS prompt FROM n",
        "image_paths": rf"WITH {_N}, e AS (SELECT id, imagen_url, regexp_extract(imagen_url, '\.([a-z]+)$', 1) AS x FROM n) SELECT id, CASE WHEN starts_with(imagen_url, 'http') THEN 'noticias/' || id || '.' || CASE WHEN x IN ('png', 'webp', 'gif') THEN x ELSE 'jpg' END END AS path FROM e",
        "image_choice": f"WITH {_N} SELECT id, coalesce(nullif(imagen_url, ''), nullif(url_original, ''), 'none') AS image FROM n",
        "coherence": f"WITH {_N}, w AS (SELECT id, w FROM {_COHERENT} WHERE {short}), c AS (SELECT id, count(*) AS k, count(*) FILTER (contains(lower(cuerpo), w)) AS hit FROM w JOIN n USING (id) GROUP BY id) SELECT id, CASE WHEN coalesce(cuerpo, '') = '' OR k IS NULL THEN true ELSE hit / k >= 0.2 END AS coherent FROM n LEFT JOIN c USING (id)",
        "group_ids": f"WITH {_N}, h AS (SELECT id, md5(coalesce(url_original, '')) AS m FROM n) SELECT id, m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:32] AS group_id FROM h",
        "masks": "SELECT p_partkey, CASE WHEN coalesce(p_name, '') = '' THEN '(VACÍO)' WHEN length(p_name) <= 6 THEN left(p_name, 2) || '***' ELSE left(p_name, 4) || '...' || right(p_name, 4) END AS masked FROM part",
        "message_actions": f"""WITH {_N}, x AS (SELECT id AS k, ascii(right(id, 1)) % 13 AS i, coalesce(seccion, '') AS r FROM n UNION ALL SELECT CAST(card_id AS VARCHAR), card_id % 13, coalesce(seccion, '') FROM cards),
p AS (SELECT k, i, r, CASE WHEN i IN (0, 1, 2, 9) THEN true WHEN i < 12 THEN false END AS paired FROM x)
SELECT k, ['toggle', 'img', 'sec_grupo_set', 'sec_grupo_volver', 'sec_grupo', 'procesar', 'des_grupo', 'sec_menu', 'sec_volver', 'sec', 'pub', 'des', NULL][i + 1] AS action, CASE WHEN paired THEN k WHEN NOT paired THEN k || '_' || r END AS head, CASE WHEN paired THEN r WHEN NOT paired THEN '' END AS tail FROM p""",
        "message_sections": f"""WITH {_N} SELECT id, coalesce(nullif({_strip("regexp_extract(coalesce(titulo, ''), '^.*', 0)")}, ''), '(Noticia)') AS title, left('Título: ' || coalesce(titulo, '') || chr(10) || '📂 Sección: ' || coalesce(seccion, 'General') || chr(10) || regexp_replace(coalesce(cuerpo, ''), '📂 Sección: [^\n]*', '📂 Sección: ' || coalesce(seccion, 'General'), 'g'), 4096) AS message FROM n""",
        "group_prompts": f"""WITH {_N}, {merged}, l AS (SELECT grupo_id, min(id) AS lider, string_agg(DISTINCT fuente, ', ' ORDER BY fuente) FILTER (fuente <> '') AS f FROM n WHERE grupo_id IS NOT NULL GROUP BY grupo_id)
SELECT l.grupo_id, 'Sección: ' || coalesce(n.seccion, '') || chr(10) || 'Título referencial: ' || coalesce(n.titulo, '') || chr(10) || 'Cantidad de fuentes: ' || coalesce(k, 0) || chr(10) || coalesce('Medios de origen (para atribución opcional, no los copies textualmente): ' || f || chr(10), '') || chr(10) || 'A continuación las ' || coalesce(k, 0) || ' versiones del mismo hecho:' || chr(10) || chr(10) || coalesce(texto, '') || chr(10) AS prompt
FROM l JOIN n ON n.id = l.lider LEFT JOIN g ON g.grupo_id = l.grupo_id""",
        "image_checks": "SELECT card_id, CASE WHEN card_id % 6 NOT IN (1, 2, 5) AND starts_with(imagen_url, 'http') THEN 'noticias/' || card_id || '.' || CASE card_id % 6 WHEN 3 THEN 'jpg' WHEN 4 THEN 'webp' ELSE 'png' END END AS path FROM cards",
        "json_texts": r"""WITH t AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN props WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 2 THEN 'Va: ' || props || ' fin' WHEN 3 THEN translate(props, '"', chr(39)) WHEN 4 THEN props || ' x ' || props WHEN 5 THEN '{"publicar": false, "event": ' || event_id || '}' WHEN 6 THEN '{"publicar": "false"}' ELSE left(props, length(props) - 1) END AS c FROM events),
u AS (SELECT *, trim(regexp_replace(c, '^```json|```$', '', 'g'), chr(10) || ' ') AS bare FROM t), v AS (SELECT *, regexp_extract(bare, '(?s)\{.*\}', 0) AS braces FROM u),
o AS (SELECT event_id, CASE WHEN json_valid(c) THEN c WHEN json_valid(bare) THEN bare WHEN json_valid(braces) THEN braces END AS object FROM v) SELECT event_id, object, coalesce(json_type(object, '$.publicar') = 'BOOLEAN' AND json_extract_string(object, '$.publicar') = 'false', false) AS rejected FROM o""",
        "page_extraction": rf"""WITH {_N}, t AS (SELECT id, ascii(right(id, 1)) % 6 AS k, trim(regexp_replace(lower(coalesce(titulo, '')), '[^{_LETTERS}]+', ' ', 'g')) AS t FROM n),
p AS (SELECT *, 'Primera parte de la nota sobre ' || t || ', con detalle.' AS a, 'Segunda parte de la nota sobre ' || t || ', con detalle.' AS b FROM t)
SELECT id, CASE k WHEN 4 THEN 'Una descripción que supera en largo al texto de la página, sobre ' || t || '.' || chr(10) || chr(10) || 'Un encabezado largo' WHEN 5 THEN a || chr(10) || chr(10) || a ELSE a || chr(10) || chr(10) || b END AS text,
CASE k WHEN 0 THEN 'https://s.example/og-' || id || '.jpg' WHEN 1 THEN 'http://s.example/tw.jpg' WHEN 5 THEN 'https://www.propio.example/c.gif' ELSE '' END AS image, CASE WHEN t <> '' THEN t WHEN k = 4 THEN 'Un encabezado largo' ELSE '' END AS title FROM p""",
        "home_page_cards": rf"""WITH t AS (SELECT card_id, card_id || trim(' ' || regexp_replace(lower(coalesce(titulo, '')), '[^{_LETTERS}]+', ' ', 'g')) AS x, trim('Nota ' || card_id || ' ' || trim(regexp_replace(lower(coalesce(titulo, '')), '[^{_LETTERS}]+', ' ', 'g'))) AS t FROM cards)
SELECT * FROM (SELECT card_id, 0 AS pos, t AS titulo, CASE WHEN card_id % 2 = 1 THEN 'https://www.propio.example/n/' ELSE 'https://s.example/n/' END || card_id AS url, CASE WHEN card_id % 2 = 1 THEN 'https://www.propio.example/i.png' ELSE 'https://s.example/i.jpg' END AS imagen_url, CASE WHEN card_id % 2 = 1 THEN 'Campo' ELSE 'Salud' END AS seccion FROM t
UNION ALL SELECT card_id, 1, 'Otra ' || t, 'https://o.example/' || card_id, NULL, 'General' FROM t WHERE card_id % 2 = 0) WHERE length(titulo) >= 8""",
        "pharmacy_shifts": rf"""WITH t AS (SELECT p_partkey, trim(regexp_replace(lower(coalesce(p_name, '')), '[^{_LETTERS}]+', ' ', 'g')) AS t FROM part),
raw AS (SELECT *, p_partkey % 3 <> 0 AS long, length('Farmacias' || 'Turnos del mes de mayo' || 'Atención de 8 a 20 en toda la ciudad' || '1' || t || 'Centro' || '2') + 5 + CASE WHEN t <> '' THEN 1 ELSE 0 END AS n FROM t)
SELECT p_partkey, 'Farmacias' || chr(10) || chr(10) || '## Turnos del mes de mayo' || chr(10) || chr(10) || 'Atención de 8 a 20 en toda la ciudad' || chr(10) || chr(10) || '### Día 1' || chr(10) || chr(10) || CASE WHEN t <> '' THEN t || ' · ' ELSE '' END || 'Centro' || chr(10) || chr(10) || '### Día 2' || chr(10) || chr(10) || CASE WHEN long THEN 'Mitre y la costa · Mitre y la costa · Mitre y la costa · Mitre y la costa' ELSE '' END AS cuerpo
FROM raw WHERE n + CASE WHEN long THEN 68 ELSE 0 END >= 100""",
        "obituaries": f"WITH {_OBITUARIES} SELECT * FROM o",
        "obituaries_by_month": f"WITH {_OBITUARIES} SELECT anio, mes, count(*) AS cantidad, printf('%d-%02d', anio, mes) AS slug FROM o GROUP BY anio, mes",
        "discard_counts": f"SELECT count(*) FILTER (estado = 'pendiente' AND grupo_id IS NULL) AS huerfanas, count(*) FILTER (estado = 'pendiente' AND created_at < {as_of} - INTERVAL 15 DAY) AS pendientes_viejas, count(*) FILTER (estado = 'raw' AND created_at < {as_of} - INTERVAL 15 DAY) AS raw_viejas FROM noticias",
        "pending_insert": f"SELECT CAST(card_id AS VARCHAR) AS id, {_strip("coalesce(titulo, '')")} AS titulo, {_strip("coalesce(titulo, '')")} AS cuerpo, CASE WHEN card_id % 2 = 0 THEN 'un-slug' ELSE '' END AS slug, coalesce(seccion, 'General') AS seccion, 'pendiente' AS estado, false AS es_portada, imagen_url FROM cards",
        "picture_update": "SELECT id, CASE WHEN coalesce(imagen_url, '') = '' THEN 'https://i.example/' || id ELSE imagen_url END AS imagen_url, CASE WHEN coalesce(imagen_url, '') = '' THEN 'archivo' ELSE imagen_fuente END AS imagen_fuente FROM noticias",
        "section_update": "SELECT id, CASE WHEN estado = 'pendiente' THEN 'Cultura' ELSE seccion END AS seccion FROM noticias",
        "upsert_repeated": "WITH n AS (SELECT fuente AS slug, id, min(titulo) AS titulo FROM noticias WHERE fuente IS NOT NULL GROUP BY 1, 2), d AS (SELECT nombre AS slug, clave AS titulo FROM fuentes UNION ALL SELECT r_name, 'nueva' FROM region), r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY id) AS k FROM n) SELECT coalesce(r.slug, d.slug) AS slug, id, CASE WHEN d.slug IS NOT NULL AND coalesce(k, 1) = 1 THEN d.titulo ELSE r.titulo END AS titulo FROM r FULL OUTER JOIN d ON r.slug = d.slug",
        "single_lookup": "SELECT id, min(titulo) AS titulo, min(estado) AS estado, min(seccion) AS seccion FROM noticias GROUP BY id HAVING count(*) = 1",
        "gate_texts": "SELECT card_id, card_id % 7 <> 0 AND card_id % 5 <> 1 AS may_run, CASE card_id % 5 WHEN 0 THEN '14/01/2026' WHEN 1 THEN '14/01/2026' END AS dia FROM cards",
        "source_pairs": f"WITH {_N} SELECT grupo_id, CAST(row_number() OVER (PARTITION BY grupo_id ORDER BY id) - 1 AS INTEGER) AS pos, coalesce(fuente, '') AS fuente, url_original AS url FROM n WHERE grupo_id IS NOT NULL AND url_original <> ''",
        "line_segments": f"WITH {_NOTICES} SELECT doc_id, start, nombre, cuerpo, anio, mes FROM notices",
        "month_rollup": f"WITH {_NOTICES} SELECT anio, mes, {_NAMES.format(c='mes')} AS mes_nombre, count(*) AS cantidad, string_agg('### ' || nombre || chr(10) || chr(10) || cuerpo, chr(10) || chr(10) ORDER BY doc_id, start) AS contenido, printf('%d-%02d', anio, mes) AS slug FROM notices GROUP BY anio, mes",
        "shift_table": f"""WITH raw AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL)),
lg AS (SELECT doc_id, string_agg(line, ' · ' ORDER BY i) AS legend FROM (SELECT doc_id, i, {_strip("line")} AS line FROM raw) WHERE line <> '' GROUP BY doc_id)
SELECT doc_id, 'Farmacias' || chr(10) || chr(10) || '## Turnos del mes de mayo' || coalesce(chr(10) || chr(10) || legend, '') || chr(10) || chr(10) || '### Día 1' || chr(10) || chr(10) || 'Belgrano · Centro' || chr(10) || chr(10) || '### Día 2' || chr(10) || chr(10) || 'Mitre' AS cuerpo
FROM (SELECT doc_id FROM documents WHERE text IS NOT NULL) LEFT JOIN lg USING (doc_id)""",
        "first_dates": f"WITH {_dates('doc_id', 'text', 'documents').lstrip()} SELECT doc_id, anio, mes FROM dated",
        "json_required": "SELECT event_id, CASE WHEN props IS NOT NULL THEN true END AS fenced, CASE WHEN props IS NOT NULL THEN true END AS embedded, CASE WHEN props IS NOT NULL THEN CASE WHEN json_exists(props, '$.k') THEN 'titulo' ELSE 'k,titulo' END END AS missing FROM events",
        "stream_dedup": "SELECT DISTINCT url FROM cards WHERE url IS NOT NULL",
    }
