"""Queries of the engine's own operators over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gacetilla.functions import dates, html, json as J, text as T
from gacetilla.operators import cluster, ingest, lifecycle, services
from gacetilla.plans import sql
from gacetilla.sources import tables as S
from gacetilla.streaming.ingest import append_unseen, landed_stream

Query = Callable[[SparkSession, str], DataFrame]

#: The moment at which the queries run; never the clock.
AS_OF = "2026-01-15 00:00:00"


def _notes(spark: SparkSession, folder: str) -> DataFrame:
    return S.table(spark, folder, "noticias").dropDuplicates(["id"])


def _cards(spark: SparkSession, folder: str) -> DataFrame:
    return S.table(spark, folder, "cards").withColumn("ord", F.col("card_id"))


def _as_of() -> F.Column:
    return F.to_timestamp(F.lit(AS_OF))


def _words(c: F.Column) -> F.Column:
    return F.array_join(F.array_sort(c), " ")


def lifecycle_stats(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.state_counts(S.table(spark, folder, "noticias"))


def expire_rows(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.expired(S.table(spark, folder, "noticias"), _as_of()).select("id", "estado")


def discard_orphans(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.orphans_discarded(S.table(spark, folder, "noticias")).select("id", "estado")


def discard_siblings(spark: SparkSession, folder: str) -> DataFrame:
    notes = S.table(spark, folder, "noticias")
    chosen = notes.where("grupo_id is not null").groupBy("grupo_id").agg(F.min("id").alias("id"))
    return lifecycle.siblings_discarded(notes, chosen).select("id", "estado")


def front_page_swap(spark: SparkSession, folder: str) -> DataFrame:
    notes = S.table(spark, folder, "noticias")
    first = notes.agg(F.min("id").alias("id")).first()["id"]
    return lifecycle.front_page(notes, first, _as_of()).select("id", "es_portada")


def publish_rows(spark: SparkSession, folder: str) -> DataFrame:
    notes = S.table(spark, folder, "noticias")
    ids = [r["id"] for r in notes.select("id").distinct().orderBy("id").limit(3).collect()]
    return lifecycle.published(notes, ids, "publicada", _as_of()).select("id", "estado", F.date_format("fecha_publicacion", "yyyy-MM-dd HH:mm:ss").alias("fecha"))


def upsert_by_key(spark: SparkSession, folder: str) -> DataFrame:
    customer = S.table(spark, folder, "customer")
    delta = S.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"))
    return lifecycle.upserted(customer, delta, "c_custkey", ["c_name", "c_nationkey", "c_acctbal"], ["c_custkey"])


def rewrite_update(spark: SparkSession, folder: str) -> DataFrame:
    notes = _notes(spark, folder)
    answers = notes.where("estado = 'raw'").select("id", F.upper("titulo").alias("titulo"), F.lit("resumen").alias("resumen_seo"), F.lit("").alias("fuente"), F.array().cast("array<struct<fuente:string,url:string>>").alias("fuentes_urls"), F.when(F.col("grupo_id").isNull(), "Cultura").alias("seccion_sugerida"))
    return lifecycle.rewritten(notes, answers, ["titulo", "resumen_seo"], ["fuente", "fuentes_urls"]).select("id", "titulo", "resumen_seo", "fuente", "seccion", "estado")


def raw_insert(spark: SparkSession, folder: str) -> DataFrame:
    cards = _cards(spark, folder)
    rows = cards.select(F.col("card_id").cast("string").alias("id"), F.col("titulo").alias("titulo_original"), F.lit("texto").alias("cuerpo"), "seccion", "fuente", F.col("url").alias("url_original"), "imagen_url", T.url_slug(F.col("url"), F.col("titulo")).alias("slug"), F.lit(None).cast("string").alias("grupo_id"))
    return lifecycle.raw_rows(rows).select("id", "titulo", "seccion", "estado", "slug", "resumen_seo", "es_portada")


def seed_config(spark: SparkSession, folder: str) -> DataFrame:
    config = S.table(spark, folder, "scraper_config").select("id", "activo")
    return lifecycle.seeded(config, spark.createDataFrame([(1, False), (2, False)], "id int, activo boolean"), "id")


def last_k(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.last_rows(_notes(spark, folder), 5, "created_at", "id").select("id", "titulo")


def point_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return S.table(spark, folder, "part").where("p_partkey = 7").select("p_partkey", "p_name", "p_brand")


def group_lookup(spark: SparkSession, folder: str) -> DataFrame:
    notes = _notes(spark, folder)
    group = notes.agg(F.min("grupo_id").alias("grupo_id"))
    return notes.join(F.broadcast(group), "grupo_id").where("estado = 'raw'").select("grupo_id", "id", "titulo")


def in_list_lookup(spark: SparkSession, folder: str) -> DataFrame:
    part = S.table(spark, folder, "part").withColumn("id", F.col("p_partkey").cast("string"))
    return S.by_ids(part, ["5", "3", "11", "3000000"], ["p_partkey", "p_name"])


def active_source_union(spark: SparkSession, folder: str) -> DataFrame:
    config = S.table(spark, folder, "scraper_config")
    active = S.active_sources(S.table(spark, folder, "fuentes"), config).select(T.strip(F.lower("nombre")).alias("f"), "clave")
    notes = _notes(spark, folder).select(F.col("titulo"), F.col("url_original").alias("url"), "fuente")
    both = S.union_sources([_cards(spark, folder).select("titulo", "url", "fuente"), notes])
    return both.withColumn("f", T.strip(F.lower("fuente"))).join(active, "f").groupBy("clave").agg(F.count("*").alias("notas"))


def run_gate(spark: SparkSession, folder: str) -> DataFrame:
    return S.may_run(S.table(spark, folder, "scraper_config"), _as_of())


def known_url_anti(spark: SparkSession, folder: str) -> DataFrame:
    cards = ingest.usable_cards(_cards(spark, folder))
    return ingest.unseen(cards, S.known_urls(S.table(spark, folder, "noticias")), ["lote", "card_id"]).select("card_id", "url")


def url_slug(spark: SparkSession, folder: str) -> DataFrame:
    return _notes(spark, folder).select("id", T.url_slug(F.col("url_original"), F.col("titulo")).alias("slug"))


def url_domain(spark: SparkSession, folder: str) -> DataFrame:
    return _notes(spark, folder).select("id", T.url_domain(F.col("url_original")).alias("domain"))


def url_denylist(spark: SparkSession, folder: str) -> DataFrame:
    return _notes(spark, folder).where(T.is_article_url(F.col("url_original"))).select("id", "url_original")


def section_normalize(spark: SparkSession, folder: str) -> DataFrame:
    section = T.section_of(F.col("seccion"))
    return _notes(spark, folder).select("id", section.alias("section"), T.section_class(section).alias("class"))


def title_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return _notes(spark, folder).select("id", _words(T.title_tokens(F.col("titulo"))).alias("tokens"))


def title_entities(spark: SparkSession, folder: str) -> DataFrame:
    return _notes(spark, folder).select("id", _words(T.title_entities(F.col("titulo"))).alias("entities"))


def query_terms(spark: SparkSession, folder: str) -> DataFrame:
    return _notes(spark, folder).select("id", T.query_terms(F.col("titulo")).alias("terms"))


def token_idf(spark: SparkSession, folder: str) -> DataFrame:
    return cluster.token_idf(cluster.prepared(_cards(spark, folder))).select("token", "df", F.round("idf", 6).alias("idf"))


def similar_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return cluster.similar_pairs(cluster.prepared(_cards(spark, folder))).select("a", "b", F.round("sim", 6).alias("sim"), "shared")


def leader_clusters(spark: SparkSession, folder: str) -> DataFrame:
    ready = cluster.prepared(_cards(spark, folder))
    return cluster.leader_clusters(ready, cluster.similar_pairs(ready))


def group_limit(spark: SparkSession, folder: str) -> DataFrame:
    cards = _cards(spark, folder)
    ready = cluster.prepared(cards)
    members = cluster.leader_clusters(ready, cluster.similar_pairs(ready)).join(cards.select("ord", "url"), "ord")
    return ingest.first_groups(members, S.known_urls(S.table(spark, folder, "noticias")))


def stored_once(spark: SparkSession, folder: str) -> DataFrame:
    notes = _notes(spark, folder).select("id", F.col("url_original").alias("url"), "cuerpo", "created_at").where("url is not null")
    return ingest.stored_once(notes, ["created_at", "id"]).select("id", "url")


def source_list(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.merged_group(_notes(spark, folder).where("grupo_id is not null"), "grupo_id", "id").select("grupo_id", "lider", "fuentes", F.size("fuentes_urls").alias("direcciones"))


def versions_concat(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.merged_group(_notes(spark, folder).where("grupo_id is not null"), "grupo_id", "id").select("grupo_id", "versiones", "texto")


def prompts(spark: SparkSession, folder: str) -> DataFrame:
    return _notes(spark, folder).select("id", ingest.prompt(F.col("titulo"), F.col("seccion"), F.col("cuerpo"), F.col("fuente")).alias("prompt"))


def image_paths(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.concat(F.lit("image/"), F.regexp_extract("imagen_url", r"\.([a-z]+)$", 1))
    return _notes(spark, folder).select("id", T.image_path(F.col("id"), F.col("imagen_url"), F.lit(200), kind, F.lit(5_000_000)).alias("path"))


def group_prompts(spark: SparkSession, folder: str) -> DataFrame:
    notes = _notes(spark, folder).where("grupo_id is not null")
    groups = ingest.merged_group(notes, "grupo_id", "id")
    leaders = notes.select(F.col("id").alias("lider"), "titulo", "seccion")
    return groups.join(leaders, "lider").select("grupo_id", ingest.group_prompt(F.col("titulo"), F.col("seccion"), F.col("versiones"), F.col("texto"), F.col("fuentes")).alias("prompt"))


def image_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Every reason to reject a picture, by the card's number."""
    k = F.pmod("card_id", F.lit(6))
    status = F.when(k == 1, 404).otherwise(200)
    kind = F.when(k == 2, "text/html").when(k == 3, "image/bmp").when(k == 4, "image/webp").otherwise("image/png")
    size = F.when(k == 5, 5_000_001).otherwise(5_000_000)
    cards = _cards(spark, folder)
    return cards.select("card_id", T.image_path(F.col("card_id").cast("string"), F.col("imagen_url"), status, kind, size).alias("path"))


def image_choice(spark: SparkSession, folder: str) -> DataFrame:
    return _notes(spark, folder).select("id", ingest.best_image(F.col("imagen_url"), F.col("url_original"), F.lit("none")).alias("image"))


def coherence(spark: SparkSession, folder: str) -> DataFrame:
    return _notes(spark, folder).select("id", T.is_coherent(F.col("titulo"), F.col("cuerpo")).alias("coherent"))


def group_ids(spark: SparkSession, folder: str) -> DataFrame:
    return _notes(spark, folder).select("id", T.group_id(F.col("url_original")).alias("group_id"))


def masks(spark: SparkSession, folder: str) -> DataFrame:
    return S.table(spark, folder, "part").select("p_partkey", T.masked(F.col("p_name")).alias("masked"))


_PREFIXES = [p for p, _ in T.ACTIONS] + ["otra_"]


def message_actions(spark: SparkSession, folder: str) -> DataFrame:
    """All prefixes and an unknown one, by turns, with a note's id or a card's number and a rest."""
    notes = _notes(spark, folder).select(F.col("id").alias("k"), F.pmod(F.ascii(F.right("id", F.lit(1))), F.lit(len(_PREFIXES))).alias("i"), F.coalesce("seccion", F.lit("")).alias("rest"))
    cards = _cards(spark, folder).select(F.col("card_id").cast("string").alias("k"), F.pmod("card_id", F.lit(len(_PREFIXES))).cast("int").alias("i"), F.coalesce("seccion", F.lit("")).alias("rest"))
    prefix = F.element_at(T.strings(_PREFIXES), F.col("i") + 1)
    both = notes.unionByName(cards).withColumn("p", T.parse_action(F.concat(prefix, F.col("k"), F.lit("_"), F.col("rest"))))
    return both.select("k", "p.action", "p.head", "p.tail")


def message_sections(spark: SparkSession, folder: str) -> DataFrame:
    message = F.concat(F.lit("Título: "), F.coalesce("titulo", F.lit("")), F.lit("\n📂 Sección: Local\n"), F.coalesce("cuerpo", F.lit("")))
    return _notes(spark, folder).select("id", T.message_title(message).alias("title"), T.message_section(message, F.coalesce("seccion", F.lit("General"))).alias("message"))


def _notices(spark: SparkSession, folder: str) -> DataFrame:
    return services.notices(S.table(spark, folder, "documents"), "doc_id", "text", trigger=r"^(Actualizado|Publicado)")


def line_segments(spark: SparkSession, folder: str) -> DataFrame:
    return _notices(spark, folder)


def month_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return services.by_month(_notices(spark, folder), ["doc_id", "start"])


def shift_table(spark: SparkSession, folder: str) -> DataFrame:
    docs = S.table(spark, folder, "documents").where("text is not null").select("doc_id", F.concat(F.lit("Farmacias\nTurnos del mes de mayo\n"), "text", F.lit("\n1\nBelgrano\nCentro\n2\nMitre")).alias("raw"))
    return services.shift_table(docs, "doc_id", "raw")


def first_dates(spark: SparkSession, folder: str) -> DataFrame:
    d = dates.first_date(F.col("text"))
    return S.table(spark, folder, "documents").select("doc_id", d.alias("d")).select("doc_id", "d.anio", "d.mes")


def json_required(spark: SparkSession, folder: str) -> DataFrame:
    fence = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    prose = F.concat(F.lit("Respuesta: "), "props", F.lit(" Fin."))
    e = S.table(spark, folder, "events").select("event_id", J.json_object(F.col("props")).alias("a"), J.json_object(fence).alias("b"), J.json_object(prose).alias("c"), F.array_join(J.missing_fields(F.col("props"), ["k", "titulo"]), ",").alias("missing"))
    return e.select("event_id", (F.col("a") == F.col("b")).alias("fenced"), (F.col("a") == F.col("c")).alias("embedded"), "missing")


def json_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Clean, fenced, embedded, single-quoted, trailing, broken and rejecting texts, by turns."""
    props, k = F.col("props"), F.pmod("event_id", F.lit(8))
    text = (
        F.when(k == 0, props).when(k == 1, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Va: "), props, F.lit(" fin"))).when(k == 3, F.translate(props, '"', "'"))
        .when(k == 4, F.concat(props, F.lit(" x "), props)).when(k == 5, F.concat(F.lit('{"publicar": false, "event": '), F.col("event_id"), F.lit("}"))).when(k == 6, F.lit('{"publicar": "false"}')).otherwise(F.left(props, F.char_length(props) - 1))
    )
    return S.table(spark, folder, "events").select("event_id", J.json_object(text).alias("object"), J.is_rejected(J.json_object(text)).alias("rejected"))


_LETTERS = "abcdefghijklmnopqrstuvwxyzáéíóúñ"


def _plain(c: str) -> F.Column:
    """Letters of a text only, in lower case, for pages made of it."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"[^{_LETTERS}]+", " "))


def page_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Articles from pages of every kind, made of the notes: pictures in the head or the content, unclosed paragraphs, lists, loose
    lines, short texts with a description, and a site with selectors of its own."""
    n = _notes(spark, folder).select("id", F.pmod(F.ascii(F.right("id", F.lit(1))), F.lit(6)).alias("k"), _plain("titulo").alias("t"))
    a, b = F.concat(F.lit("Primera parte de la nota sobre "), F.col("t"), F.lit(", con detalle.")), F.concat(F.lit("Segunda parte de la nota sobre "), F.col("t"), F.lit(", con detalle."))
    lit = F.lit
    head = (
        F.when(F.col("k") == 0, F.concat(lit('<meta property="og:image" content="https://s.example/og-'), F.col("id"), lit('.jpg">'))).when(F.col("k") == 1, lit('<meta property="og:image" content="/x.jpg"><meta name="twitter:image" content="http://s.example/tw.jpg">'))
        .when(F.col("k") == 4, F.concat(lit('<meta name="description" content="Una descripción que supera en largo al texto de la página, sobre '), F.col("t"), lit('.">'))).otherwise("")
    )
    body = (
        F.when(F.col("k") == 0, F.concat(lit("<article><p>"), a, lit("<p>"), b, lit("<p>corto</article>")))
        .when(F.col("k") == 1, F.concat(lit('<article><img src="data:x"><img src="a.png" width="199"><img data-src="b.png" width="200"><p>'), a, lit("</p><aside><p>"), b, lit("</p></aside><p>"), b, lit("</p></article>")))
        .when(F.col("k") == 2, F.concat(lit("<article><p>"), a, lit("</p><ul><li>"), b, lit("<li>corto</ul></article>")))
        .when(F.col("k") == 3, F.concat(lit("<article><div>"), a, lit("<br>"), b, lit("<br>corto</div></article>")))
        .when(F.col("k") == 4, lit("<h1>Un encabezado largo</h1><article><p>corto</p></article>"))
        .otherwise(F.concat(lit('<article><p>'), b, lit('</p></article><div class="nota"><img src="/c.gif" width="auto"><p>'), a, lit("</p><p>"), a, lit("</p></div>")))
    )
    host = F.when(F.col("k") == 5, "www.propio.example").otherwise("s.example")
    pages = n.select("id", F.concat(lit("https://"), host, lit("/n/"), F.col("id")).alias("url"), F.concat(lit("<html><head><title>"), F.col("t"), lit("</title>"), head, lit("</head><body><nav><p>Una línea de navegación bastante larga para contar</p></nav>"), body, lit("</body></html>")).alias("html"))
    sites = spark.createDataFrame([("propio.example", ["div.nota"])], "dominio string, content array<string>")
    return S.with_site(pages, sites).select("id", html.article(F.col("html"), F.col("url"), F.col("content")).alias("a")).select("id", "a.text", F.coalesce(F.col("a.og_image"), F.col("a.content_image"), lit("")).alias("image"), "a.title")


def home_page_cards(spark: SparkSession, folder: str) -> DataFrame:
    """Cards from home pages of two sites, one of them with selectors of its own; a page for each stored card."""
    lit, cid = F.lit, F.col("card_id").cast("string")
    own = F.pmod("card_id", lit(2)) == 1
    t = F.concat(lit("Nota "), cid, lit(" "), F.col("t"))
    usual = F.concat(
        lit('<article><h2><a href="/n/'), cid, lit('">'), t, lit('</a></h2><img data-src="/i.jpg"><span class="category">Salud</span></article><article><a href="https://o.example/'), cid, lit('"><h3>Otra '), t,
        lit('</h3></a><img src="data:x"></article><article><h2>Sin enlace</h2></article><article><h3>Corta</h3><a href="/c">ver</a></article>'),
    )
    other = F.concat(lit('<article><h2><a href="/no">No</a></h2></article><div class="post"><h2>Volanta</h2><p class="tit"><a href="n/'), cid, lit('">'), t, lit('</a></p><em class="sec">Campo</em><img src="i.png"></div>'))
    cards = _cards(spark, folder).withColumn("t", _plain("titulo"))
    pages = cards.select("card_id", F.when(own, "https://www.propio.example/").otherwise("https://s.example/").alias("url"), F.when(own, other).otherwise(usual).alias("html"))
    sites = spark.createDataFrame([("propio.example", "div.post", "p.tit a", "em.sec")], "dominio string, card string, title string, section string")
    found = html.home_cards(S.with_site(pages, sites), {k: F.col(k) for k in ("card", "title", "section")})
    return ingest.usable_cards(found).select("card_id", "pos", "titulo", "url", "imagen_url", "seccion")


def pharmacy_shifts(spark: SparkSession, folder: str) -> DataFrame:
    """Shift tables from pages whose first block is the site's header; a page whose block is short gives none."""
    lit = F.lit
    p = S.table(spark, folder, "part").select("p_partkey", _plain("p_name").alias("t"))
    page = F.concat(
        lit('<div class="elementor elementor-location-header">'), F.repeat(lit("menu de la casa "), lit(20)), lit('</div><div class="elementor"><p>Farmacias</p><p>Turnos del mes de mayo</p><p>Atención de 8 a 20 en toda la ciudad</p><p>1</p><p>'), F.col("t"), lit("</p><p>Centro</p><p>2</p>"),
        F.when(F.pmod("p_partkey", lit(3)) == 0, lit("")).otherwise(F.concat(F.repeat(lit("<p>Mitre y la costa</p>"), lit(4)))), lit("</div>"),
    )
    raw = p.select("p_partkey", html.notice_text(page, [".elementor"], "elementor-location-").alias("raw"))
    return services.shift_table(raw.where("raw is not null"), "p_partkey", "raw")


def obituaries(spark: SparkSession, folder: str) -> DataFrame:
    """Notices about deaths from pages of two notices each, of which the second may have no date, cut at the end marker."""
    lit, k = F.lit, F.pmod("c_custkey", F.lit(12)) + 1
    page = F.concat(
        lit('<div class="entry-content"><p>Fallecimientos de la fecha en toda la zona de influencia del servicio</p><p>'), F.col("c_name"), lit("</p><p>Falleció el 3/"), k, lit("/24</p><p>Casa de duelo en la avenida</p><p>"), lit("Otro "), F.col("c_name"), lit("</p><p>fallecio "),
        F.when(k > 6, lit("el 5 de setiembre de 2023")).otherwise("sin fecha"), lit("</p><p>Sus restos descansan</p></div>"), lit("<p>afuera</p>"),
    )
    raw = S.table(spark, folder, "customer").select("c_custkey", services.cut_at_markers(F.concat(html.notice_text(page, [".nada", ".entry-content"]), lit("\nNoticias relacionadas\nPie"))).alias("raw"))
    return services.notices(raw, "c_custkey", "raw")


def obituaries_by_month(spark: SparkSession, folder: str) -> DataFrame:
    rows = obituaries(spark, folder)
    return rows.groupBy("anio", "mes").agg(F.count("*").alias("cantidad")).select("anio", "mes", "cantidad", services.month_slug(F.col("anio"), F.col("mes")).alias("slug"))


def discard_counts(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.discard_counts(S.table(spark, folder, "noticias"), _as_of())


def pending_insert(spark: SparkSession, folder: str) -> DataFrame:
    null = F.lit(None).cast("string")
    rows = _cards(spark, folder).select(
        F.col("card_id").cast("string").alias("id"), "titulo", F.concat(F.lit(" \n"), F.coalesce("titulo", F.lit("")), F.lit("\t")).alias("cuerpo"), F.when(F.pmod("card_id", F.lit(2)) == 0, "un-slug ").alias("slug"), "seccion", F.col("url").alias("url_original"), "imagen_url",
        *[null.alias(c) for c in ("resumen_seo", "instagram_text", "instagram_titulo", "twitter_text", "guion_video")],
    )
    return lifecycle.pending_rows(rows).select("id", "titulo", "cuerpo", "slug", "seccion", "estado", "es_portada", "imagen_url")


def picture_update(spark: SparkSession, folder: str) -> DataFrame:
    notes = S.table(spark, folder, "noticias")
    pictures = notes.where("imagen_url is null or imagen_url = ''").select("id", F.concat(F.lit("https://i.example/"), F.col("id")).alias("imagen_url"), F.lit("archivo").alias("imagen_fuente"))
    return lifecycle.with_picture(notes, pictures).select("id", "imagen_url", "imagen_fuente")


def section_update(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.with_section(S.table(spark, folder, "noticias"), "estado", "pendiente", "Cultura").select("id", "seccion")


def upsert_repeated(spark: SparkSession, folder: str) -> DataFrame:
    """Notes stored several times under a slug, of which the first is updated, and slugs that are new."""
    notes = S.table(spark, folder, "noticias").groupBy(F.col("fuente").alias("slug"), "id").agg(F.first("titulo").alias("titulo")).where("slug is not null")
    delta = S.table(spark, folder, "fuentes").select(F.col("nombre").alias("slug"), F.col("clave").alias("titulo")).unionByName(S.table(spark, folder, "region").select(F.col("r_name").alias("slug"), F.lit("nueva").alias("titulo")))
    return lifecycle.upserted(notes, delta, "slug", ["titulo"], ["id"]).select("slug", "id", "titulo")


def single_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The asked ids that exactly one stored row has: notes delivered twice and unknown ids give none."""
    notes = S.table(spark, folder, "noticias")
    asked = notes.select("id").unionByName(S.table(spark, folder, "region").select(F.col("r_name").alias("id")))
    return S.single_rows(notes, "id", asked, ["titulo", "estado", "seccion"])


def gate_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The run gate with textual starts: past, future, without an offset, no date at all, none."""
    texts = T.strings(["2026-01-15T00:00:00Z", "2026-01-14T22:00:00-03:00", "2027-01-01T00:00:00", "pronto", ""])
    cards = _cards(spark, folder).select("card_id", F.element_at(texts, (F.pmod("card_id", F.lit(5)) + 1).cast("int")).alias("inicio"), (F.pmod("card_id", F.lit(7)) != 0).alias("activo"))
    return cards.select("card_id", S.gate(F.col("activo"), dates.iso_instant(F.col("inicio")), _as_of()).alias("may_run"), dates.local_day(dates.iso_instant(F.col("inicio")), "America/Argentina/Buenos_Aires").alias("dia"))


def source_pairs(spark: SparkSession, folder: str) -> DataFrame:
    merged = ingest.merged_group(_notes(spark, folder).where("grupo_id is not null"), "grupo_id", "id")
    return merged.select("grupo_id", F.posexplode("fuentes_urls").alias("pos", "p")).select("grupo_id", "pos", "p.fuente", "p.url")


def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All cards as a stream, each address stored once."""
    base = f"{S.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    cards = S.table(spark, folder, "cards")
    cards.select("card_id", "lote", "url").repartition(4).write.parquet(f"{base}/in")
    append_unseen(landed_stream(spark, f"{base}/in", "card_id long, lote long, url string"), f"{base}/store", f"{base}/progress", ["card_id"]).awaitTermination()
    return spark.read.parquet(f"{base}/store").select("url")


_NAMES = (
    "lifecycle_stats expire_rows discard_orphans discard_siblings front_page_swap publish_rows upsert_by_key rewrite_update raw_insert seed_config last_k point_lookup group_lookup in_list_lookup "
    "active_source_union run_gate known_url_anti url_slug url_domain url_denylist section_normalize title_tokens title_entities query_terms token_idf similar_pairs leader_clusters group_limit stored_once "
    "source_list versions_concat prompts image_paths image_choice coherence group_ids masks message_actions line_segments month_rollup shift_table first_dates json_required stream_dedup "
    "group_prompts image_checks message_sections json_texts page_extraction home_page_cards pharmacy_shifts obituaries obituaries_by_month discard_counts pending_insert picture_update section_update upsert_repeated single_lookup gate_texts source_pairs"
).split()


def queries() -> dict[str, Query]:
    return {n: globals()[n] for n in _NAMES}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
