from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gacetilla.functions import dates, html, json as J, text as T


def one(spark, column, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first()["x"]
    return row


def test_title_tokens(spark):
    assert sorted(one(spark, T.title_tokens(F.col("t")), t="Según la auto-bomba 42, el fútbol\xa0y el fútbol")) == ["autobomba", "fútbol"]
    assert one(spark, T.title_tokens(F.col("t")), t=None) == []


def test_entities_may_count_a_phrase_more_than_once(spark):
    got = one(spark, T.title_entities(F.col("t")), t="Choque en Ruta 88 de Miramar: 3,5 horas")
    assert {"88", "3,5", "ruta", "ruta 88", "miramar"} <= set(got)


def test_section_takes_first_key_contained(spark):
    assert [one(spark, T.section_of(F.col("s")), s=x) for x in (" Carteles", "nocturno", "fútbol", None, "Medio Ambiente")] == ["Cultura", "Farmacias", "Local", "Local", "Sociedad"]
    assert one(spark, T.section_class(F.col("s")), s="Local ") == one(spark, T.section_class(F.col("s")), s="política")


def test_slug_and_domain(spark):
    slug = T.url_slug(F.col("u"), F.col("t"))
    assert one(spark, slug, u="https://a.b/x/Año-Nuevo_2024/?q=1", t="z") == "a-o-nuevo-2024"
    assert one(spark, slug, u="https://a.b/", t="Qué día") == "qu-d-a"
    assert one(spark, slug, u=None, t=None) == "nota"
    assert one(spark, slug, u="https://a.b/ñ", t=None) == "nota"
    assert one(spark, T.url_domain(F.col("u")), u="HTTPS://WWW.A.b:80/x") == "a.b:80"
    assert one(spark, T.url_domain(F.col("u")), u="no url") == ""


def test_denylist_coherence_masks(spark):
    assert not one(spark, T.is_article_url(F.col("u")), u="http://a/Tag/x") and one(spark, T.is_article_url(F.col("u")), u="http://a/nota/1")
    c = T.is_coherent(F.col("t"), F.col("b"))
    assert one(spark, c, t="incendio forestal norte", b="nada que ver") is False
    assert one(spark, c, t="incendio", b="Incendios") is True and one(spark, c, t=None, b="x") is True and one(spark, c, t="x", b=None) is True
    assert [one(spark, T.masked(F.col("v")), v=v) for v in ("", "abcdef", "abcdefghij")] == ["(VACÍO)", "ab***", "abcd...ghij"]


def test_actions_and_paths(spark):
    u = "123e4567-e89b-12d3-a456-426614174000"
    r = one(spark, T.parse_action(F.col("d")), d=f"sec_grupo_set_{u}_Salud y más")
    assert (r["action"], r["head"], r["tail"]) == ("sec_grupo_set", u, "Salud y más")
    assert one(spark, T.parse_action(F.col("d")), d="pub_7")["head"] == "7" and one(spark, T.parse_action(F.col("d")), d="otra") is None
    p = T.image_path(F.lit("i"), F.col("u"), F.col("s").cast("int"), F.col("c"), F.col("n").cast("int"))
    assert one(spark, p, u="http://x", s="200", c="image/png", n="5000000") == "noticias/i.png"
    assert one(spark, p, u="http://x", s="200", c="image/bmp", n="1") == "noticias/i.jpg"
    assert [one(spark, p, u=u_, s=s, c=c, n=n) for u_, s, c, n in (("ftp://x", "200", "image/png", "1"), ("http://x", "404", "image/png", "1"), ("http://x", "200", "text/html", "1"), ("http://x", "200", "image/png", "5000001"))] == [None] * 4
    assert one(spark, T.urls_joined(F.col("b"), F.col("h")), b="http://a/b/", h="../c") == "http://a/c" and one(spark, T.url_quoted(F.col("h")), h="a b/é") == "a%20b/%C3%A9"
    assert one(spark, T.message_title(F.col("m")), m="Título:  Hola \nfin") == "Hola" and one(spark, T.message_title(F.col("m")), m="x") == "(Noticia)"


def test_first_date(spark):
    d = dates.first_date(F.col("t"))
    cases = {"falleció el 3 de setiembre de 2024": (2024, 9), "5/13/24 y 6-7-24": (2024, 7), "1 – 2 – 199": (199, 2), "el 3 de abril 2023, 1/1/20": (2023, 4), "1/1/20 y 3 de abril de 2023": (2020, 1), "40/1/2020": None, "3 de brumario de 2020": None, "": None}
    for t, want in cases.items():
        got = one(spark, d, t=t)
        assert (None if got is None else (got["anio"], got["mes"])) == want, t


def test_json(spark):
    for t in ('{"a": 1}', '```json\n{"a": 1}\n```', 'Va: {"a": 1} listo'):
        assert one(spark, J.json_object(F.col("t")), t=t) == '{"a": 1}'
    for t in ("nada", "{'a': 1}", '{"a":1} x {"b":2}', '{"a":1}}', '{"a":1}],[{"b":2}', '{"a":1}, {"b":2}', '{"a": ', "[1]", "null", "", None):
        assert one(spark, J.json_object(F.col("t")), t=t) is None, t
    assert one(spark, J.json_object(F.col("t")), t='{"a": NaN}') == '{"a": NaN}'
    assert one(spark, J.missing_fields(F.col("t"), ["a", "b"]), t='{"a": null}') == ["b"]
    assert one(spark, J.is_rejected(F.col("t")), t='{"publicar": false}') and not any(one(spark, J.is_rejected(F.col("t")), t=t) for t in ("{}", '{"publicar": "false"}', '{"publicar": true}', '{"publicar": null}', "no", None))


def test_instants(spark):
    assert one(spark, dates.iso_instant(F.col("t")).isNotNull(), t="2027-01-01T00:00:00Z") and one(spark, dates.local_day(dates.iso_instant(F.col("t")), "America/Argentina/Buenos_Aires"), t="2027-01-01T00:00:00+00:00") == "31/12/2026"
    assert [one(spark, dates.iso_instant(F.col("t")), t=t) for t in ("2027-01-01T00:00:00", "pronto", "2027-13-01T00:00:00Z", "", None)] == [None] * 5


def test_message_section(spark):
    assert one(spark, T.message_section(F.col("m"), F.lit("Salud $1")), m="📂 Sección: Local\nfin") == "📂 Sección: Salud $1\nfin" and len(one(spark, T.message_section(F.col("m"), F.lit("x")), m="y" * 5000)) == 4096


LONG = "Una frase bastante larga que supera los treinta caracteres."


def test_article_text():
    page = f"<html><body><nav><p>{LONG} menu</p></nav><article><p>{LONG}<p>Segunda: {LONG}</article></body></html>"
    assert html.article_text(page) == f"{LONG}\n\nSegunda: {LONG}"
    assert html.article_text(f"<body><ul><li>{LONG}</li><li>b {LONG}</li></ul></body>") == f"{LONG}\n\nb {LONG}"
    assert html.article_text(f'<head><meta name="description" content="{LONG}{LONG}"></head><body><p>corto</p></body>') == LONG * 2
    assert html.article_text(f"<body><div class='c'><p>{LONG}</p><p>2 {LONG}</p></div><article><p>otra</p></article></body>", ["div.c"]).endswith(f"2 {LONG}")
    assert html.article_text("") == "" and html.article_text(None) == ""


def test_images_and_cards(spark):
    assert html.og_image('<meta property="og:image" content="/x"><meta name="twitter:image" content="http://i">') == "http://i"
    page = '<article><img src="data:x"><img src="a.png" width="199"><img src="b.png" width="200"></article>'
    assert html.content_image(page, "http://h/n/") == "http://h/n/b.png" and html.content_image(page.replace('"199"', '"auto"'), "http://h/") == "http://h/a.png"
    home = '<article><a href="/n/1"><h3>Volanta</h3><h2>Un título largo</h2></a><img data-src="i.jpg"><span class="category">Salud</span></article><article><h2>sin link</h2></article>'
    df = spark.createDataFrame([(1, "http://s.ar/", home), (2, "http://s.ar/", None)], "page_id int, url string, html string")
    rows = html.home_cards(df, {"title": F.lit("h2")}).collect()
    assert [(r.page_id, r.titulo, r.url, r.imagen_url, r.seccion) for r in rows] == [(1, "Un título largo", "http://s.ar/n/1", "http://s.ar/i.jpg", "Salud")]


def test_notice_pages(spark):
    page = f"<div class='elementor elementor-location-header'>{LONG * 3}</div><div class='elementor'><p>uno</p><p>{LONG * 2}</p></div>"
    assert html.block_text(page, [".elementor"], "elementor-location-") == f"uno\n{LONG * 2}"
    assert html.block_text(page, [".otro", ".elementor"], least=1000) is None and html.block_text(None, ["article"]) is None
    assert one(spark, html.notice_text(F.col("h"), [".elementor"], "elementor-location-"), h=page).startswith("uno")
    from gacetilla.operators.services import cut_at_markers

    assert one(spark, cut_at_markers(F.col("t")), t="avisos\nNoticias relacionadas\nx") == "avisos\n"
    assert one(spark, cut_at_markers(F.col("t")), t="Noticias relacionadas y avisos") == "Noticias relacionadas y avisos"
    assert one(spark, T.group_id(F.col("u")), u="x") == one(spark, T.group_id(F.col("u")), u="x") and len(one(spark, T.group_id(F.col("u")), u=None)) == 36


@settings(max_examples=25, deadline=None)
@given(st.text(max_size=60))
def test_slug_form(spark, t):
    import re

    assert re.fullmatch(r"[a-z0-9]+(-[a-z0-9]+)*", one(spark, T.url_slug(F.lit(""), F.col("t")), t=t))
