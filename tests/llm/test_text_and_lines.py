from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gacetilla.llm import lines as L, text as T
from gacetilla.llm.boilerplate import Sites, common_subsequence, find_boilerplate, main_text

SCHEMA = "id string, cuerpo string, url_original string, fuente string, extra int"


def test_words():
    assert T.words("Ñandú, 53.791 AÑOS de_fe") == ["nandu", "53", "791", "anos", "de", "fe"]
    codes, offsets, vocabulary = T.word_table(["Uno dos", None, "", "dos tres!"])
    assert [[vocabulary[c] for c in codes[a:b]] for a, b in zip(offsets, offsets[1:])] == [["uno", "dos"], [], [], ["dos", "tres"]]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=5))
def test_word_table_equals_words(texts):
    codes, offsets, vocabulary = T.word_table(texts)
    ascii_only = [t for t in texts if t.isascii()]
    if len(ascii_only) == len(texts):
        assert [[vocabulary[c] for c in codes[a:b]] for a, b in zip(offsets, offsets[1:])] == [T.words(t) for t in texts]


def test_addresses(spark):
    rows = [
        "https://www.s.ar/?p=12", " http://M.S.AR/?p=0012&utm=1#top", "https://s.ar/nota/12/un-titulo", "https://s.ar/2025/01/02/un-titulo-12.html ?ref=x", "https://s.ar/un-titulo-n12/amp/",
        "https://s.ar/?p=13", "https://o.ar/?p=12", "https://s.ar/una/pagina/", "s.ar/una/pagina", None, "", "sin direccion",
    ]
    got = [r.k for r in spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "i int, u string").select("i", T.article_key(F.col("u")).alias("k")).orderBy("i").collect()]
    assert got[:5] == ["s.ar#12"] * 5 and got[5] == "s.ar#13" and got[6] == "o.ar#12" and got[7] == got[8] == "s.ar/una/pagina" and got[9:] == [None, None, None]


def tokens(line, kind):
    literal, others, *_ = L.describe(line)
    return {t for t in (literal, *others) if t & 7 == kind}


def test_lines_that_differ_in_names_or_figures_share_a_token():
    same = [
        (L.LITERAL, "380 lecturas", "» 12 Lecturas!"), (L.HEAD, "Etiquetas: Lobos, Ana", "ETIQUETAS: SALADILLO #LUZ"), (L.HEAD, "Inicio > Salud > Una nota", "Inicio > Campo"), (L.HEAD, ">> Ana Paz ganó", "» >> Luz Sol perdió"),
        (L.SHAPE, "Por Ana Paz", "Por Luz Sol Mar"), (L.SHAPE, "Ana Paz (Redacción El Sitio)", "Luz Sol (Redacción El Sitio)"), (L.SHAPE, "Martes 10 de marzo de 2025", "Lunes 3 de agosto de 2024"), (L.TAIL, "Ana dijo: no, saludos desde Lobos", "Luz: sí, saludos desde Mar Azul"),
    ]
    for kind, x, y in same:
        assert tokens(x, kind) & tokens(y, kind), (x, y)
    assert not set(L.describe("Ana Paz habló con Luz.")[1]) & set(L.describe("El club ganó el partido.")[1])
    assert L.page_tokens(None) == [] == L.page_tokens(" \n\t\r\n") and L.page_tokens("***\n\n— —") == [(1, (), L.OUTSIDE), (3, (), L.OUTSIDE)]


def test_prose_has_its_literal_only_and_lists_follow_their_heading():
    rows = L.page_tokens("Más leídas\n1. El club de Lobos ganó el clásico de la costa por goleada\n2. La jueza de Lobos dictó el fallo más esperado del año\nEl club ganó el partido. Hubo fiesta en la plaza, dijo Ana Paz a los vecinos.\nCampo\nLa cosecha terminó ayer. Hubo fiesta en el campo, dijo Luz Sol a los vecinos.")
    after = rows[0][1][0] & ~7 | L.AFTER
    assert after in rows[1][1] and after in rows[2][1] and len(rows[3][1]) == 1 and [r[2] for r in rows] == [L.OUTSIDE] * 3 + [L.PROSE, L.WITHIN, L.PROSE]


def test_main_lines():
    assert L.main_lines("uno\n\n dos  tres \r\ncuatro", [4]) == [(1, "uno"), (3, "dos tres")] and L.main_lines(None, [1]) == [] == L.main_lines("x", [1])


def test_whole():
    whole = "Una nota entera y bien terminada que cuenta con detalle lo que pasó."
    assert L.is_whole(L.main_lines(f"{whole}\n12 comentarios", [2])) and L.is_whole(L.main_lines(f"{whole}\nLa palabra de Ana", []))
    for t in ("Una nota que queda en el medio de una frase larga que no se termina de", f"{whole}\nUna nota que queda en…", f"{whole} Otra que queda [...]", f"{whole} Y otra (sigue)", "Subhead suelto", "", None):
        assert not L.is_whole(L.main_lines(t, []))


def test_common_subsequence_is_longest():
    import random

    rnd = random.Random(1)

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    for _ in range(200):
        a, b = [rnd.sample(range(12), rnd.randrange(9)) for _ in range(2)]
        c = common_subsequence([(x, 100 + x, -1000 - i) for i, x in enumerate(a)], [(x, 100 + x, -2000 - i) for i, x in enumerate(b)])
        kept = {x for x in c if x < 100}
        assert len(kept) == longest(a, b) and c == kept | {100 + x for x in kept}
        assert [x for x in a if x in kept] == [x for x in b if x in kept]


def test_boilerplate(spark):
    odd = "Frase propia de este sitio que nadie conoce de antemano"
    rows = [(f"{i:02d}", f"La nota {chr(97 + i) * 9} cuenta con detalle lo que pasó en la ciudad de {chr(110 - i) * 8}.\n{odd}\n{i} lecturas", f"http://s.ar/?p={i}", "S", 1) for i in range(12)]
    rows += [rows[0], ("n", None, None, None, None), ("e", "", "http://s.ar/?p=99", "S", 1), ("b", " \n ", None, None, 1), ("long", "palabra " * 50_000, "http://o.ar/?p=1", "O", 1)]
    found = sorted(map(tuple, find_boilerplate(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert found == sorted((f"{i:02d}", k) for i in range(12) for k in (2, 3))
    clean = {r.id: r.cuerpo for r in main_text(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(found, "id string, line_no int")).collect()}
    assert clean["03"] == rows[3][1].split("\n")[0] and clean["n"] is None and clean["e"] == ""
    assert find_boilerplate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_each_site_decides_by_its_own_pages(spark):
    def page(i, host, *more):
        name = "".join(chr(97 + int(d)) for d in f"{i:03d}") * 3
        return (f"{host}{i:03d}", "\n".join([f"La nota {name} cuenta con detalle lo que pasó en {host} con los vecinos de {name}.", *more]), f"http://{host}/?p={i}", "S", 1)

    carrier = [page(i, "a.ar", *["380 lecturas"][: i in (0, 1, 40, 80)]) for i in range(120)]  # mostly too rare to be met next door
    plain = [page(i, "b.ar", *["12 comentarios"][: i == 40]) for i in range(120)]
    twice = [("b.ar900", "Por Ana Paz, para El Sitio", "http://b.ar/?p=900", "S", 1)] * 2
    rows = carrier + plain + twice + [page(0, "c.ar", "525 lecturas")]
    found = sorted(map(tuple, find_boilerplate(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert found == sorted([(f"a.ar{i:03d}", 2) for i in (0, 1, 40, 80)] + [("c.ar000", 2)])
    assert find_boilerplate(spark.createDataFrame(carrier, SCHEMA), least_open_rate=0.04, least_pooled_rate=0.04).count() == 0


def test_notice_on_a_site_of_short_notes(spark):
    notice = "Esta casa edita todas las tardes un boletín en papel para quienes no tienen pantalla en el barrio."
    few = "El archivo de láminas de la ciudad se abre a quien lo pida con tiempo en la sala del primer piso."

    def page(i):
        name = "".join(chr(97 + int(d)) for d in f"{i:03d}") * 3
        own = [f"La nota {name} cuenta con detalle lo que pasó en la ciudad con los vecinos de {name}."] if i % 3 else [f"Breve de {name}"]
        return (f"{i:03d}", "\n".join([*own, notice, *([few] if i % 13 == 0 else [])]), f"http://s.ar/?p={i}", "S", 1)

    story = [f"El relato {k} de los copistas de la villa dice lo mismo en todas partes y no cambia." for k in "abc"]
    copies = [(f"k{i}", "\n".join([*story, notice]), f"http://s.ar/?p={500 + i}", "S", 1) for i in range(8)]
    rows = [page(i) for i in range(140)] + copies
    found = sorted(map(tuple, find_boilerplate(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert found == sorted([(f"{i:03d}", 2) for i in range(140)] + [(f"{i:03d}", 3) for i in range(0, 140, 13)] + [(f"k{i}", 4) for i in range(8)])


def test_without_a_site_to_compare_with_nothing_is_found(spark):
    """The same pages as in ``test_boilerplate``, each on a site of its own: differencing is all there is."""
    rows = [(f"{i:02d}", f"La nota {chr(97 + i) * 9} cuenta con detalle lo que pasó en la ciudad de {chr(110 - i) * 8}.\nPor Ana Paz, para El Sitio\n{i} lecturas\n© 2025 El Sitio", f"http://s{i}.ar/?p={i}", "S", 1) for i in range(12)]
    assert find_boilerplate(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_subheads_of_the_articles_are_kept(spark):
    rows = []
    for i in range(60):
        x = "".join(chr(97 + int(d)) for d in f"{i:02d}") * 4
        rows.append((f"{i:02d}", f"Por {x.title()} Paz\nLa nota {x} cuenta con detalle lo que pasó en la ciudad con los vecinos de la plaza.\nLa palabra de {x.title()} Sol\nLos vecinos de {x} contaron lo que pasó en la plaza con todo detalle y con paciencia.\nTemas: {x}", f"http://s.ar/?p={i}", "S", 1))
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, find_boilerplate(df).collect())) == sorted((f"{i:02d}", k) for i in range(60) for k in (1, 5))
    for most in (0, 1_000_000):  # joined, broadcast
        got = {r.id: sorted(r.gone) for r in Sites(df, most_shared=most).marked(df, ["id", "cuerpo"]).collect()}
        assert got == {f"{i:02d}": [1, 5] for i in range(60)}
