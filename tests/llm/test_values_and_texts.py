import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gacetilla.llm import canonical, leakage, packing, repeated_lines, residue, subjects
from gacetilla.llm.text import words


def test_edits():
    assert canonical.edits("salud", "saldu", 2) == 1 and canonical.edits("salud", "sald", 2) == 1 and canonical.edits("abc", "xyz", 1) == 2


def test_match_values(spark):
    names = spark.createDataFrame([(4, "Deportes", True), (4, "Sports", False), (7, "Salud", True), (31, "Cartas de lectores", True), (28, "Gastronomía", True), (22, "Nación", False)], "key int, name string, is_name boolean")
    cases = {
        "Home > DEPORTES »": 4, "dpeortes": 4, "Spor…": 4, "S A L U D": 7, "sald ": 7, "Cartas de lec.": 31, "GASTRONOM&IACUTE;A": 28, "NaciÃ³n": 22, "#cartas-de-lectores": 31, "categoria/salud (2)": 7,
        "Premium": 0, "xxx": 0, "-": 0, "Columna Pérez": 0, "2024": 0, "x" * 5000: 0, "Salud": 7,
    }
    rows = [(str(i), v, "clash") for i, v in enumerate(cases)]
    df = spark.createDataFrame([*rows, rows[0], ("n", None, ""), ("b", "  ", "")], "id string, seccion string, key string")
    got = {r.value: r.key for r in canonical.map_to_canonical(df, "seccion", names).collect()}
    assert got == cases
    exact = {r.value for r in canonical.map_to_canonical(df, "seccion", names, keep_exact=False).collect()}
    assert exact == set(cases) - {"Salud"}
    assert {r.key for r in canonical.match_values(spark.createDataFrame([("Salud",)], "value string"), names.limit(0)).collect()} == {0}
    assert canonical.map_to_canonical(df.limit(0), "seccion", names).count() == 0


def test_repeated_lines(spark):
    rnd = random.Random(1)
    rows = []
    for s, n in ((" Uno ", 40), ("DOS", 60), (None, 30), (" ", 5)):
        for i in range(n):
            lines = ["texto propio " + "".join(rnd.choices("abcdefgh", k=20)), "• Compartido 17 veces", "", "***"]
            if i % 2:
                lines.append("Aviso  legal!")
            if i < 3:
                lines.append("rara")
            rows.append((f"{s}{i}", "\r\n".join(lines) if i % 3 else "\n".join(lines), s if i % 2 else s and s.upper(), 1))
    df = spark.createDataFrame([*rows, *rows[:10], ("z", None, "Uno", 1), ("y", "", "Uno", 1)], "id string, cuerpo string, fuente string, documents int")
    got = {(r.id, r.line_no) for r in repeated_lines.repeated_lines(df).collect()}
    want = {(i, k) for i, t, s, _ in rows if s and s.strip() for k, x in enumerate(t.split("\n"), 1) if "Compartido" in x or "Aviso" in x}
    assert got == want
    clean = {r.id: r.cuerpo for r in repeated_lines.without_repeated_lines(df, repeated_lines.repeated_lines(df)).collect()}
    assert clean["z"] is None and "Aviso" not in clean["DOS1"] and "texto propio" in clean["DOS1"]
    assert repeated_lines.repeated_lines(df.limit(0)).count() == 0


def test_the_test_of_repeated_lines_rejects(spark):
    """Nearly all lines are rejected by the likelihood ratio alone; without it nothing is found."""
    rnd = random.Random(2)
    rows = [(f"{s}{i}", "\n".join(["".join(rnd.choices("abcdefgh", k=12)) for _ in range(5)] + ([f"aviso de {s}"] if i % 3 == 0 else []) + ["menu"]), s) for s in ("uno", "dos", "tres") for i in range(60)]
    df = spark.createDataFrame(rows, "id string, cuerpo string, fuente string")
    docs = df.select("id", F.xxhash64("id").alias("doc"), F.col("fuente").alias("source"), repeated_lines.line_keys(F.col("cuerpo")).alias("keys"))
    tested = repeated_lines.line_tests(docs, 0.01)
    assert tested.count() == 3 * 302 and tested.where("p <= cut").count() == 6
    assert tested.where("k = 1 and p <= cut").count() == 0
    assert repeated_lines.repeated_lines(df).count() == 3 * 20 + 180 and repeated_lines.repeated_lines(df, rate=0.0).count() == 0


def test_subjects(spark):
    rnd = random.Random(7)
    terms = {1: ["goles", "partido", "equipo", "torneo", "cancha"], 2: ["fiscal", "jueza", "causa", "fallo", "testigos"], 3: ["cosecha", "puerto", "barcos", "ganado", "siembra"]}
    common = ["ayer", "ciudad", "vecinos", "dijo", "luego", "tarde", "lugar", "mucho"]

    def par(t):
        return " ".join(rnd.choices(terms[t], k=6) + rnd.choices(common, k=10)) + " con todo lo que pasó."

    truth, rows = {}, []
    for i in range(240):
        ts = [rnd.choice([1, 2, 3])] if i % 4 else rnd.sample([1, 2, 3], 2)
        truth[f"d{i}"] = set(ts)
        rows.append((f"d{i}", "\n".join(par(t) for t in ts for _ in range(3)), None, f"http://s.ar/{i}/x", "S", 0))
    notes = spark.createDataFrame([*rows, rows[0], ("n", None, None, None, None, 0), ("e", " ", "", "", "", 0), ("menu", "Menú", "", "", "", 0)], "id string, cuerpo string, seccion string, url_original string, fuente string, tema_id int")
    labels = [(i, t if rnd.random() > 0.05 else 1 + t % 3) for i in list(truth)[:120] for t in truth[i]]
    themes = spark.createDataFrame([(1, "Deporte", "torneos"), (2, "Tribunales", None), (3, "Agro", "ganado")], "tema_id int, nombre string, descripcion string")
    df = subjects.find_subjects(notes, spark.createDataFrame(labels, "id string, tema_id int"), themes)
    got = {}
    for r in df.collect():
        got.setdefault(r.id, set()).add(r.tema_id)
    held_out = list(truth)[120:]
    assert sum(got.get(i) == truth[i] for i in held_out) >= 0.95 * len(held_out)
    assert not set(got) & {"n", "e", "menu"}
    assert subjects.find_subjects(notes, spark.createDataFrame([], "id string, tema_id int"), themes).count() == 0


def test_plan_fills_and_respects_capacity():
    rnd = random.Random(3)
    for _ in range(60):
        cap = rnd.choice([10, 64, 100])
        counts = {s: rnd.randrange(1, 30) for s in rnd.sample(range(1, cap + 1), rnd.randrange(1, min(20, cap)))}
        patterns = packing.plan(counts, cap)
        packed = {}
        for sizes, k in patterns:
            assert sum(sizes) <= cap and k > 0
            assert sum(3 * s > cap for s in sizes) <= 2
            for s in sizes:
                packed[s] = packed.get(s, 0) + k
        assert packed == counts
        total = sum(s * n for s, n in counts.items())
        big = sum(n for s, n in counts.items() if 2 * s > cap)
        assert sum(k for _, k in patterns) <= max(-(-total // cap), big) * 1.35 + 2


def test_pack(spark):
    rows = [(i, n) for i, n in enumerate([5, 5, 5, 5, 3, 10, 23, 1, 1, 7, 10])]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, tokens long"), 10).collect()
    by, doc = {}, {}
    for r in got:
        by[r.container] = by.get(r.container, 0) + r.tokens
        doc.setdefault(r.doc_id, []).append((r.piece, r.first_token, r.tokens))
    assert max(by.values()) <= 10 and {d: sum(t for *_, t in p) for d, p in doc.items()} == dict(rows)
    assert sorted(doc[6]) == [(0, 0, 10), (1, 10, 10), (2, 20, 3)] and all(len(p) == 1 for d, p in doc.items() if d != 6)
    assert packing.pack(spark.createDataFrame([], "doc_id long, tokens long"), 10).count() == 0


def test_token_counts(spark):
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    pytest.importorskip("tiktoken")
    texts = ["Hola, ¿qué tal?  12\n\nfin ", None, "", " \n", "x" * 3000, "<|endoftext|>"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in packing.token_counts(df.unionAll(df), path).collect()}
    from tokenizers import Tokenizer

    other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.encode_special_tokens = True
    assert got == {i: len(other.encode(texts[i], add_special_tokens=False).ids) for i in (0, 4, 5)}


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(4)
    pool = [f"p{i}" for i in range(40)] + ["de", "la", "el"] * 5
    items = {i: " ".join(rnd.choices(pool, k=rnd.randrange(5, 60))) for i in range(30)}
    docs = {}
    for d in range(120):
        w = rnd.choices(pool, k=rnd.randrange(0, 80))
        if d % 3 == 0:
            src = words(items[rnd.randrange(30)])
            a = rnd.randrange(len(src))
            w[5:5] = src[a : a + rnd.choice([11, 12, 20])]
        docs[d] = ", ".join(x.upper() if rnd.random() < 0.2 else x for x in w)
    docs |= {900: None, 901: "", 902: " \n", 903: "p1 " * 30_000}
    items |= {900: None, 901: "", 902: "corto"}

    def runs(t):
        w = words(t or "")
        return {tuple(w[i : i + 12]) for i in range(len(w) - 11)}

    want = {(d, i) for d, t in docs.items() for i, s in items.items() if runs(t) & runs(s)}
    df = spark.createDataFrame([*docs.items(), (0, docs[0])], "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = [tuple(r) for r in leakage.find_leaks(df, bench).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 10
    assert leakage.find_leaks(df, bench.limit(0)).count() == 0 and leakage.find_leaks(df.limit(0), bench).count() == 0
    assert {tuple(r) for r in leakage.find_leaks(df, bench, max_words=500).collect()} == want  # in many parts


def test_block_bounds_prune_where_every_word_is_known():
    rnd = random.Random(5)
    pool = [f"w{i}" for i in range(3000)]
    weights = [1 / (i + 1) for i in range(3000)]
    items = [(i, " ".join(rnd.choices(pool, weights, k=80))) for i in range(300)]
    index = leakage.ItemIndex(items, 12)
    known = list(index.vocabulary)
    text = rnd.choices(known, [1 / (int(w[1:]) + 1) for w in known], k=20_000)
    leak = words(items[7][1])[20:32]
    text[5000:5012] = leak
    terms = index.vocabulary
    starts, blocks = index.meetings(np.array([terms[w] for w in text]))
    assert 5000 in starts  # no leak is pruned
    assert len(starts) < 0.1 * len(text) * len(index.block_thresholds)  # what is left to score
    got = [index.retrieved([terms[w] for w in leak], b) for s, b in zip(starts.tolist(), blocks.tolist()) if s == 5000]
    assert any(7 in {index.ids[x] for x in g} for g in got)
    # brute force: every passage that reaches an item's threshold meets its block
    size = -(-len(index.ids) // leakage.BLOCKS)
    met = set(zip(starts.tolist(), blocks.tolist()))
    for s in range(4900, 5100):
        for b in range(len(index.block_thresholds)):
            assert {x // size for x in index.retrieved([terms[w] for w in text[s : s + 12]], b)} <= {k for t, k in met if t == s}


ARTICLE = "La jueza dictó el fallo en la causa y los vecinos celebraron en la plaza del pueblo. " * 8


@pytest.mark.parametrize("line", ["{{titulo}}", "Junto a {autor} y otros", "%CUERPO%", "[completar fecha]", "<bajada aquí>", "&lt;autor&gt;", "XX/XX/XXXX", "Error 404", "503 Service Unavailable", "Acceso denegado", "Por favor, habilite JavaScript para ver esta página.", "asdf asdf asdf asdf asdf", "Lorem ipsum dolor sit amet consectetur elit", "Fatal error: Uncaught Exception in /srv/x.php on line 3", "[object Object]", "Please turn on cookies and reload the page", '"Lo hablamos con todos %CUERPO% los sectores", dijo Ana.', '"No fue fácil llegar [INSERTAR POST_EXCERPT] hasta acá", respondió Ana.'])
def test_evidence(line):
    assert residue.line_evidence(line) == residue.STRONG


@pytest.mark.parametrize("line", ["El taller de JavaScript que dicta Ana todavía tiene vacantes.", 'Un cartel apareció con la frase "lorem ipsum" y se rieron.', "Vieron durante horas un cartel de error 404, reconoció Ana.", '"Me salió página no encontrada", relató Ana.', '"Dijimos que [la obra] iba a estar {sic} terminada", leyó.', "La baja fue del 30% al 40% (Ana) [N. de la R.: datos provisorios]", "404 árboles para Lobos", "525 lecturas", "Aceptar todas las cookies de s.example", "Este sitio usa cookies para mejorar tu experiencia.", "La clave era <admin> y nadie la cambió.", 'El modelo dice "Estimado {nombre}" y nadie lo llenó.'])
def test_no_evidence(line):
    assert residue.line_evidence(line) == 0


def test_residue(spark):
    rows = [(i, "S", f"{ARTICLE}Lo contó {'abcdefghijklmnopqrst'[i] * 3}.\nRecargar la página\nnota {i} propia") for i in range(20)]
    rows += [(50, "S", "Recargar la página\nEspere un momento…"), (51, "T", "Cargando…"), (52, None, f"{ARTICLE} {{{{autor}}}}"), (53, "T", ARTICLE), (54, "T", None), (55, "T", ""), (56, "T", " \n"), (57, "T", "Título\nBajada\nCuerpo de la noticia"), (58, "T", ARTICLE * 200)]
    df = spark.createDataFrame([(*r, 1) for r in rows + rows[20:22]], "doc_id long, source string, text string, n int")
    assert sorted(r.doc_id for r in residue.find_residue(df).collect()) == [50, 51, 52, 57]
    assert residue.find_residue(df.limit(0)).count() == 0


def test_what_a_site_says_on_every_page_excludes_no_article(spark):
    """The counts by site decide: the same footer excludes an article of a site that does not repeat it."""
    footer = "Por favor, habilite JavaScript para ver esta página."
    rows = [(i, "Uno", f"{ARTICLE}Lo contó {'abcdefghijklmnopqrst'[i] * 3}.\n{footer}") for i in range(20)]
    rows += [(100 + i, "Uno", footer) for i in range(5)] + [(200, "Otro", f"{ARTICLE}\n{footer}")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert sorted(r.doc_id for r in residue.find_residue(df).collect()) == [100, 101, 102, 103, 104, 200]
    assert residue.find_residue(df, least_documents=1000).count() == 26  # without subtraction every article is lost


@pytest.mark.parametrize("line", ["Error 404. Página no encontrada.", "Por favor, habilite JavaScript para ver esta página.", "| 503 Service Unavailable |"])
def test_evidence_in_a_long_line(line):
    assert residue.line_evidence(f"{ARTICLE}{line} {ARTICLE}") == residue.STRONG
    assert residue.line_evidence(f'{ARTICLE}Decía: "Hola. {line} Chau." {ARTICLE}') == 0
    assert residue.line_evidence(f"{ARTICLE}Ana contó que vio durante horas el cartel de error 404 y el de JavaScript. {ARTICLE}") == 0


def test_more_entries_than_allowed_raise(spark):
    notes = spark.createDataFrame([], "id string, cuerpo string, seccion string, url_original string, fuente string")
    themes = spark.createDataFrame([(i, "a", None) for i in range(3)], "tema_id int, nombre string, descripcion string")
    with pytest.raises(ValueError):
        subjects.fit_lexicon(notes, spark.createDataFrame([], "id string, tema_id int"), themes, None, max_themes=2)
