import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gacetilla.llm import golden, near_dupes, newness
from gacetilla.llm.text import words



def grams(t, n):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(texts, n, num, den):
    sets = {i: grams(t, n) for i, t in texts.items() if t and grams(t, n)}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (c := len(sets[a] & sets[b])) * den >= (len(sets[a]) + len(sets[b]) - c) * num}


def corpus(seed, n=160):
    rnd = random.Random(seed)
    pool = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(n):
        if i and rnd.random() < 0.5:
            w = words(texts[f"d{rnd.randrange(i):03d}"] or "") or ["x"]
            for _ in range(rnd.randrange(6)):
                w[rnd.randrange(len(w))] = rnd.choice(pool)
        else:
            w = rnd.choices(pool, k=rnd.randrange(1, 50))
        texts[f"d{i:03d}"] = " ".join(w)
    texts |= {"null": None, "empty": "", "blank": " \n"}
    return texts


def test_near_pairs_equal_brute_force(spark):
    for seed, n, t in ((1, 3, (3, 5)), (2, 3, (3, 5)), (3, 5, (4, 5))):
        texts = corpus(seed)
        rows = [*texts.items(), *list(texts.items())[:5]]
        sets = near_dupes.ngram_sets(spark.createDataFrame(rows, "id string, text string"), n)
        links = near_dupes.node_links(sets, n, t)
        got = [tuple(r) for r in near_dupes.near_pairs(sets, links).collect()]
        want = brute(texts, n, *t)
        assert set(got) == want and len(got) == len(want) and len(want) > 10


def test_hot_ngrams_are_spread_and_lose_nothing(spark):
    texts = corpus(4, 60)
    sets = near_dupes.ngram_sets(spark.createDataFrame(list(texts.items()), "id string, text string"), 3)
    got = {tuple(r) for r in near_dupes.near_pairs(sets, near_dupes.node_links(sets, 3, (3, 5), hot=2)).collect()}
    assert got == brute(texts, 3, 3, 5)


def test_groups(spark):
    texts = corpus(5)
    sets = near_dupes.ngram_sets(spark.createDataFrame(list(texts.items()), "id string, text string"), 3)
    got = {r.id: (r.class_id, r.links) for r in near_dupes.near_groups(sets, near_dupes.node_links(sets, 3, (3, 5))).collect()}
    pairs = brute(texts, 3, 3, 5)
    root = {i: i for i in got}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert got == {i: (find(i), sum(i in p for p in pairs)) for i in got}
    none = near_dupes.ngram_sets(spark.createDataFrame([], "id string, text string"), 3)
    assert near_dupes.near_groups(none, near_dupes.node_links(none, 3)).count() == 0


def test_best_record(spark):
    day = dt.datetime(2026, 1, 1)
    whole, cut = "Una nota entera y bien terminada con sus detalles.", "Una nota cortada en el medio de"
    rows = [
        ("a", "g", "Malo", "https://c.ar/f/1.jpg", whole, day), ("b", "g", " BUENO ", "https://c.ar/blank.gif?v=1", cut, day), ("c", "g", "bueno", "//c.ar/x.jpg", whole + " Más.", day + dt.timedelta(1)), ("c", "g", "bueno", "//c.ar/x.jpg", whole + " Más.", day + dt.timedelta(1)),
        ("d", "h", None, "data:x", None, day), ("e", "h", None, "https://c.ar/theme/logo-f01.svg", "", day), ("f", "solo", "Bueno", "https://c.ar/f/2.png", whole, day), ("g", None, "Bueno", None, whole, day), ("i", "k", "Otro", None, whole, None), ("j", "k", None, None, whole, None),
    ]
    notes = spark.createDataFrame([(*r, "x", None) for r in rows], "id string, grupo_id string, fuente string, imagen_url string, cuerpo string, created_at timestamp, votes string, url_original string")
    sources = spark.createDataFrame([("Bueno", 9), ("Malo", 2)], "nombre string, confianza int")
    got = {tuple(r) for r in golden.winners(golden.votes(notes, sources), order="trust").collect()}
    assert got == {("g", "cuerpo", "c"), ("g", "imagen_url", "a"), ("g", "fuente", "c"), ("k", "cuerpo", "j"), ("k", "fuente", "i")}
    best = {r.grupo_id: r for r in golden.best_record(notes, sources).collect()}
    assert best["g"].fuente == "bueno" and best["g"].imagen_url == "https://c.ar/f/1.jpg" and best["k"].imagen_url is None
    # two records of a value outvote one
    v = golden.votes(spark.createDataFrame([("1", "z", "Malo", None, whole, day, "", None), ("2", "z", "Malo", None, whole, day, "", None), ("3", "z", "Medio", None, whole + " Otra.", day, "", None)], notes.schema), spark.createDataFrame([("Malo", 2), ("Medio", 3)], "nombre string, confianza int"))
    assert golden.winners(v).where("campo = 'cuerpo'").first().id == "2" and golden.winners(v, "trust").where("campo = 'cuerpo'").first().id == "3"
    assert golden.winners(golden.votes(notes.limit(0), sources)).count() == 0


HEAD = "Estación Lobos: la jueza de garantías dictó el fallo en la causa y Renata Plovorier celebró"


def same(a, b):
    return newness.same_headline(newness.headline_words(a), newness.headline_words(b))


def test_same_headline():
    for t in (f"VIDEO. {HEAD}", f"  {HEAD.upper()} | El Diario", f"{HEAD} - El Faro de Lobos (actualizado)", HEAD.replace("garantías", "garanitas"), HEAD.replace("el fallo", "fallo"), HEAD.replace("ó", "&oacute;"), f"{HEAD} #Local", HEAD.replace(": la", " - la")):
        assert same(HEAD, t), t
    for t in (HEAD.replace("Plovorier", "Gambetta"), HEAD.replace("Lobos", "Tandil"), HEAD.replace("dictó el fallo", "rechazó el recurso"), "", None):
        assert not same(HEAD, t), t
    assert not same("Con 53 goles, el club ganó la copa en Lobos", "Con 54 goles, el club ganó la copa en Lobos")
    assert same("Según Ana, el club ganó la copa en Lobos", "De acuerdo con Ana, el club se impuso en la copa en Lobos")


def test_known_entries(spark):
    rnd = random.Random(2)
    vocab = [f"{a}{b}{c}o" for a in ("bra", "cle", "dri", "fun", "gar") for b in ("men", "tol", "pis", "ruz") for c in ("da", "le", "mi", "vu")]
    titles = [" ".join(rnd.sample(vocab, 9)) for _ in range(300)]
    history = [(f"n{i}", t, f"http://s.ar/?p={i}") for i, t in enumerate(titles)]

    def slip(t):
        w = t.split()
        k = rnd.randrange(len(w))
        w[k] = w[k][:2] + w[k][3:]
        return " ".join(w)

    batches = [(f"c{i}", 1, slip(t), f"http://o.ar/?p={9000 + i}", "x") for i, t in enumerate(titles[:120])]
    batches += [("link", 1, "otra cosa", "https://m.s.ar/?p=5&x=1", "x"), ("null", 1, None, None, "x"), ("blank", 1, " ", "", "x"), ("new", 1, "uno dos tres cuatro cinco seis siete", "http://o.ar/?p=1", "x"), ("again", 2, "UNO dos tres cuatro cinco seis siete", None, "x"), ("same-batch", 2, "uno dos tres cuatro cinco seis siete", None, "x"), ("late", 3, None, "o.ar/?p=1", "x")]
    h = spark.createDataFrame(history, "key string, titulo string, url string")
    b = spark.createDataFrame(batches, "key string, lote int, titulo string, url string, words string")
    got = {r.key for r in newness.known_entries(h, b).collect()}
    assert {"link", "again", "same-batch", "late"} <= got and not got & {"null", "blank", "new"}
    assert len(got & {f"c{i}" for i in range(120)}) >= 0.97 * 120
    assert {r.key for r in newness.new_entries(h.limit(0), b.where("lote = 1")).collect()} == {r[0] for r in batches if r[1] == 1}


def test_growing_history_equals_all_at_once(spark, tmp_path):
    h = spark.createDataFrame([(f"n{i}", f"{HEAD} {w}", f"http://s.ar/?p={i}") for i, w in enumerate(("alfa", "beta"))], "key string, titulo string, url string")
    rows = [("a", 0, f"VIDEO. {HEAD} alfa", None), ("b", 0, "uno dos tres cuatro cinco seis siete", "http://o.ar/?p=1"), ("c", 1, "uno dos tres cuatro cinco sies siete", None), ("d", 2, None, "o.ar/?p=1&x=2"), ("e", 2, "otra historia sin nada que ver con nada", None)]
    b = spark.createDataFrame(rows, "key string, lote int, titulo string, url string")
    grown = newness.History(h, str(tmp_path), merge_at=3)
    got = {r.key for k in range(3) for r in grown.check_and_add(b.where(F.col("lote") == k)).collect()}
    assert got == {r.key for r in newness.known_entries(h, b).collect()} == {"a", "c", "d"}
    assert len(grown.forest.runs) < 4


def test_forest_runs_merge(spark, tmp_path):
    heads = newness.tokenized(spark.createDataFrame([(f"k{i}", i, f"palabra{i % 3} comun otra{i % 3} mas{i % 3}", None) for i in range(9)], "key string, lote int, titulo string, url string"))
    f = newness.HashForest(spark, str(tmp_path), {})
    f.add(heads.where("lote < 4"))
    f.add(heads.where("lote >= 4"))
    before = f.search(heads, 2).count()
    f.merge()
    assert len(f.runs) == 1 and f.search(heads, 2).count() == before == 9


def _slip(word, rnd):
    k = rnd.randrange(len(word) - 1)
    return rnd.choice((word[:k] + word[k + 1 :], word[:k] + rnd.choice("aeioxñ7ж") + word[k:], word[:k] + rnd.choice("zq") + word[k + 1 :], word[:k] + word[k + 1] + word[k] + word[k + 2 :]))


def test_headlines_of_the_same_phrases_are_dropped_before_verification(spark, tmp_path):
    rnd = random.Random(7)
    name = lambda: "".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(5))
    titles = [f"la maratonista veterana empató el partido de vuelta según {name()} {name()} de {name()}" for _ in range(120)]
    changed = []
    for t in titles[:60]:
        w = t.split()
        for k in rnd.sample([k for k, x in enumerate(w) if len(x) > 5], rnd.randrange(1, 5)):
            w[k] = _slip(w[k], rnd)
        if len(changed) % 3 == 0:
            w.insert(rnd.randrange(len(w)), "extraordinariamente")
        changed.append(" ".join(w))
    heads = newness.tokenized(spark.createDataFrame([(f"k{i}", i, t, None) for i, t in enumerate(titles + changed)], "key string, lote int, titulo string, url string"))
    f = newness.HashForest(spark, str(tmp_path), {})
    f.add(heads)
    assert f.search(heads, 2).count() < 400  # of 16,110 pairs

    shape = f.rows().where("tree = 0").join(heads.select("id", "words"), "id").select("id", "words", *newness._SHAPE)
    other = shape.select(*(F.col(c).alias(f"other_{c}") for c in shape.columns))
    pairs = shape.crossJoin(other).where("id < other_id").select("words", "other_words", newness._may_match().alias("kept")).collect()
    same = [r for r in pairs if newness.same_headline(r.words, r.other_words)]
    assert len(same) > 40 and all(r.kept for r in same)


def test_trees_for():
    t = newness.trees_for(0.6, 2, 0.99)
    assert 1 - (1 - 0.36) ** t >= 0.99 > 1 - (1 - 0.36) ** (t - 1)


def test_components_are_whole_or_an_error(spark):
    order = random.Random(5).sample(range(200), 200)
    links = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(order, order[1:])], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in range(200)], "node long")
    assert {r["class"] for r in near_dupes.components(links, nodes).collect()} == {0}
    with pytest.raises(RuntimeError):
        near_dupes.components(links, nodes, rounds=1)
