import random

import pytest
from pyspark.sql import functions as F

from gacetilla.operators import cluster, ingest, lifecycle, services
from gacetilla.sources import tables as S
from gacetilla.streaming.ingest import append_unseen, landed_stream


def test_leaders_are_greedy(spark):
    rnd = random.Random(3)
    for n, k in ((1, 0), (12, 15), (40, 90)):
        pairs = sorted({tuple(sorted(rnd.sample(range(n), 2))) for _ in range(k)}) if n > 1 else []
        near, leader = set(pairs), {}
        for i in range(n):
            if i not in leader:
                leader[i] = i
                for j in range(i + 1, n):
                    if j not in leader and (i, j) in near:
                        leader[j] = i
        ready = spark.createDataFrame([(i,) for i in range(n)], "ord long")
        got = cluster.leader_clusters(ready, spark.createDataFrame(pairs, "a long, b long")).collect()
        assert {r.ord: r.leader for r in got} == leader


def test_similarity_rules(spark):
    rows = [
        (1, "Incendio destruyó galpón avenida Colón bomberos", "Policiales"), (2, "Bomberos: incendio galpón avenida Colón destruyó", "policiales"), (3, "Incendio destruyó galpón avenida Colón bomberos", "Deportes"),
        (4, "uno dos tres", "Policiales"), (5, "uno dos tres", "Policiales"), (6, None, None),
    ]
    ready = cluster.prepared(spark.createDataFrame(rows, "ord long, titulo string, seccion string"))
    assert [(r.a, r.b, round(r.sim, 6)) for r in cluster.similar_pairs(ready).collect()] == [(1, 2, 1.0)]


def test_similar_pairs_against_brute_force(spark):
    import itertools
    import math

    rnd = random.Random(5)
    words = [f"palabra{chr(97 + i)}" for i in range(26)]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(3, 8))), rnd.choice(["Salud", "Cultura", "Deportes"])) for i in range(60)]
    ready = cluster.prepared(spark.createDataFrame(rows, "ord long, titulo string, seccion string"))
    have = {r.ord: (r["class"], set(r.tokens), set(r.entities)) for r in ready.collect()}
    df = {w: sum(w in t for _, t, _ in have.values()) for w in words}
    idf = {w: math.log((len(rows) + 1) / (df[w] + 1)) + 1 for w in words}
    want = set()
    for a, b in itertools.combinations(sorted(have), 2):
        (ca, ta, ea), (cb, tb, eb) = have[a], have[b]
        if ca == cb and min(len(ta), len(tb)) >= 4:
            sim = sum(idf[t] for t in ta & tb) / min(sum(idf[t] for t in ta), sum(idf[t] for t in tb))
            if sim >= 0.4 or sim >= 0.25 and len(ea & eb) >= 2:
                want.add((a, b))
    assert {(r.a, r.b) for r in cluster.similar_pairs(ready).collect()} == want


@pytest.fixture(scope="module")
def notes(spark):
    rows = [("a", "raw", "g1", "2026-01-01"), ("b", "pendiente", None, "2025-12-30"), ("c", "raw", "g1", "2025-12-31"), ("d", "publicada", "g2", "2020-01-01"), ("e", "raw", None, "2026-01-10")]
    return spark.createDataFrame(rows, "id string, estado string, grupo_id string, d string").select("id", "estado", "grupo_id", F.to_timestamp("d").alias("created_at"))


def states(df):
    return {r.id: r.estado for r in df.collect()}


def test_lifecycle(spark, notes):
    as_of = F.to_timestamp(F.lit("2026-01-15"))
    # 2025-12-31 is exactly 15 days old and stays
    assert states(lifecycle.expired(notes, as_of)) == {"a": "raw", "b": "descartada", "c": "raw", "d": "publicada", "e": "raw"}
    assert states(lifecycle.orphans_discarded(notes))["b"] == "descartada" and states(lifecycle.orphans_discarded(notes))["e"] == "raw"
    chosen = spark.createDataFrame([("g1", "a")], "grupo_id string, id string")
    assert states(lifecycle.siblings_discarded(notes, chosen)) == {"a": "raw", "b": "pendiente", "c": "descartada", "d": "publicada", "e": "raw"}
    assert lifecycle.state_counts(notes).first().asDict() == {"publicadas": 1, "pendientes": 1, "descartadas": 0}


def test_upsert_updates_first_and_is_idempotent(spark):
    t = spark.createDataFrame([(1, "x", "old"), (2, "x", "old"), (3, "y", "old")], "id int, slug string, v string")
    d = spark.createDataFrame([("x", "new"), ("z", "new")], "slug string, v string")
    once = lifecycle.upserted(t, d, "slug", ["v"], ["id"])
    want = [(1, "x", "new"), (2, "x", "old"), (3, "y", "old"), (None, "z", "new")]
    assert sorted(map(tuple, once.collect()), key=str) == sorted(want, key=str)
    assert sorted(map(tuple, lifecycle.upserted(once, d, "slug", ["v"], ["id"]).collect()), key=str) == sorted(want, key=str)


def test_front_page(spark):
    t = spark.createDataFrame([("a", "2026-01-15 00:00:00", True), ("b", "2026-01-15 23:59:59.5", True), ("c", None, True), ("d", "2026-01-15 10:00:00", False)], "id string, f string, es_portada boolean").withColumn("fecha_publicacion", F.to_timestamp("f"))
    day = F.to_timestamp(F.lit("2026-01-15 09:00:00"))
    assert {r.id: r.es_portada for r in lifecycle.front_page(t, "d", day).collect()} == {"a": False, "b": True, "c": True, "d": True}
    assert {r.id: r.es_portada for r in lifecycle.front_page(t, "d", day, True).collect()}["b"] is False


def test_config(spark):
    cfg = "id int, activo boolean, fuentes_activas array<string>, fecha_inicio timestamp"
    src = spark.createDataFrame([("f1",), ("f2",)], "clave string")
    keys = lambda c: sorted(r.clave for r in S.active_sources(src, spark.createDataFrame(c, cfg)).collect())
    assert keys([(1, True, ["f2", "f9"], None)]) == ["f2"] and keys([(1, True, [], None)]) == ["f1", "f2"] and keys([]) == ["f1", "f2"]
    run = lambda c: S.may_run(spark.createDataFrame(c, cfg), F.to_timestamp(F.lit("2026-01-01"))).first().may_run
    import datetime as dt

    assert run([]) and not run([(1, False, None, None)]) and not run([(1, True, None, dt.datetime(2027, 1, 1))]) and run([(1, True, None, dt.datetime(2025, 1, 1))])


def test_group_limit_comes_before_known(spark):
    m = spark.createDataFrame([(1, 1, "u1"), (2, 2, "u2"), (2, 3, "u3"), (4, 4, None), (5, 5, "u5")], "leader long, ord long, url string")
    known = spark.createDataFrame([("u1",), ("u2",)], "url string")
    assert sorted(r.ord for r in ingest.first_groups(m, known, 3).collect()) == [2, 3]


def test_stored_once_and_cards(spark):
    n = spark.createDataFrame([(1, "u", "x" * 59), (2, "u", "x" * 60), (3, "u", "x" * 70)], "i int, url string, cuerpo string")
    assert [r.i for r in ingest.stored_once(n, ["i"]).collect()] == [2]
    c = spark.createDataFrame([("1234567", "http://a/1"), ("12345678", "http://a/1"), ("12345678", "http://a/tag/1"), ("12345678", "")], "titulo string, url string")
    assert ingest.usable_cards(c).count() == 1


NOTICES = "Falleció nadie\nPérez, Juan\nFalleció el 3/2/24\ncasa\nGómez, Ana\nFalleció el 5 de marzo de 2024\nLópez\nfallecio sin fecha"


def test_notices(spark):
    df = spark.createDataFrame([(1, NOTICES), (2, None), (3, "nada")], "k int, t string")
    rows = [(r.nombre, r.anio, r.mes, r.cuerpo) for r in services.notices(df, "k", "t").orderBy("start").collect()]
    assert rows == [("Pérez, Juan", 2024, 2, "Falleció el 3/2/24\ncasa"), ("Gómez, Ana", 2024, 3, "Falleció el 5 de marzo de 2024")]
    m = services.by_month(services.notices(df, "k", "t"), ["k", "start"]).collect()
    assert [(r.slug, r.mes_nombre, r.cantidad) for r in m] == [("2024-03", "Marzo", 1), ("2024-02", "Febrero", 1)]


def test_shift_table(spark):
    texts = ["Cab\nTurnos del mes de mayo\nCentro\nPlaya\n1\nA\nB\n1\nC", "uno\n\ndos", "Turnos del mes\n2\nZ"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: r.cuerpo for r in services.shift_table(df, "k", "t").collect()}
    assert got[0] == "Cab\n\n## Turnos del mes de mayo\n\nCentro · Playa\n\n### Día 1\n\nA · B\n\n### Día 1\n\nC"
    assert got[1] == "uno\n\ndos" and got[2] == "\n\n## Turnos del mes\n\n### Día 2\n\nZ"


def test_rewriter_reports_failures(spark):
    tried = []

    def answer(p):
        tried.append(p)
        if p == "mal":
            raise RuntimeError("no")
        if p == "lento" and len(tried) < 3 or p == "nunca":
            raise ingest.Retry("429")
        return p.upper() if p != "nada" else " "

    def ask(*prompts):
        return [(r.id, r.answer, r.error) for r in ingest.rewritten_by(spark.createDataFrame([(p, p) for p in prompts], "id string, prompt string").coalesce(1), answer, pauses=()).collect()]

    assert ask("ok", "mal", "nada", "nunca") == [("ok", "OK", None), ("mal", None, "RuntimeError: no"), ("nada", None, "empty"), ("nunca", None, "Retry: 429")]
    assert ask("lento") == [("lento", "LENTO", None)]


def test_single_rows_and_sites(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    assert [tuple(r) for r in S.single_rows(t, "k", spark.createDataFrame([(1,), (1,), (2,), (3,)], "k int"), ["v"]).collect()] == [(1, "a")]
    pages = spark.createDataFrame([("https://www.a.ar/x",), ("https://b.ar/",), (None,)], "url string")
    sites = spark.createDataFrame([("A.ar", "uno"), ("a.ar", "dos")], "dominio string, fuente string").limit(1)
    assert {r.url: r.fuente for r in S.with_site(pages, sites).collect()} == {"https://www.a.ar/x": "uno", "https://b.ar/": None, None: None}


def test_gate_ignores_what_is_no_instant(spark):
    cfg = "id int, activo boolean, fuentes_activas array<string>, fecha_inicio string"
    run = lambda t: S.may_run(spark.createDataFrame([(1, True, None, t)], cfg), F.to_timestamp(F.lit("2026-01-01"))).first().may_run
    assert [run(t) for t in ("2027-01-01T00:00:00Z", "2025-01-01T00:00:00Z", "2027-01-01T00:00:00", "pronto", None)] == [False, True, True, True, True]


def test_stream_stores_each_address_once(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "card_id long, url string").repartition(3).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        append_unseen(landed_stream(spark, f"{tmp_path}/in", "card_id long, url string"), f"{tmp_path}/store", f"{tmp_path}/progress", ["card_id"]).awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(f"{tmp_path}/store").collect()) == ["a", "b"]


class _Session:
    """A session without spark.checkpoint.dir."""

    def __init__(self, master):
        self.conf = type("C", (), {"get": staticmethod(lambda k, d: d)})
        self.sparkContext = type("S", (), {"master": master, "applicationId": f"app-{master}"})


def test_shared_folder_without_setting(spark):
    assert S.shared_folder(_Session("local[2]")) == S.shared_folder(_Session("local[2]"))
    with pytest.raises(ValueError):
        S.shared_folder(_Session("spark://host:7077"))
    assert S.shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_scratch_is_removed(spark):
    import os

    cluster.written(spark.range(3), "x")
    assert os.listdir(S.shared_folder(spark))
    S.discard_scratch(spark)
    assert not os.path.exists(S.shared_folder(spark))


def test_properties(spark, notes):
    as_of = F.to_timestamp(F.lit("2030-01-01"))
    assert states(lifecycle.expired(notes, as_of))["d"] == "publicada"
    cards = spark.createDataFrame([(1, "u"), (2, "u"), (3, "v"), (4, None)], "i int, url string")
    once = ingest.unseen(cards, spark.createDataFrame([], "url string"), ["i"])
    assert sorted(r.i for r in once.collect()) == [1, 3]
    assert ingest.unseen(cards, once.select("url"), ["i"]).count() == 0
    df = spark.createDataFrame([(1, NOTICES)], "k int, t string")
    lines = [x for r in services.notices(df, "k", "t").collect() for x in r.cuerpo.split("\n")]
    assert len(lines) == len(set(lines))
