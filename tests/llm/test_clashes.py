"""Extra columns with the names that the operators use inside change nothing."""

import os

import pytest
from pyspark.sql import functions as F

from gacetilla.llm import boilerplate, canonical, golden, leakage, near_dupes, newness, repeated_lines, residue, subjects
from gacetilla.llm.queries import _section_names

FOLDER = "/root/testdata/sf0.001"
CLASHES = "key host path nos toks sorts source keys doc body trust weight best votes value codes tok line_no documents share node words n lote link tidy cut pairs name piece size salt rank item_id posterior tema_id gone shared seen within compared".split()


def wide(df):
    return df.withColumns({c: F.lit(1) for c in CLASHES if c not in df.columns})


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_clashing_columns(spark):
    t = lambda n: spark.read.parquet(f"{FOLDER}/{n}.parquet")
    notes, docs = t("noticias"), t("documents")
    runs = [
        lambda w: boilerplate.find_boilerplate(w(notes)), lambda w: golden.winners(golden.votes(w(notes), t("fuentes")), "trust"), lambda w: repeated_lines.repeated_lines(w(notes)).select("id", "line_no"),
        lambda w: subjects.find_subjects(w(notes), t("etiquetas"), t("temas")).select("id", "tema_id"), lambda w: canonical.map_to_canonical(w(notes), "seccion", _section_names(spark, FOLDER)), lambda w: residue.find_residue(w(docs)), lambda w: leakage.find_leaks(w(docs), t("benchmark")),
        lambda w: near_dupes.ngram_sets(w(notes).withColumn("text", F.col("cuerpo")), 3).select("id", "node"),
        lambda w: newness.known_entries(w(notes).withColumn("key", F.col("id")).withColumn("url", F.col("url_original")), w(t("cards")).withColumn("key", F.col("card_id").cast("string"))),
    ]
    for run in runs:
        plain, clashing = (sorted(map(tuple, run(w).collect()), key=str) for w in (lambda df: df, wide))
        assert plain == clashing
