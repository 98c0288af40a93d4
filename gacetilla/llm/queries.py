"""Queries over the whole tables, one or more for each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gacetilla.llm import boilerplate, canonical, golden, leakage, near_dupes, newness, packing, repeated_lines, residue, subjects
from gacetilla.llm.text import table

Query = Callable[[SparkSession, str], DataFrame]

def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    long = golden.votes(table(spark, folder, "noticias"), table(spark, folder, "fuentes"))
    return golden.winners(long, order="trust")


def p1_best_record(spark: SparkSession, folder: str) -> DataFrame:
    return golden.best_record(table(spark, folder, "noticias"), table(spark, folder, "fuentes"))


def _history_and_cards(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    history = table(spark, folder, "noticias").select(F.concat(F.lit("n"), "id").alias("key"), "titulo", F.col("url_original").alias("url"))
    return history, table(spark, folder, "cards").select(F.concat(F.lit("c"), "card_id").alias("key"), "lote", "titulo", "url")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    known = newness.known_entries(*_history_and_cards(spark, folder))
    return known.select(F.substring("key", 2, 40).cast("long").alias("card_id"))


def p2_new(spark: SparkSession, folder: str) -> DataFrame:
    fresh = newness.new_entries(*_history_and_cards(spark, folder))
    return fresh.select(F.substring("key", 2, 40).cast("long").alias("card_id"), "lote", "titulo", "url")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_lines.repeated_lines(table(spark, folder, "noticias")).select("id", "line_no")


def p3_clean(spark: SparkSession, folder: str) -> DataFrame:
    notes = table(spark, folder, "noticias")
    return repeated_lines.without_repeated_lines(notes, repeated_lines.repeated_lines(notes))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.find_subjects(table(spark, folder, "noticias"), table(spark, folder, "etiquetas"), table(spark, folder, "temas")).select("id", "tema_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.find_boilerplate(table(spark, folder, "noticias"))


def p5_main_text(spark: SparkSession, folder: str) -> DataFrame:
    notes = table(spark, folder, "noticias")
    return boilerplate.main_text(notes, boilerplate.find_boilerplate(notes))


def _section_names(spark: SparkSession, folder: str) -> DataFrame:
    each = F.explode(F.array_union(F.array("nombre"), F.coalesce("alias", F.array().cast("array<string>")))).alias("name")
    return table(spark, folder, "secciones").select(F.col("seccion_id").alias("key"), each, "nombre").select("key", "name", (F.col("name") == F.col("nombre")).alias("is_name"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    mapped = canonical.map_to_canonical(table(spark, folder, "noticias"), "seccion", _section_names(spark, folder), keep_exact=False)
    return mapped.select("id", F.col("key").alias("seccion_id"))


def p6_values(spark: SparkSession, folder: str) -> DataFrame:
    notes = table(spark, folder, "noticias").select(F.col("seccion").alias("value")).where(F.trim("value") != "")
    return canonical.match_values(notes, _section_names(spark, folder))


def _note_sets(spark: SparkSession, folder: str, n: int) -> DataFrame:
    return near_dupes.article_sets(table(spark, folder, "noticias"), n)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    sets = _note_sets(spark, folder, 3)
    return near_dupes.near_pairs(sets, near_dupes.node_links(sets, 3, (3, 5)))


def p7_groups(spark: SparkSession, folder: str) -> DataFrame:
    sets = _note_sets(spark, folder, 3)
    return near_dupes.near_groups(sets, near_dupes.node_links(sets, 3, (3, 5)))


#: File of the public byte-level vocabulary.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def p8_pack(spark: SparkSession, folder: str, tokenizer: str = TOKENIZER, capacity: int = 2048) -> DataFrame:
    return packing.pack(packing.token_counts(table(spark, folder, "documents"), tokenizer), capacity)


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(p8_pack(spark, folder))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.find_residue(table(spark, folder, "documents"))


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}
