"""Landed files as tables. The schema is stated, never inferred from data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Transient and stored records.
SCHEMAS = {
    "cards": "card_id long, lote long, ord int, titulo string, url string, imagen_url string, seccion string, fuente string, visto_at timestamp",
    "pages": "page_id long, url string, html string",
    "notices": "notice_id long, raw_text string",
    # one row a site: its selectors, and those of its articles' text in order; null where it has none of its own
    "sites": "clave string, dominio string, fuente string, base_url string, card string, title string, link string, image string, section string, content array<string>",
    "noticias": "id string, titulo string, cuerpo string, resumen_seo string, seccion string, estado string, fuente string, url_original string, imagen_url string, instagram_text string, twitter_text string, guion_video string, instagram_titulo string, slug string, es_portada boolean, orden_portada int, imagen_fuente string, instagram_descartado boolean, grupo_id string, titulo_original string, fuentes_urls array<struct<fuente: string, url: string>>, fecha_publicacion timestamp, created_at timestamp",
    "scraper_config": "id int, activo boolean, fuentes_activas array<string>, fecha_inicio timestamp, updated_at timestamp",
}


def landed(spark: SparkSession, path: str, name: str, form: str = "parquet") -> DataFrame:
    """A landed table in parquet, orc, json or csv (arrays and structs not in csv)."""
    reader = spark.read.schema(SCHEMAS[name])
    return reader.option("header", True).csv(path) if form == "csv" else reader.format(form).load(path)
