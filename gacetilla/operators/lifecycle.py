"""Next states of a record table: conditional updates, upserts and counts.

Plain parquet has no row-level updates, so each operator gives the next state of the whole table in one projection over
one snapshot; counts are taken over the same snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gacetilla.functions.text import strip


def updated(table: DataFrame, when: Column, values: dict[str, Column]) -> DataFrame:
    """Rows where ``when`` holds get the values; null is not true."""
    hit = F.coalesce(when, F.lit(False))
    return table.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in values.items()})


def counts_by(table: DataFrame, cases: dict[str, Column]) -> DataFrame:
    """One row with the number of rows of each case, in a single scan."""
    return table.agg(*[F.count_if(c).alias(k) for k, c in cases.items()])


def state_counts(table: DataFrame) -> DataFrame:
    return counts_by(table, {"publicadas": F.col("estado") == "publicada", "pendientes": F.col("estado") == "pendiente", "descartadas": F.col("estado") == "descartada"})


def expired(table: DataFrame, as_of: Column, days: int = 15) -> DataFrame:
    """Raw and pending rows created strictly before as_of minus the days are discarded."""
    return updated(table, F.col("estado").isin("pendiente", "raw") & (F.col("created_at") < as_of - F.make_dt_interval(F.lit(days))), {"estado": F.lit("descartada")})


def orphans_discarded(table: DataFrame) -> DataFrame:
    """Pending rows without a group are discarded."""
    return updated(table, (F.col("estado") == "pendiente") & F.col("grupo_id").isNull(), {"estado": F.lit("descartada")})


def siblings_discarded(table: DataFrame, chosen: DataFrame) -> DataFrame:
    """Raw rows of the groups of chosen (grupo_id, id) other than the chosen rows are discarded."""
    c = chosen.select("grupo_id", F.col("id").alias("_chosen")).dropDuplicates(["grupo_id"])
    joined = table.join(c, "grupo_id", "left")
    return updated(joined, (F.col("id") != F.col("_chosen")) & (F.col("estado") == "raw"), {"estado": F.lit("descartada")}).select(table.columns)


def front_page(table: DataFrame, note_id: str, day: Column, half_open: bool = False) -> DataFrame:
    """Rows published on the day lose the flag, then one row gets it. The day ends with its last whole second, or with its
    end if half_open."""
    start = F.date_trunc("day", day)
    end = start + F.expr("INTERVAL 1 DAY")
    today = (F.col("fecha_publicacion") >= start) & (F.col("fecha_publicacion") < end if half_open else F.col("fecha_publicacion") <= end - F.expr("INTERVAL 1 SECOND"))
    flag = F.when(F.col("id") == note_id, True).when(F.coalesce(today, F.lit(False)), False).otherwise(F.col("es_portada"))
    return table.withColumn("es_portada", flag)


def published(table: DataFrame, note_ids: list[str], state: str, as_of: Column) -> DataFrame:
    """A new state for some rows; publishing also stamps the time."""
    hit = F.col("id").isin(note_ids)
    values = {"estado": F.lit(state)} | ({"fecha_publicacion": as_of} if state == "publicada" else {})
    return updated(table, hit, values)


def raw_rows(notes: DataFrame) -> DataFrame:
    """Rows to append for fetched notes (id, titulo_original, cuerpo, seccion, fuente, url_original, imagen_url, slug, grupo_id)."""
    empty = ["resumen_seo", "instagram_text", "twitter_text", "guion_video"]
    return notes.select(
        "id", F.col("titulo_original").alias("titulo"), "cuerpo", F.coalesce("seccion", F.lit("Local")).alias("seccion"), F.lit("raw").alias("estado"), "fuente", "url_original", "imagen_url", "slug", "grupo_id", "titulo_original",
        *[F.lit("").alias(c) for c in empty], F.lit(False).alias("es_portada"),
    )


def pending_rows(notes: DataFrame) -> DataFrame:
    """Rows to append for finished notes: as they are, titles, texts and slugs without outer blanks (empty where null)."""
    bare = [strip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("titulo", "cuerpo", "slug")]
    kept = ["resumen_seo", "url_original", "imagen_url", "instagram_text", "instagram_titulo", "twitter_text", "guion_video"]
    return notes.select("id", *bare, *kept, F.coalesce("seccion", F.lit("General")).alias("seccion"), F.lit("pendiente").alias("estado"), F.lit(False).alias("es_portada"))


def discard_counts(table: DataFrame, as_of: Column, days: int = 15) -> DataFrame:
    """One row with how many rows the discards would touch, over one snapshot: pending without group, and old pending and raw ones."""
    old = F.col("created_at") < as_of - F.make_dt_interval(F.lit(days))
    pending, raw = F.col("estado") == "pendiente", F.col("estado") == "raw"
    return counts_by(table, {"huerfanas": pending & F.col("grupo_id").isNull(), "pendientes_viejas": pending & old, "raw_viejas": raw & old})


def with_picture(table: DataFrame, pictures: DataFrame) -> DataFrame:
    """Keyed update of a picture and its source by pictures (id, imagen_url, imagen_fuente)."""
    new = pictures.select(F.col("id").alias("_id"), F.struct("imagen_url", "imagen_fuente").alias("_p")).groupBy("_id").agg(F.min("_p").alias("_p"))
    return updated(table.join(new, F.col("id") == F.col("_id"), "left"), F.col("_id").isNotNull(), {c: F.col(f"_p.{c}") for c in ("imagen_url", "imagen_fuente")}).select(table.columns)


def with_section(table: DataFrame, key: str, value: str, section: str) -> DataFrame:
    """A new section for the rows whose key column has the value (an id, or a group)."""
    return updated(table, F.col(key) == value, {"seccion": F.lit(section)})


def rewritten(table: DataFrame, rewrites: DataFrame, columns: list[str], if_given: list[str] = ()) -> DataFrame:
    """Keyed update by rewrites (id, ...): the columns are taken over, those of ``if_given`` only where neither null nor empty;
    the section falls back to the stored one. The rows become pending."""
    new = rewrites.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in [*columns, *if_given, "seccion_sugerida"]]).dropDuplicates(["_id"])
    joined = table.join(new, F.col("id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    kinds = dict(table.dtypes)

    def given(c: str) -> Column:
        some = F.col(f"_{c}").isNotNull()
        return some & (F.size(f"_{c}") > 0) if kinds[c].startswith("array") else some & (F.col(f"_{c}") != "")

    out = {c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}
    out |= {c: F.when(hit & given(c), F.col(f"_{c}")).otherwise(F.col(c)) for c in if_given}
    out["seccion"] = F.when(hit & (F.coalesce(F.col("_seccion_sugerida"), F.lit("")) != ""), F.col("_seccion_sugerida")).otherwise(F.col("seccion"))
    out["estado"] = F.when(hit, F.lit("pendiente")).otherwise(F.col("estado"))
    return joined.withColumns(out).select(table.columns)


def upserted(table: DataFrame, delta: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """Of the rows with a key of the delta the first (by ``order``) gets the delta's columns; keys that the table lacks are inserted.

    The delta's last row of a key counts only if it is unique: repeated keys of the delta keep the least row."""
    one = delta.select(key, *columns).groupBy(key).agg(F.min(F.struct(*columns)).alias("_d"))
    placed = table.withColumn("_first", F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1)
    joined = placed.join(one, key, "full_outer")
    take = F.col("_d").isNotNull() & F.coalesce(F.col("_first"), F.lit(True))
    return joined.withColumns({c: F.when(take, F.col(f"_d.{c}")).otherwise(F.col(c)) for c in columns}).select(table.columns)


def seeded(table: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    """Seed rows appended unless their key is there already."""
    return table.unionByName(seed.dropDuplicates([key]).join(table.select(key), key, "left_anti"), allowMissingColumns=True)


def last_rows(table: DataFrame, k: int, by: str, tie: str) -> DataFrame:
    return table.orderBy(F.desc(by), tie).limit(k)
