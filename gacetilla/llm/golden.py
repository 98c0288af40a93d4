"""One surviving record for each group of duplicates, chosen field by field.

Fields are unpivoted to long rows; each usable value gets votes, the sum over its records of source trust times
recency decay, by normalised value; winners are chosen by max_by and pivoted back.

``order="votes"`` takes the value with the most votes. ``order="trust"`` takes the value whose best record comes
from the most trusted source and is then the latest, votes breaking ties: a sum of votes cannot give that order,
since many records of a lesser source outvote one of a better.

Scale: texts are reduced to a flag and a key in one Arrow pass; everything after is map-side combined on (group,
field, value), so a group with a third of all rows costs no task more than another.

Defined results: records without a group are left out; a record delivered twice counts once; groups of one record
are left out unless ``least_records`` is 1; a source that is null or not listed has trust 0; full ties take the
greatest id; a field without a usable value has no row (null after pivoting).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gacetilla.llm.boilerplate import Sites
from gacetilla.llm.lines import is_whole, main_lines
from gacetilla.llm.text import clean_space, fold, source_key, stable_hash

FIELDS = ("cuerpo", "imagen_url", "fuente")
#: Parts of the last path segment, or folders, that mark stand-ins and site graphics.
STAND_INS = r"(?i)(?:^|[/_.-])(?:blank|placeholder|sin[-_]?foto|sin[-_]?imagen|no[-_]?image|default(?:[-_][a-z]+)?|logo|1x1|pixel|spacer|avatar|favicon|icon|transparent|banner|loading|share)(?:[/_.?-]|\d|$)|\.svg(?:\?|$)"
PICTURE = r"(?i)^https?://[^/\s?#]+\.[^/\s?#]+/[^\s]+$"


def usable_picture(c: Column) -> Column:
    """An absolute http(s) address of a picture that is neither a stand-in nor a site graphic."""
    path = F.regexp_replace(F.trim(c), r"(?i)^https?://[^/]*", "")
    return F.coalesce(F.trim(c).rlike(PICTURE) & ~path.rlike(STAND_INS), F.lit(False))


def _body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = []
        for text, gone in zip(batch.column("cuerpo").to_pylist(), batch.column("gone").to_pylist()):
            own = main_lines(text, gone)
            keys.append((stable_hash(fold("\n".join(s for _, s in own))) >> 1) if is_whole(own) else None)
        names = [n for n in batch.schema.names if n not in ("cuerpo", "gone")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(keys, pa.int64())], names=[*names, "body"])


def votes(notes: DataFrame, sources: DataFrame, half_life_days: float = 30.0) -> DataFrame:
    """Long rows (grupo_id, campo, value, votes, best, low, high): one for each usable value of a field, and one with
    a null value for the records without; best is the best record as struct(trust, created_at, id)."""
    trust = sources.select(source_key(F.col("nombre")).alias("source"), F.col("confianza").alias("trust")).groupBy("source").agg(F.max("trust").alias("trust"))
    kept = notes.where("grupo_id is not null and id is not null").select(
        "id", "grupo_id", "fuente", "url_original", source_key(F.col("fuente")).alias("source"), F.col("fuente").isNotNull().alias("named"), F.when(usable_picture(F.col("imagen_url")), F.xxhash64(F.trim("imagen_url"))).alias("picture"), "created_at", "cuerpo"
    )
    narrow = Sites(notes).marked(kept, ["id", "grupo_id", "source", "named", "picture", "created_at", "cuerpo"], _body, "id string, grupo_id string, source string, named boolean, picture long, created_at timestamp, body long").dropDuplicates(["id"])
    narrow = narrow.join(trust, "source", "left").withColumn("trust", F.coalesce("trust", F.lit(0)))
    age = F.coalesce(F.col("created_at").cast("double") / 86400.0, F.lit(0.0)) - 20000.0
    weight = F.col("trust") * F.pow(F.lit(2.0), age / half_life_days)
    values = {"cuerpo": F.col("body"), "imagen_url": F.col("picture"), "fuente": F.when(F.col("named"), F.xxhash64(F.coalesce("source", F.lit(""))))}
    long = narrow.select("id", "grupo_id", "trust", "created_at", weight.alias("weight"), F.explode(F.array(*[F.struct(F.lit(k).alias("campo"), v.alias("value")) for k, v in values.items()])).alias("f"))
    return long.groupBy("grupo_id", F.col("f.campo").alias("campo"), F.col("f.value").alias("value")).agg(
        F.sum("weight").alias("votes"), F.max(F.struct("trust", "created_at", "id")).alias("best"), F.min("id").alias("low"), F.max("id").alias("high")
    )


def winners(long: DataFrame, order: str = "votes", least_records: int = 2) -> DataFrame:
    """(grupo_id, campo, id): the record whose value survives."""
    rank = F.struct("votes", "best") if order == "votes" else F.struct("best.trust", "best.created_at", "votes", "best.id")
    chosen = long.groupBy("grupo_id", "campo").agg(
        F.max_by(F.when(F.col("value").isNotNull(), F.col("best.id")), F.when(F.col("value").isNotNull(), rank)).alias("id"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    several = F.col("low") != F.col("high") if least_records > 1 else F.lit(True)
    return chosen.where(several & F.col("id").isNotNull()).select("grupo_id", "campo", "id")


def best_record(notes: DataFrame, sources: DataFrame, order: str = "votes") -> DataFrame:
    """(grupo_id, cuerpo, imagen_url, fuente and the id each comes from): the surviving record of each group."""
    won = winners(votes(notes, sources), order)
    # each surviving value meets its record once, by id; rows of a group are then pivoted back
    fields = won.groupBy("id").agg(F.collect_set(F.struct("grupo_id", "campo")).alias("_won"))
    records = notes.select("id", *[(clean_space(F.col(f)) if f != "cuerpo" else F.col(f)).alias(f"_{f}") for f in FIELDS]).join(fields, "id").dropDuplicates(["id"])
    value = F.element_at(F.create_map(*[x for f in FIELDS for x in (F.lit(f), F.col(f"_{f}"))]), F.col("w.campo"))
    long = records.select("id", *[f"_{f}" for f in FIELDS], F.explode("_won").alias("w")).select(F.col("w.grupo_id").alias("grupo_id"), F.col("w.campo").alias("campo"), F.struct(value.alias("v"), "id").alias("r"))
    wide = long.groupBy("grupo_id").pivot("campo", list(FIELDS)).agg(F.first("r"))
    return wide.select("grupo_id", *[c for f in FIELDS for c in (F.col(f"{f}.v").alias(f), F.col(f"{f}.id").alias(f"{f}_id"))])
