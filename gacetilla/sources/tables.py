"""Landed tables and the points where a run reads them."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gacetilla.functions.dates import iso_instant
from gacetilla.functions.text import strip, url_domain


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_FALLBACK: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below the one that all executors share, as spark.checkpoint.dir names it.

    Where it is unset, a temporary folder serves a session on one machine; a cluster must name one."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        d = _FALLBACK.get(app) or _FALLBACK.setdefault(app, tempfile.mkdtemp(prefix="gacetilla-shared-"))
    return f"{d.rstrip('/')}/gacetilla-{spark.sparkContext.applicationId}"


def discard_scratch(spark: SparkSession) -> None:
    """Removes all intermediate tables of this application. Results that still read them must have been stored before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def known_urls(notes: DataFrame, column: str = "url_original") -> DataFrame:
    """(url): distinct, stripped, not empty. An error is raised, not taken for an empty set."""
    return notes.select(strip(F.col(column)).alias("url")).where("url is not null and url <> ''").distinct()


def config_row(config: DataFrame) -> DataFrame:
    """One row (activo, fuentes_activas, fecha_inicio): the row with id 1 with defaults for what is missing."""
    found = config.where("id = 1").agg(F.first("activo").alias("activo"), F.first("fuentes_activas").alias("fuentes_activas"), F.first("fecha_inicio").alias("fecha_inicio"))
    return found.select(F.coalesce("activo", F.lit(True)).alias("activo"), "fuentes_activas", "fecha_inicio")


def gate(active: Column, start: Column, as_of: Column) -> Column:
    """Active and not scheduled for later; a start that is null or was no instant holds nothing back."""
    return F.coalesce(active, F.lit(True)) & F.coalesce(start <= as_of, F.lit(True))


def may_run(config: DataFrame, as_of: Column) -> DataFrame:
    """One row (may_run): active and not scheduled for later. A textual start is read as an instant with an offset, else ignored."""
    start = F.col("fecha_inicio") if dict(config.dtypes)["fecha_inicio"].startswith("timestamp") else iso_instant(F.col("fecha_inicio"))
    return config_row(config).select(gate(F.col("activo"), start, as_of).alias("may_run"))


def single_rows(table: DataFrame, key: str, asked: DataFrame, columns: list[str]) -> DataFrame:
    """(key, columns) of the asked keys (a column of that name) that exactly one row has; keys of none or several give no row."""
    one = table.join(asked.select(key).distinct(), key).groupBy(key).agg(F.count("*").alias("_n"), F.first(F.struct(*columns)).alias("_r"))
    return one.where("_n = 1").select(key, *[F.col(f"_r.{c}").alias(c) for c in columns])


def with_site(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """Landed pages (url) with the columns of their site (dominio, fuente and its selectors); null where the site is not listed.

    The sites are a list kept by hand, one row a domain; without a statistic of its size Spark decides how to join it."""
    own = sites.withColumn("_d", F.lower("dominio")).dropDuplicates(["_d"])
    return pages.withColumn("_d", url_domain(F.col("url"))).join(own, "_d", "left").drop("_d")


def active_sources(sources: DataFrame, config: DataFrame, key: str = "clave") -> DataFrame:
    """Rows of the sources that the configuration names; all of them if it names none. Unknown names are ignored."""
    named = config_row(config).first()["fuentes_activas"]
    return sources.where(F.col(key).isin(named)) if named else sources


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """Bag union by name; a column that a source lacks is null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def by_ids(notes: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """Rows of an id list with their place in the list, so that the first is the leader; an empty list gives no rows."""
    spark = notes.sparkSession
    asked = spark.createDataFrame([(str(x), i) for i, x in enumerate(ids)], "id string, place int")
    return notes.join(asked, "id").select("place", *columns)
