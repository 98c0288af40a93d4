"""Headlines about one event: IDF-weighted overlap join and greedy leader clustering.

The join is exact. A pair with overlap of at least t shares one of the heaviest tokens of its lighter headline, those
before the rest weighs less than t of the whole; only these are joined, within a class of compatible sections. Leaders
are found by rounds: a headline without earlier undecided or leading neighbours leads, one with a leading neighbour
follows the first of them. This equals one pass in order, and no task holds a class.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

from gacetilla.functions import text as T
from gacetilla.sources.tables import shared_folder

LEAST_TOKENS = 4


def written(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prepared(notes: DataFrame, titulo: Column | str = "titulo", seccion: Column | str = "seccion") -> DataFrame:
    """(ord, class, tokens, entities) of notes (ord, titulo, seccion)."""
    return notes.select("ord", T.section_class(F.col(seccion)).alias("class"), T.significant_tokens(F.col(titulo)).alias("tokens"), T.title_entities(F.col(titulo)).alias("entities"))


def token_idf(ready: DataFrame) -> DataFrame:
    """(token, df, idf): idf = ln((N + 1) / (df + 1)) + 1 over all notes, short headlines included."""
    counted = ready.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    n = ready.count()
    return counted.select("token", "df", (F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def similar_pairs(ready: DataFrame, strong: float = 0.40, gray: float = 0.25, least_entities: int = 2) -> DataFrame:
    """(a, b, sim, shared) with a < b: pairs of compatible sections whose weighted overlap is strong, or gray with shared entities."""
    weighed = ready.where(F.size("tokens") >= LEAST_TOKENS).select("ord", "class", F.explode("tokens").alias("token")).join(token_idf(ready).select("token", "idf"), "token")
    heavy_first = Window.partitionBy("ord").orderBy(F.desc("idf"), "token")
    placed = weighed.withColumn("w", F.sum("idf").over(Window.partitionBy("ord"))).withColumn("before", F.sum("idf").over(heavy_first.rowsBetween(Window.unboundedPreceding, -1)))
    placed = placed.withColumn("before", F.coalesce("before", F.lit(0.0)))
    light = placed.where(F.col("w") - F.col("before") >= gray * F.col("w") - 1e-9).select("class", "token", F.col("ord").alias("x"), F.col("w").alias("wx"))
    full = placed.select("class", "token", F.col("ord").alias("y"), F.col("w").alias("wy"))
    met = light.join(full, ["class", "token"]).where((F.col("x") != F.col("y")) & (F.col("wx") <= F.col("wy") + 1e-9))
    candidates = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    whole = placed.groupBy("ord").agg(F.sort_array(F.collect_list(F.struct("token", "idf"))).alias("t"), F.first("w").alias("w"))
    both = candidates.join(whole.select(F.col("ord").alias("a"), F.col("t").alias("ta"), F.col("w").alias("wa")), "a").join(whole.select(F.col("ord").alias("b"), F.col("t").alias("tb"), F.col("w").alias("wb")), "b")
    common = F.aggregate(F.array_intersect("ta", "tb"), F.lit(0.0), lambda s, x: s + x["idf"])
    scored = both.select("a", "b", (common / F.least("wa", "wb")).alias("sim")).where(F.col("sim") >= gray)
    e = ready.select("ord", "entities")
    named = scored.join(e.select(F.col("ord").alias("a"), F.col("entities").alias("ea")), "a").join(e.select(F.col("ord").alias("b"), F.col("entities").alias("eb")), "b")
    shared = F.size(F.array_intersect("ea", "eb"))
    return named.select("a", "b", "sim", shared.alias("shared")).where((F.col("sim") >= strong) | (F.col("shared") >= least_entities))


def leader_clusters(ready: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ord, leader): in ascending order an unclaimed note leads and claims all later unclaimed notes that match it."""
    edges = written(pairs.select(F.col("a").alias("early"), F.col("b").alias("late")), "edges")
    open_, followers = edges, edges.select(F.col("late").alias("n")).limit(0)
    while True:
        # nodes of open edges without an earlier open neighbour lead; their later neighbours follow
        leads = open_.select(F.col("early").alias("n")).distinct().join(open_.select(F.col("late").alias("n")).distinct(), "n", "left_anti")
        done = written(open_.join(leads.select(F.col("n").alias("early")), "early", "left_semi").select(F.col("late").alias("n")).distinct(), "followers")
        if done.isEmpty():
            break
        followers = followers.unionByName(done)
        for end in ("early", "late"):
            open_ = open_.join(done.select(F.col("n").alias(end)), end, "left_anti")
        open_ = written(open_.join(leads.select(F.col("n").alias("early")), "early", "left_anti").select("early", "late"), "open")
    claims = edges.join(followers.select(F.col("n").alias("early")), "early", "left_anti").groupBy(F.col("late").alias("ord")).agg(F.min("early").alias("leader"))
    return ready.select("ord").join(claims, "ord", "left").select("ord", F.coalesce("leader", "ord").alias("leader"))
