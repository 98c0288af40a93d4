"""Lines repeated across one source's documents.

Each line of each source is compared within its source and outside it by a log-likelihood ratio; the false-discovery rate
is held by the Benjamini-Hochberg rule within each source, over all its lines; significant lines that also reach the least
number and share of a source's documents are removed by an anti-join, and documents are put together again
by position.

A line that every source repeats shows no excess over other sources. Its excess is then measured against
the rate at which an average line stands in a document outside the source; a line is significant if either
comparison is.

Scale: a document becomes an array of eight-byte line keys, written once; counts by (source, line) are written once and
joined with the counts of the lines by key. Counting is by map-side partial sums on (source, line), so a source with a third of
all rows spreads over all tasks; a source's lines of one p-value are one row in its ranking.

Defined results: null or blank sources have no cases and are not counted; null, empty and blank texts have no
lines; a document delivered twice counts once, by id; a line with neither letter nor digit is no case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gacetilla.llm.text import source_key, written


def line_keys(c: Column) -> Column:
    """Array with a key for each line, null for lines with nothing left."""
    t = F.regexp_replace(F.lower(c), r"\d+", "0")
    t = F.regexp_replace(t, r"(?U)[^\S\n]+", " ")
    t = F.regexp_replace(t, r"(?dm)^[^\p{L}\p{N}\n]+|[^\p{L}\p{N}\n]+$", "")
    return F.transform(F.split(t, "\n", -1), lambda x: F.when(x != "", F.xxhash64(x)))


def _tail(llr: Column) -> Column:
    """Probability of a log-likelihood ratio this large with one degree of freedom (erfc by Abramowitz and Stegun 7.1.26)."""
    x = F.sqrt(llr / 2)
    t = 1 / (1 + 0.3275911 * x)
    p = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)
    return F.when(llr > 60, F.exp(-llr / 2)).otherwise(p)


def _ratio(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """One-sided log-likelihood ratio of k1 in n1 against k2 in n2, half a document taken from one to the other (counts are
    whole numbers); 0 where the first rate is no larger."""
    k1, k2 = k1 - 0.5, k2 + 0.5
    def ll(k: Column, n: Column, p: Column) -> Column:
        return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(k < n, (n - k) * F.log(1 - p)).otherwise(0.0)

    p1, p2, p = k1 / n1, k2 / n2, (k1 + k2) / (n1 + n2)
    value = 2 * (ll(k1, n1, p1) + ll(k2, n2, p2) - ll(k1, n1, p) - ll(k2, n2, p))
    return F.when((n2 > 0) & (p1 > p2), F.greatest(value, F.lit(0.0))).when(n2 > 0, 0.0).otherwise(None)


def line_tests(docs: DataFrame, rate: float) -> DataFrame:
    """(source, key, k, n, all_k, llr, p, cut) of every line of every source: k of its n documents hold it, all_k of all sources'.

    cut is the greatest p-value that the Benjamini-Hochberg rule lets pass in the source, over all of its lines."""
    totals = docs.groupBy("source").agg(F.countDistinct("doc").alias("n"))
    single = docs.select("source", "doc", F.explode(F.array_compact(F.array_distinct("keys"))).alias("key"))
    counts = single.groupBy("source", "key").agg(F.count_distinct("doc").alias("k"))
    counts = written(counts, "line-counts")
    by_key = counts.groupBy("key").agg(F.sum("k").alias("all_k"))
    corpus = totals.agg(F.sum("n").alias("all_n")).crossJoin(by_key.agg(F.avg("all_k").alias("mean_k")))  # one row
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    outside = F.col("all_n") - n
    # an average line: documents with a line over distinct lines, in the documents outside (as many as inside where there are none)
    same = _ratio(k, n, F.col("all_k") - k, outside)
    base = _ratio(k, n, F.col("mean_k"), F.greatest(outside, n, F.col("mean_k")))
    tested = counts.join(totals, "source").join(by_key, "key").crossJoin(corpus).withColumn("llr", F.greatest(F.coalesce(same, F.lit(0.0)), base)).withColumn("p", _tail(F.col("llr")))
    # lines of one p-value are one row here, so that a source's ranking does not grow with its lines
    steps = tested.groupBy("source", "p").agg(F.count("*").alias("lines"))
    up_to = Window.partitionBy("source").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    ranked = steps.withColumn("r", F.sum("lines").over(up_to)).withColumn("m", F.sum("lines").over(Window.partitionBy("source")))
    cuts = ranked.where(F.col("p") <= rate * F.col("r") / F.col("m")).groupBy("source").agg(F.max("p").alias("cut"))
    return tested.join(cuts, "source").select("source", "key", "k", "n", "all_k", "llr", "p", "cut")


def repeated_lines(notes: DataFrame, least_documents: int = 4, least_share: float = 0.03, rate: float = 0.01) -> DataFrame:
    """(id, line_no, fuente, documents, share, llr) of the repeated lines of each document.

    ``notes`` needs id, cuerpo and fuente."""
    docs = written(
        notes.select("id", F.xxhash64("id").alias("doc"), source_key(F.col("fuente")).alias("source"), line_keys(F.coalesce("cuerpo", F.lit(""))).alias("keys")).where("source is not null"), "line-keys"
    )
    excess = line_tests(docs, rate).where((F.col("p") <= F.col("cut")) & (F.col("k") >= least_documents) & (F.col("k") >= least_share * F.col("n"))).select("source", "key", F.col("k").alias("documents"), (F.col("k") / F.col("n")).alias("share"), "llr")
    placed = docs.select("id", "source", F.posexplode("keys").alias("pos", "key")).where("key is not null")
    return placed.join(excess, ["source", "key"]).select("id", (F.col("pos") + 1).alias("line_no"), F.col("source").alias("fuente"), "documents", "share", "llr").dropDuplicates(["id", "line_no"])


def without_repeated_lines(notes: DataFrame, repeated: DataFrame) -> DataFrame:
    """(id, cuerpo) without the repeated lines, the other lines in their order."""
    from gacetilla.llm.boilerplate import main_text

    return main_text(notes, repeated)
