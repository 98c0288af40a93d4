"""Free-text notices: segments by marker lines, dates, and texts by month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gacetilla.functions import constants as K
from gacetilla.functions import dates
from gacetilla.functions.text import strip


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line): stripped lines that are not empty, counted from 0."""
    kept = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    return docs.select(key, F.posexplode(kept).alias("pos", "line"))


def cut_at_markers(c: Column) -> Column:
    """The text before each end marker that does not stand at its very beginning."""
    for marker in K.NOTICE_ENDS:
        at = F.instr(c, marker)
        c = F.when(at > 1, F.left(c, at - 1)).otherwise(c)
    return c


def notices(docs: DataFrame, key: str, text: str, trigger: str = r"(?i)fallec[ei][oó]?") -> DataFrame:
    """(key, start, nombre, cuerpo, anio, mes): a notice begins with a trigger line; the line before is the name; it ends
    before the next notice's name. A trigger on the first line and notices without a date are left out."""
    every = lines(docs, key, text)
    w = Window.partitionBy(key).orderBy("pos")
    marked = every.withColumn("t", F.col("line").rlike(trigger)).withColumn("name", F.lag("line").over(w))
    starts = marked.where("t").withColumn("next", F.lead("pos").over(w)).where("pos > 0").select(key, F.col("pos").alias("start"), F.coalesce(F.col("next") - 1, F.lit(1 << 30)).alias("end"), F.col("name").alias("nombre"))
    # each line belongs to the last start at or before it
    seg = marked.select(key, "pos", "line", F.last(F.when(F.col("t"), F.col("pos")), True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("start"))
    body = seg.join(starts, [key, "start"]).where("pos < end").groupBy(key, "start", "nombre").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("cuerpo"))
    dated = body.withColumn("d", dates.first_date(F.col("cuerpo"))).where("d is not null and cuerpo <> ''")
    return dated.select(key, "start", "nombre", "cuerpo", F.col("d.anio").alias("anio"), F.col("d.mes").alias("mes"))


def by_month(rows: DataFrame, order: list[str]) -> DataFrame:
    """(anio, mes, mes_nombre, cantidad, contenido, slug), latest first, of notices (nombre, cuerpo, anio, mes)."""
    entry = F.struct(*order, F.concat(F.lit("### "), F.col("nombre"), F.lit("\n\n"), F.col("cuerpo")).alias("_v"))
    grouped = rows.groupBy("anio", "mes").agg(F.count("*").alias("cantidad"), F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["_v"]), "\n\n").alias("contenido"))
    return grouped.select("anio", "mes", dates.month_name(F.col("mes")).alias("mes_nombre"), "cantidad", "contenido", month_slug(F.col("anio"), F.col("mes")).alias("slug")).orderBy(F.desc("anio"), F.desc("mes"))


def month_slug(year: Column, month: Column) -> Column:
    return F.format_string("%d-%02d", year, month)


def shift_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, cuerpo): the heading, the month as subtitle, the legend and a block for each day, repeated days as repeated
    blocks; a text without the month's marker comes as its lines."""
    every = lines(docs, key, text)
    w = Window.partitionBy(key).orderBy("pos")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = every.withColumn("is_month", F.lower("line").startswith("turnos del mes")).withColumn("month_at", F.min(F.when(F.col("is_month"), F.col("pos"))).over(Window.partitionBy(key)))
    after = F.col("pos") > F.col("month_at")
    day = after & F.col("line").rlike(r"^\d{1,2}$")
    marked = marked.withColumn("day", F.sum(day.cast("int")).over(running))
    # segment -2: everything of a text without marker, -1: heading, 0: month, 1: legend, 2 ...: days
    seg = F.when(F.col("month_at").isNull(), -2).when(F.col("pos") < F.col("month_at"), -1).when(F.col("pos") == F.col("month_at"), 0).otherwise(F.coalesce(F.col("day"), F.lit(0)) + 1)
    parts = marked.withColumn("seg", seg).groupBy(key, "seg").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("l"))
    rest = F.slice("l", 2, 1_000_000)
    block = (
        F.when(F.col("seg") == -2, F.array_join("l", "\n\n")).when(F.col("seg") == -1, F.array_join("l", "\n")).when(F.col("seg") == 0, F.concat(F.lit("## "), F.element_at("l", 1))).when(F.col("seg") == 1, F.array_join("l", " · "))
        .otherwise(F.concat(F.lit("### Día "), F.element_at("l", 1), F.lit("\n\n"), F.array_join(rest, " · ")))
    )
    # a marker on the first line leaves an empty heading
    headless = parts.where("seg = 0").join(parts.where("seg = -1").select(key), key, "left_anti").select(key, F.lit(-1).alias("seg"), F.lit("").alias("b"))
    blocks = parts.select(key, "seg", block.alias("b")).unionByName(headless)
    return blocks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "b"))), lambda x: x["b"]), "\n\n").alias("cuerpo"))
