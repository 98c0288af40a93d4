"""Dates in free text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gacetilla.functions import constants as K


def month_number(name: Column) -> Column:
    """Number of a Spanish month name in any case, or null."""
    out = None
    for key, n in K.MONTHS:
        hit = F.lower(name) == key
        out = F.when(hit, n) if out is None else out.when(hit, n)
    return out


def month_name(number: Column) -> Column:
    out = None
    for key, n in K.MONTHS:
        if key != "setiembre":
            out = F.when(number == n, key.capitalize()) if out is None else out.when(number == n, key.capitalize())
    return F.coalesce(out, number.cast("string"))


def first_date(c: Column) -> Column:
    """struct(anio, mes) of a text's first date, null without one.

    Only the first 'D de MES [de] YYYY' counts (none if its month is unknown); a numeric D/M/Y wins if it is valid
    (day 1-31, month 1-12) and starts before. Two-digit years are in this century; three digits are taken as they are."""
    written = F.regexp_extract(c, K.WRITTEN_DATE, 0)
    month = month_number(F.regexp_extract(c, K.WRITTEN_DATE, 2))
    at = F.when((written != "") & month.isNotNull(), F.instr(c, written))
    numeric = F.arrays_zip(*[F.regexp_extract_all(c, F.lit(K.NUMERIC_DATE), F.lit(k)).alias(n) for k, n in ((0, "all"), (1, "d"), (2, "m"), (3, "y"))])

    def valid(x: Column) -> Column:
        return x["d"].cast("int").between(1, 31) & x["m"].cast("int").between(1, 12)

    first = F.try_element_at(F.filter(numeric, valid), F.lit(1))
    year = first["y"].cast("int")
    as_number = F.struct(F.when(year < 100, year + 2000).otherwise(year).alias("anio"), first["m"].cast("int").alias("mes"))
    as_text = F.struct(F.regexp_extract(c, K.WRITTEN_DATE, 3).try_cast("int").alias("anio"), month.alias("mes"))
    start = F.when(first.isNotNull(), F.position(first["all"], c))
    return F.when(start.isNotNull() & (at.isNull() | (start < at)), as_number).when(at.isNotNull(), as_text)


def iso_instant(c: Column) -> Column:
    """The instant that an ISO 8601 text with an offset (or Z) names; null for other texts and for times without an offset."""
    whole = c.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:\d{2})$")
    return F.when(whole, F.try_to_timestamp(c))


def local_day(at: Column, zone: str) -> Column:
    """An instant's day in a time zone as dd/MM/yyyy."""
    return F.date_format(F.from_utc_timestamp(F.to_utc_timestamp(at, F.current_timezone()), zone), "dd/MM/yyyy")
