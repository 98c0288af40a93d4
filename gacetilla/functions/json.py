"""Strict JSON objects in lenient surroundings: the text as it is, without a code fence, or its outermost braces."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gacetilla.functions import constants as K
from gacetilla.functions.text import strip

#: Values that the accepted dialect adds to the standard.
_BEYOND = r"(?<=[:\[,]|[:\[,]\s)-?(?:NaN|Infinity)(?=\s*[,}\]])"


def _standard(c: Column) -> Column:
    """The same keys in standard JSON."""
    return F.regexp_replace(c, _BEYOND, "null")


def _object(c: Column) -> Column:
    """c if it is one JSON object and nothing else, else null. Single quotes and anything after the object make it none."""
    closed = strip(c).rlike(r"(?s)\A\{.*\}\z")
    # a parser stops at the end of a first value: a mark that the text cannot hold must come right after the object
    mark = F.md5(c.cast("binary"))
    marked = F.try_parse_json(F.concat(F.lit("["), _standard(c), F.lit(',"'), mark, F.lit('"]')))
    return F.when(closed & (F.try_variant_get(marked, "$[1]", "string") == mark), c)


def json_object(c: Column) -> Column:
    """The text of the JSON object in c, or null; readings are tried in order and the first that is an object is taken."""
    unfenced = strip(F.regexp_replace(strip(c), r"\A```(?:json)?|```\z", ""))
    between = F.regexp_extract(unfenced, r"(?s)\{.*\}", 0)
    return F.coalesce(*[_object(reading) for reading in (c, unfenced, between)])


def missing_fields(c: Column, required: list[str] | None = None) -> Column:
    """Required keys that an object lacks; a key with a null value is there."""
    return F.array_except(F.array(*[F.lit(k) for k in required or K.REQUIRED_FIELDS]), F.json_object_keys(_standard(c)))


def is_rejected(c: Column) -> Column:
    """Whether the object says, with a boolean and not with a text, that it should not be published."""
    flag = F.try_variant_get(F.try_parse_json(_standard(c)), "$.publicar", "variant")
    return F.coalesce((F.schema_of_variant(flag) == "BOOLEAN") & ~F.try_variant_get(flag, "$", "boolean"), F.lit(False))
