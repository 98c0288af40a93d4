"""From scanned cards to rows to append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gacetilla.functions import constants as K, text as T


def usable_cards(cards: DataFrame, least_title: int = 8) -> DataFrame:
    """Cards with a title of some length and the address of an article."""
    return cards.where((F.char_length("titulo") >= least_title) & (F.col("url") != "") & T.is_article_url(F.col("url")))


def unseen(cards: DataFrame, known: DataFrame, order: list[str], url: str = "url") -> DataFrame:
    """Cards whose address is not known, the first of each address in the given order."""
    fresh = cards.where(F.col(url).isNotNull()).join(known.select(F.col("url").alias(url)), url, "left_anti")
    return _first_of(fresh, url, order)


def _first_of(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key, combined map-side."""
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_r"))
    return first.select("_r.*")


def first_groups(members: DataFrame, known: DataFrame, most: int = 12) -> DataFrame:
    """(leader, ord, url) of the first groups in leader order, then without groups whose addresses are all known.

    Groups are limited before known ones are skipped; a group without any address counts as known."""
    first = members.select("leader").distinct().orderBy("leader").limit(most)
    kept = members.join(F.broadcast(first), "leader")
    flagged = kept.join(known.select("url", F.lit(True).alias("_known")), "url", "left")
    new = flagged.where("url is not null and url <> ''").groupBy("leader").agg(F.bool_and(F.col("_known").isNotNull()).alias("all_known")).where("not all_known")
    return kept.join(new, "leader", "left_semi").select("leader", "ord", "url")


def stored_once(notes: DataFrame, order: list[str], least_body: int = 60) -> DataFrame:
    """Notes to store: bodies of some length, then the first of each address (an address that was too short does not count as stored)."""
    long_enough = notes.where(F.char_length(F.coalesce("cuerpo", F.lit(""))) >= least_body)
    return _first_of(long_enough, "url", order)


def best_image(*columns: Column) -> Column:
    """The first picture that is neither null nor empty."""
    return T.or_else(*columns)


def merged_group(notes: DataFrame, key: str, order: str, least_body: int = 60, longest: int = 2200) -> DataFrame:
    """One row a group: leader (first in order), distinct sorted sources, source and address pairs, and the versions, cut and numbered.

    Groups are the editor's selections of a few notes each."""
    def in_order(value: Column, when: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(when, F.struct(F.col(order).alias("o"), value.alias("v"))))), lambda x: x["v"])

    texts = in_order(F.left("cuerpo", F.lit(longest)), F.char_length("cuerpo") >= least_body)
    pairs = in_order(F.struct(F.coalesce("fuente", F.lit("")).alias("fuente"), F.col("url_original").alias("url")), F.coalesce(F.col("url_original"), F.lit("")) != "")
    grouped = notes.groupBy(key).agg(
        F.min_by("id", order).alias("lider"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("fuente") != "", F.col("fuente")))), ", ").alias("fuentes"), pairs.alias("fuentes_urls"), texts.alias("_t")
    )
    versions = F.array_join(F.transform("_t", lambda t, i: F.concat(F.lit(K.VERSION[0]), (i + 1).cast("string"), F.lit(f"{K.VERSION[1]}\n"), t)), f"\n\n{K.NEXT_VERSION}\n\n")
    return grouped.select(key, "lider", "fuentes", "fuentes_urls", F.size("_t").alias("versiones"), versions.alias("texto"))


def _line(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), value, F.lit("\n"))


def _if_any(value: Column, line: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", line).otherwise("")


def prompt(titulo: Column, seccion: Column, cuerpo: Column, fuente: Column) -> Column:
    """The text that a rewriter gets for one note; null titles, sections and texts count as empty."""
    title, section, body = (F.coalesce(c, F.lit("")) for c in (titulo, seccion, cuerpo))
    return F.concat(_line(K.PROMPT_SECTION, section), _line(K.PROMPT_TITLE, title), _if_any(fuente, _line(K.PROMPT_SOURCE, fuente)), F.lit(f"{K.PROMPT_BODY}\n"), T.cut(body, 4500), F.lit("\n"))


def group_prompt(titulo: Column, seccion: Column, versions: Column, texts: Column, fuentes: Column) -> Column:
    """The text that a rewriter gets for several versions of an event: how many there are, their joined texts and sources."""
    count = versions.cast("string")
    before, after = K.PROMPT_VERSIONS
    return F.concat(
        _line(K.PROMPT_SECTION, F.coalesce(seccion, F.lit(""))), _line(K.PROMPT_REFERENCE, F.coalesce(titulo, F.lit(""))), _line(K.PROMPT_COUNT, count), _if_any(fuentes, _line(K.PROMPT_SOURCES, fuentes)),
        F.lit(f"\n{before}"), count, F.lit(f"{after}\n\n"), texts, F.lit("\n"),
    )


class Retry(Exception):
    """What an injected function raises for failures that pass (rate limits, lost connections, failing servers)."""


def rewritten_by(notes: DataFrame, function, attempts: int = 3, pauses: tuple[float, ...] = (2, 4, 8)) -> DataFrame:
    """(id, answer, error) of notes (id, prompt) by an injected function; failures are reported in the row.

    ``Retry`` is tried again after a pause (the last of ``pauses`` for later attempts), an empty answer at once, anything else not
    at all. Each row is written as soon as its batch is done, so a lost task repeats one batch's calls at most."""

    def one(text: str) -> tuple[str | None, str | None]:
        import time

        error = None
        for k in range(attempts):
            try:
                if answer := (function(text) or "").strip():
                    return answer, None
                error = "empty"
            except Retry as e:
                error = f"Retry: {e}"
                if k + 1 < attempts:
                    time.sleep(pauses[min(k, len(pauses) - 1)] if pauses else 0)
            except Exception as e:  # noqa: BLE001 - reported in the row
                return None, f"{type(e).__name__}: {e}"
        return None, error

    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame([(i, *one(p)) for i, p in zip(b["id"], b["prompt"])], columns=["id", "answer", "error"])

    return notes.select("id", "prompt").mapInPandas(run, "id string, answer string, error string")
