"""Scalar functions over headlines, sections and addresses, as Columns that stay in the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

from gacetilla.functions import constants as K

_SPACE = r"(?U)[\s ]"


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def strip(c: Column) -> Column:
    """White space of any kind (no-break spaces, tabs, line ends) removed at both ends."""
    return F.regexp_replace(c, rf"{_SPACE}+\z|\A{_SPACE}+", "")


def split_words(c: Column) -> Column:
    return F.filter(F.split(c, rf"{_SPACE}+"), lambda w: w != "")


def or_else(*columns: Column) -> Column:
    """The first that is neither null nor empty; the last as it is."""
    return F.coalesce(*[F.when(c != "", c) for c in columns[:-1]], columns[-1])


def title_tokens(c: Column) -> Column:
    """Distinct words of a headline: lower case, other characters deleted (so hyphenated words fuse), no stopwords, over two letters."""
    bare = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^a-záéíóúüñ\s ]", "")
    return F.array_distinct(F.filter(split_words(bare), lambda w: (F.char_length(w) > 2) & ~w.isin(K.STOPWORDS)))


def significant_tokens(c: Column) -> Column:
    return F.array_except(title_tokens(c), strings(K.LOW_SIGNAL))


def title_entities(c: Column) -> Column:
    """Figures, capitalised words but the first, and known places: a phrase may count more than once."""
    c = F.coalesce(c, F.lit(""))
    figures = F.regexp_extract_all(c, F.lit(r"(?U)\b(\d+(?:[.,]\d+)?)\b"), 1)
    later = F.slice(split_words(c), 2, 1_000_000)
    capital = F.transform(F.filter(later, lambda w: (F.char_length(w) > 3) & w.rlike(r"^\p{Lu}") & ~F.lower(w).isin(K.STOPWORDS)), F.lower)
    places = F.filter(strings(K.PLACES), lambda p: F.contains(F.lower(c), p))
    return F.array_union(F.array_union(figures, capital), places)


def section_of(c: Column) -> Column:
    """The section whose key, first in the fixed order, stands anywhere in the free-entered name; else Local."""
    low = F.lower(strip(F.coalesce(c, F.lit(""))))
    out = F.when(F.contains(low, F.lit(K.SECTION_OF[0][0])), K.SECTION_OF[0][1])
    for key, value in K.SECTION_OF[1:]:
        out = out.when(F.contains(low, F.lit(key)), value)
    return out.otherwise("Local")


def section_class(c: Column) -> Column:
    """Equal for compatible sections: the fixed groups are disjoint, so compatibility is an equivalence."""
    low = F.lower(strip(F.coalesce(c, F.lit("Local"))))
    out = None
    for group in K.SECTION_GROUPS:
        hit = low.isin([s.lower() for s in group])
        out = F.when(hit, group[0].lower()) if out is None else out.when(hit, group[0].lower())
    return out.otherwise(low)


def _path(url: Column) -> Column:
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*|[?#].*$", "")
    return F.regexp_replace(rest, r"/+$", "")


def url_slug(url: Column, title: Column) -> Column:
    """Last path segment, else the title, else 'nota'; lower case, other characters (accented ones too) as single hyphens."""
    base = or_else(F.regexp_extract(_path(url), r"([^/]*)$", 1), title, F.lit("nota"))
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(base, F.lit("nota"))), "[^a-z0-9]+", "-"), "^-|-$", "")
    return or_else(slug, F.lit("nota"))


def url_domain(url: Column) -> Column:
    """Authority in lower case without a leading www.; the port stays; empty without one."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)), r"^www\.", "")


def is_article_url(url: Column) -> Column:
    return ~F.lower(url).rlike("|".join(rf"\Q{part}\E" for part in K.NOT_ARTICLES))


def query_terms(c: Column, most: int = 3) -> Column:
    """First content words (over three letters) of a text, joined by spaces; null if there are none."""
    words = coherence_tokens(c)
    return F.when(F.size(words) > 0, F.array_join(F.slice(words, 1, most), " "))


def coherence_tokens(c: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-záéíóúñ ]", "")
    return F.filter(F.split(bare, " +"), lambda w: (F.char_length(w) > 3) & ~w.isin(K.SHORT_STOPWORDS))


def is_coherent(title: Column, body: Column, least: float = 0.2) -> Column:
    """At least this share of the title's words stand somewhere in the body; true where either has nothing to compare."""
    words = coherence_tokens(title)
    hits = F.size(F.filter(words, lambda w: F.contains(F.lower(body), w)))
    return F.when(F.coalesce(body, F.lit("")) == "", True).when(F.size(words) == 0, True).otherwise(hits / F.size(words) >= least)


def cut(c: Column, most: int, mark: str = "...") -> Column:
    return F.when(F.char_length(c) > most, F.concat(F.substring(c, 1, most), F.lit(mark))).otherwise(c)


def masked(c: Column) -> Column:
    """A secret for display: empty, first two characters, or four at both ends."""
    return F.when(F.coalesce(c, F.lit("")) == "", "(VACÍO)").when(F.char_length(c) <= 6, F.concat(F.substring(c, 1, 2), F.lit("***"))).otherwise(F.concat(F.left(c, F.lit(4)), F.lit("..."), F.right(c, F.lit(4))))


def image_extension(content_type: Column) -> Column:
    return F.when(content_type == "image/png", "png").when(content_type == "image/webp", "webp").when(content_type == "image/gif", "gif").otherwise("jpg")


def image_path(note_id: Column, url: Column, status: Column, content_type: Column, size: Column, most: int = 5_000_000) -> Column:
    """Where an image is stored, or null if it may not be: absolute address, status 200, an image type, within the size."""
    ok = url.startswith("http") & (status == 200) & content_type.startswith("image/") & (size <= most)
    return F.when(ok, F.concat(F.lit("noticias/"), note_id, F.lit("."), image_extension(content_type)))


def group_id(leader_url: Column) -> Column:
    """A group's identifier in UUID form, the same for the same leader in every run."""
    m = F.md5(F.coalesce(leader_url, F.lit("")).cast("binary"))
    return F.concat_ws("-", *[F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def split_uuid(c: Column) -> Column:
    """struct(head, tail): cut after a leading UUID, else at the first underscore."""
    uuid = (F.char_length(c) > 36) & (F.substring(c, 37, 1) == "_")
    head = F.when(uuid, F.substring(c, 1, 36)).otherwise(F.substring_index(c, "_", 1))
    tail = F.when(uuid, F.substring(c, 38, 1_000_000)).otherwise(F.when(F.contains(c, F.lit("_")), F.regexp_replace(c, r"^[^_]*_", "")).otherwise(""))
    return F.struct(head.alias("head"), tail.alias("tail"))


#: Message actions, more specific prefixes first, and whether a UUID with a rest follows.
ACTIONS = [("toggle_", True), ("img_", True), ("sec_grupo_set_", True), ("sec_grupo_volver_", False), ("sec_grupo_", False), ("procesar_", False), ("des_grupo_", False), ("sec_menu_", False), ("sec_volver_", False), ("sec_", True), ("pub_", False), ("des_", False)]


def parse_action(c: Column) -> Column:
    """struct(action, head, tail) of a message's data; null if the action is unknown."""
    out = None
    for prefix, paired in ACTIONS:
        rest = F.substring(c, len(prefix) + 1, 1_000_000)
        pair = split_uuid(rest) if paired else F.struct(rest.alias("head"), F.lit("").alias("tail"))
        value = F.struct(F.lit(prefix.rstrip("_")).alias("action"), pair["head"].alias("head"), pair["tail"].alias("tail"))
        out = F.when(c.startswith(prefix), value) if out is None else out.when(c.startswith(prefix), value)
    return out


def message_title(c: Column) -> Column:
    return or_else(strip(F.regexp_extract(c, r"Título: (.*?)\n", 1)), F.lit("(Noticia)"))


def message_section(c: Column, section: Column) -> Column:
    """The message with its section line naming another section, cut to what a message may hold."""
    return F.left(F.regexp_replace(c, F.lit(rf"{K.MESSAGE_SECTION}.*"), F.concat(F.lit(K.MESSAGE_SECTION), F.regexp_replace(section, r"([\\$])", r"\\$1"))), F.lit(4096))


def urls_joined(base: Column, link: Column) -> Column:
    """Relative links resolved against their page."""

    @F.pandas_udf("string")
    def join(b: pd.Series, h: pd.Series) -> pd.Series:
        from urllib.parse import urljoin

        return pd.Series([None if y is None else urljoin(x or "", y) for x, y in zip(b, h)])

    return join(base, link)


def url_quoted(c: Column) -> Column:
    @F.pandas_udf("string")
    def quoted(s: pd.Series) -> pd.Series:
        from urllib.parse import quote

        return s.map(lambda x: None if x is None else quote(x))

    return quoted(c)
