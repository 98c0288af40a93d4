"""Text helpers shared by the operators: folding, words, stable hashes and addresses.

The plain functions run inside Arrow workers; the Column functions stay in the JVM.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gacetilla.sources.tables import shared_folder  # noqa: F401 - used by the operators

_COMMON = [("á", "a"), ("é", "e"), ("í", "i"), ("ó", "o"), ("ú", "u"), ("ü", "u"), ("ñ", "n"), ("́", "")]
_PLAIN = set("áéíóúüñ¿¡«»“”‘’…–—•·▸©°ºª§ ́")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case without accents. Latin letters keep their number of characters."""
    s = text.lower()
    if s.isascii():
        return s
    for a, b in _COMMON:
        s = s.replace(a, b)
    if not s.isascii() and not _PLAIN.issuperset(c for c in set(s) if c > "\x7f"):
        s = "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")
    return s


def words(text: str) -> list[str]:
    """Maximal runs of letters or digits, lower case, without accents."""
    return _WORD.findall(fold(text))


def stable_hash(word: str) -> int:
    """64 bits, the same in every process."""
    b = word.encode("utf-8", "surrogatepass")
    return (zlib.crc32(b) << 32) | zlib.crc32(b, 0x5BD1E995)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit integers (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def word_table(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words of many texts at once: (code of each word, offset of each text, vocabulary)."""
    folded = pa.array([fold(t) if t else "" for t in texts], pa.large_string())
    parts = pc.split_pattern_regex(folded, r"[^\pL\pN]+")
    flat, counts = pc.list_flatten(parts), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    keep = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), counts)[keep]
    coded = pc.dictionary_encode(flat.filter(pa.array(keep)))
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    offsets = np.searchsorted(owner, np.arange(len(texts) + 1))
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets, coded.dictionary.to_pylist()


def clean_space(c: Column) -> Column:
    """White space of any kind trimmed and collapsed to single spaces."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s ]+", " "))


def source_key(c: Column) -> Column:
    """A source compared without case and outer blanks; null stays null, blank becomes null."""
    k = F.lower(F.regexp_replace(c, r"(?U)^[\s ]+|[\s ]+$", ""))
    return F.when(k != "", k)


def _address(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)[\s ]+", "")), r"^[a-z][a-z0-9+.-]*://|^//", ""), r"#.*$", "")


def site(c: Column) -> Column:
    """Host of an address without www., m. or port; null when there is none."""
    h = F.regexp_replace(F.regexp_extract(_address(c), r"^([^/?#\s]+\.[^/?#\s]+)", 1), r"^(?:(?:www\d?|m|amp|mobile)\.)+|:\d+$", "")
    return F.when(h != "", h)


def article_number(c: Column) -> Column:
    """The number by which a site names an article, or null.

    Taken from a query parameter (p, id, nota, articulo), else a whole numeric path segment that is no
    part of a date, else a number at the end of the path."""
    a = _address(c)
    found = None
    for pattern in (r"[?&](?:p|id|nota|articulo|idnota|noticia)=0*(\d+)", r"/(?:nota|noticia|articulo|n)/0*(\d+)(?:[/?]|$)", r"[/-]n?0*(\d+)(?:\.[a-z]{3,5})?(?:/(?:amp/?)?)?(?:\?.*)?$"):
        n = F.regexp_extract(a, pattern, 1)
        n = F.when(n != "", n)
        found = n if found is None else F.coalesce(found, n)
    return found


def article_key(c: Column) -> Column:
    """Same site and same article, however the address is spelled; null without a host.

    Sites with article numbers are keyed by host and number, others by host and path."""
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(_address(c), r"^[^/?]+(/[^?]*)", 1), r"/(?:amp/?|index\.[a-z]+)?$", ""), r"/+", "/")
    n = article_number(c)
    return F.when(n.isNotNull(), F.concat_ws("#", site(c), n)).when(path != "", F.concat(site(c), path))


def written(df: DataFrame, name: str) -> DataFrame:
    """df computed once, written to the shared folder and read back: lineage is cut, and losing an executor
    costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
