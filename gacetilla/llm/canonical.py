"""Free-entered values mapped to a canonical list by a prefix-filter set-similarity join.

Values and canonical names (with their aliases) become sets of letter pairs, each set ordered by the global rarity of
its pairs; only the rare prefixes are joined (two sets with Jaccard similarity t share a pair within the first
|x| - ceil(t |x|) + 1), the length and positional filters prune, Jaccard is verified exactly, and the best candidate is kept.

Jaccard alone cannot tell a slip of the keys from another word, so a candidate counts only if an exact check
follows: a small number of edits (insertions, deletions, substitutions, swaps of neighbours) in proportion to the length of
the name, or of the beginning of the name for values that were cut off. Values without such a candidate are reported with key 0.

Scale: only distinct values are joined; records meet their value's entry by an ordinary join on the value. The set of
letter pairs is bounded by the alphabet.

Defined results: null and blank values are left out; a value equal to a name is left out if ``keep_exact`` is false;
of several entries the one with the fewest edits, then the greatest similarity, then the least key wins; an empty
canonical list maps every value to 0; records delivered twice count once.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gacetilla.llm.text import fold, written

#: Wrappers that pages put around a section's name.
_BEFORE = re.compile(r"^(?:(?:home|inicio|portada) *[>/»|:-]+ *|(?:secci[oó]n|categor[ií]a|tema|rubro) *[:/>-]+ *|noticias de +|[#/\[(*>»•·\s-]+)+", re.I)
_AFTER = re.compile(r"(?: *[-|>»/] *(?:inicio|home|portada)| *\(\d+\)|[\s»\])*/>|·-]+)+$", re.I)
_CUT = re.compile(r"(?:…|\.{1,3})\s*$")


def tidy(value: str) -> tuple[str, bool]:
    """(folded letters and digits without spaces, whether the value shows that it was cut off)."""
    s = html.unescape(value)
    s = (html.unescape(s.lower()) if re.search(r"&[A-Z]+;", s) else s).replace("\xa0", " ")
    if "Ã" in s or "Â" in s:
        try:
            s = s.encode("cp1252", "strict").decode("utf-8")
        except UnicodeError:
            s = re.sub("Ã(.)", lambda m: ("Ã" + m[1]).encode("latin-1", "ignore").decode("utf-8", "ignore"), s)
    s = s.strip()
    s = _AFTER.sub("", _BEFORE.sub("", s))
    cut = bool(_CUT.search(s))
    return re.sub(r"[\W_]+", "", fold(s.replace("&", " y "))), cut


def pairs(word: str) -> list[str]:
    """Distinct letter pairs with a mark at both ends."""
    w = f"^{word}$"
    return sorted({w[i : i + 2] for i in range(len(w) - 1)})


def edits(a: str, b: str, most: int) -> int:
    """Edits from a to b, a swap of neighbours being one; more than ``most`` counts as most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
        if min(row) > most:
            return most + 1
    return row[-1]


def allowed(length: int) -> int:
    """Edits that a name of this length may carry."""
    return 0 if length < 3 else 1 if length < 6 else 2 if length < 11 else 3


def cost(value: str, cut: bool, name: str) -> float | None:
    """Edits by which the value stands for the name, a cut costing a little more; None if it does not."""
    if not value:
        return None
    most = allowed(len(name))
    d = edits(value, name, most)
    found = float(d) if d <= most else None
    if 3 <= len(value) < len(name):
        most = 0 if len(value) < 5 else 1 if len(value) < 9 else 2
        p = min(edits(value, name[:k], most) for k in range(max(3, len(value) - 1), min(len(name), len(value) + 1) + 1))
        if p <= most and (cut or len(value) >= 4):
            c = p + (0.25 if cut else 0.75)
            found = c if found is None or c < found else found
    return found


def _tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [tidy(v) for v in batch.column("value").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("value"), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.bool_()), pa.array([pairs(r[0]) if r[0] else [] for r in rows], pa.list_(pa.string()))], names=["value", "tidy", "cut", "pairs"]
        )


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = [cost(*r) for r in zip(*(batch.column(k).to_pylist() for k in ("tidy", "cut", "name")))]
        yield pa.RecordBatch.from_arrays([batch.column("tidy"), batch.column("cut"), batch.column("key"), batch.column("jaccard"), pa.array(c, pa.float64())], names=["tidy", "cut", "key", "jaccard", "cost"])


def match_values(values: DataFrame, names: DataFrame, threshold: float = 0.2) -> DataFrame:
    """(value, key, jaccard, cost): the best entry of each distinct value; key 0 and nulls where none is meant.

    values: (value); names: (key int, name)."""
    tidied = values.select("value").where("value is not null").distinct().mapInArrow(_tidied, "value string, tidy string, cut boolean, pairs array<string>")
    tidied = written(tidied.where("tidy <> ''"), "tidied")
    forms = tidied.groupBy("tidy", "cut").agg(F.first("pairs").alias("pairs"))
    listed = names.select("key", F.col("name").alias("value")).where("value is not null")
    tidy_names = listed.select("value").distinct().mapInArrow(_tidied, "value string, tidy string, cut boolean, pairs array<string>").join(listed, "value").where("tidy <> ''").groupBy("key", F.col("tidy").alias("name")).agg(F.first("pairs").alias("pairs"))
    tidy_names = written(tidy_names, "names")
    rarity = forms.select(F.explode("pairs").alias("pair")).unionAll(tidy_names.select(F.explode("pairs").alias("pair"))).groupBy("pair").agg(F.count("*").alias("n"))
    rarity = written(rarity, "rarity")

    def prefixes(df: DataFrame, keys: list[str]) -> DataFrame:
        placed = df.select(*keys, F.size("pairs").alias("size"), F.explode("pairs").alias("pair")).join(rarity, "pair")
        w = Window.partitionBy(*keys).orderBy("n", "pair")
        return placed.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= F.col("size") - F.ceil(F.lit(threshold) * F.col("size")) + 1)

    x = prefixes(forms, ["tidy", "cut"]).select("tidy", "cut", "pair", F.col("size").alias("nx"), F.col("pos").alias("px"))
    y = prefixes(tidy_names, ["key", "name"]).select("key", "name", "pair", F.col("size").alias("ny"), F.col("pos").alias("py"))
    need = F.ceil(F.lit(threshold) / (1 + F.lit(threshold)) * (F.col("nx") + F.col("ny")))
    long_enough = (F.col("nx") >= threshold * F.col("ny")) & (F.col("ny") >= threshold * F.col("nx"))
    reachable = 1 + F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) + F.least(F.col("px"), F.col("py")) - 1 >= need
    met = x.join(y, "pair").where(long_enough & reachable).select("tidy", "cut", "key", "name").distinct()
    both = met.join(forms, ["tidy", "cut"]).join(tidy_names.withColumnRenamed("pairs", "name_pairs"), ["key", "name"])
    common = F.size(F.array_intersect("pairs", "name_pairs"))
    scored = both.withColumn("jaccard", common / (F.size("pairs") + F.size("name_pairs") - common)).where(F.col("jaccard") >= threshold)
    best = (
        scored.select("tidy", "cut", "name", "key", "jaccard").mapInArrow(_costs, "tidy string, cut boolean, key int, jaccard double, cost double").where("cost is not null")
        .groupBy("tidy", "cut").agg(F.min_by(F.struct("key", "jaccard", "cost"), F.struct(F.col("cost"), -F.col("jaccard"), F.col("key"))).alias("b"))
    )
    out = tidied.select("value", "tidy", "cut").join(best, ["tidy", "cut"], "left")
    return out.select("value", F.coalesce("b.key", F.lit(0)).alias("key"), "b.jaccard", "b.cost")


def map_to_canonical(records: DataFrame, column: str, names: DataFrame, keep_exact: bool = True, threshold: float = 0.2) -> DataFrame:
    """(id, value, key): each record's value with the entry meant, 0 if none is.

    records: (id, ``column``); names: (key int, name, is_name boolean)."""
    present = records.select("id", F.col(column).alias("value")).where(F.col("value").rlike(r"(?U)[^\s ]"))
    if not keep_exact:
        present = present.join(names.where("is_name").select(F.col("name").alias("value")).distinct(), "value", "left_anti")
    matched = match_values(present, names, threshold)
    return present.distinct().join(matched, "value", "left").select("id", "value", F.coalesce("key", F.lit(0)).alias("key")).dropDuplicates(["id"])
