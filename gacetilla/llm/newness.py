"""New batches checked against all history by a prefix-tree hash forest.

A headline becomes several signatures, one for each tree: its words in an order drawn by weighted sampling (a
word's weight is its inverse document frequency), so that two headlines agree on the first word of a tree with about the
probability of their weighted similarity, and on the first two with its square. The history is kept as runs: for each
tree one key a headline, range-partitioned and sorted, whose upper bits are the key of the words before, so that the entries
below a prefix stand together. A batch is joined with all runs on equal keys at the full depth;
headlines without a verified match are searched again with the prefix shortened by one word, until the chance of missing
a headline of the stated similarity is below the recall target. Candidates whose figures, numbers of words, word bits or letter
counts rule them out are dropped within the join (``same_headline`` would reject each of them), the others are verified word by
word. Runs are merged when there are many.

Addresses and headlines of the same words written together are looked up first: the same site and article number (or path) is the
same story. What is left is searched headline by headline, not record by record, however often a headline repeats.

Scale: headlines made of the same phrases meet under their prefixes, so that pairs in the join grow faster than the history; each
costs a few operations on integers there, and what their letters let through to Python is close to what is found. Each search
reads the keys of the whole history, verification its words and the address lookup its links; the
queries check all batches in one pass over one run, so the history is not read again for each batch. Keys are hashes, so a batch
of B headlines asks for B x trees places spread evenly over the sorted run; unless that is fewer than the run's row groups, a range
search reads every one of them, which is what the join does once and in order. Only words in more than one of a thousand headlines get an individual weight: at most
(words a headline) x 1000 of them whatever the size of the history, the bound of the broadcast table.

Defined results: null and blank titles are found by address only, null addresses by title only; ties do not matter,
one match is enough; an empty history leaves every first batch new; repeated rows of history change nothing.
"""

from __future__ import annotations

import html
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gacetilla.llm.canonical import edits
from gacetilla.llm.text import article_key, fold, mix, shared_folder, stable_hash, written

TREES = 12
DEPTHS = (3, 2)
#: Power of the inverse document frequency in the sampling weights.
SHARPNESS = 1.5
#: Words besides link words in which two headlines may differ, each.
MOST_CHANGED = 4
#: Words that are known to carry no weight of their own get this weight; the weight of rare words is log(1 / RARE).
RARE = 0.001

_TAG = re.compile(r"<[^>]{1,80}>")
_LABEL = re.compile(r"^\s*(?:\[[^\]]{1,25}\]|\([^)]{1,20}\)|(?:video|fotos?|audio|ahora|urgente|ultim[ao]s? (?:momento|hora)|en vivo|exclusivo|atencion|actualizado|galeria|imagenes|alerta|importante)\s*[:.|!-]+|[|»>•·*#\-–—:.]+)\s*")
_TAIL = re.compile(r"\s*(?:[|»]\s*[^|»]{2,60}|(?:\s#[^\s#]+)+|(?<=\S{2}) [-–—] (?:[^\s\d:,;|»]+ ?){1,6}|\[[^\]]{1,25}\]|\((?:actualizad[oa]|video|fotos?|audio|en vivo|galeria)[^)]{0,20}\)|[:.,-]\s*(?:las fotos|el video|los detalles|todos los detalles|mira(?: el video)?|minuto a minuto|en vivo|actualizado)|[|»>•·*#\-–—:.…\s]+)\s*$")
#: Phrases that say the same.
_SAME = [(re.compile(r" \| [^,|]{3,50}(?=,|$)"), ""), (re.compile(r"\bse (?:impuso|imponen?|impusieron) en\b"), "gano"), (re.compile(r"\b(?:de acuerdo (?:con|a)|conforme a|en palabras de)\b"), "segun"), (re.compile(r"\b(?:despues|luego) de\b"), "tras")]
_WORD = re.compile(r"[^\W_]+")


def headline(title: str | None) -> str:
    """Folded headline without entities, labels before it and site names or remarks after it."""
    if not title:
        return ""
    s = html.unescape(html.unescape(title))
    s = " ".join(_TAG.sub(" ", fold(s)).split())
    for _ in range(4):
        t = _LABEL.sub("", s)
        if t == s or not t:
            break
        s = t
    for _ in range(4):
        t = _TAIL.sub("", s)
        if t == s or not t:
            break
        s = t
    for pattern, word in _SAME:
        s = pattern.sub(word, s)
    return s


def headline_words(title: str | None) -> list[str]:
    return _WORD.findall(headline(title))


#: Words that do not tell stories apart.
LINKS = frozenset("a al ante bajo con contra de del desde después despues durante e el en entre es fue ha hacia hasta la las le lo los mas ni no o para pero por que se segun sin sobre su sus tras u un una unos unas y ya".split())


def same_headline(a: list[str], b: list[str]) -> bool:
    """Whether two headlines (as words) differ by small edits only, whatever the order of their parts.

    Figures must agree. Link words may be missing, added or exchanged; every other word must have its partner, the
    same word or one slip of the keys away, but for one missing or added word in a long headline."""
    if not a or not b:
        return False
    ca, cb = Counter(a), Counter(b)
    x, y = list((ca - cb).elements()), list((cb - ca).elements())
    if not x and not y or "".join(a) == "".join(b):
        return True
    if any(w.isdigit() for w in x) or any(w.isdigit() for w in y):
        return False
    x, y = [w for w in x if w not in LINKS], [w for w in y if w not in LINKS]
    if max(len(x), len(y)) > MOST_CHANGED or abs(len(x) - len(y)) > 1:
        return False
    alone = 0
    for w in x:
        partner = next((v for v in y if min(len(w), len(v)) > 2 and (edits(w, v, 1) <= 1 or len(w) > 5 and sorted(w) == sorted(v) and edits(w, v, 2) <= 2)), None)
        if partner is None:
            alone += 1
        else:
            y.remove(partner)
    alone += len(y)
    return alone == 0 or alone == 1 and min(len(a), len(b)) >= 8


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i, n in enumerate(batch.schema.names) if n != "titulo"), pa.array([headline_words(t) for t in batch.column("titulo").to_pylist()], pa.list_(pa.string()))], names=[*(n for n in batch.schema.names if n != "titulo"), "words"])


def tokenized(records: DataFrame) -> DataFrame:
    """(id, lote, link, words) of records (key string, lote int, titulo, url), id being the key's hash: written once."""
    kept = records.select(F.xxhash64("key").alias("id"), "lote", article_key(F.col("url")).alias("link"), "titulo")
    return written(kept.mapInArrow(_tokens, "id long, lote int, link string, words array<string>"), "headlines")


def common_words(heads: DataFrame, share: float = RARE) -> dict[str, float]:
    """Inverse document frequencies of the words that stand in more than ``share`` of all headlines."""
    total = heads.count()
    if not total:
        return {}
    seen = heads.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").count().where(F.col("count") > share * total)
    return {r["w"]: max(0.05, math.log(total / r["count"])) for r in seen.collect()}


#: Bits of a key that each word beyond the shallowest depth adds.
WORD_BITS = 16


def _shift(depth: int, depths: tuple[int, ...]) -> int:
    """How far a key is shifted to leave its prefix of a depth."""
    return WORD_BITS * (max(depths) - depth)


#: Letters by the bits of their counters, in two integers of 64 bits; other characters share the last counter of the first.
_COUNTERS = ([*zip("aeoirnsdlt", [6] * 10), ("", 4)], [*zip("cumpbgvqfzhjy", [6] * 2 + [5] * 6 + [4] * 5)])
_KINDS = sum(map(len, _COUNTERS))


def _kind_of() -> np.ndarray:
    """The counter of each character up to 128, which stands for all beyond."""
    kinds = np.full(129, len(_COUNTERS[0]) - 1)
    for k, (letter, _) in enumerate([*_COUNTERS[0], *_COUNTERS[1]]):
        if letter:
            kinds[ord(letter)] = k
    return kinds


_KIND = _kind_of()


def letter_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two integers for each text with the numbers of its letters. A counter of t bits steps through 2 t states, neighbours of which differ
    in one bit: texts whose letters differ in m places, order aside, differ in at most m bits."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    counts = np.bincount(owner * _KINDS + _KIND[np.minimum(chars, 128)], minlength=len(texts) * _KINDS).reshape(-1, _KINDS)
    out, k = [], 0
    for counters in _COUNTERS:
        packed, at = np.zeros(len(texts), np.uint64), 0
        for _, t in counters:
            states = np.array([(1 << c) - 1 if c <= t else (1 << t) - (1 << c - t) for c in range(2 * t)], np.uint64)
            packed |= states[counts[:, k] % (2 * t)] << np.uint64(at)
            at, k = at + t, k + 1
        out.append(packed.view(np.int64))
    return out[0], out[1]


#: What a signature holds of its headline besides its key.
_SHAPE = {"bits": "long", "content": "int", "letters": "int", "counts_a": "long", "counts_b": "long"}


def _may_match():
    """Whether two headlines can pass ``same_headline`` by their shapes (the other's columns begin with other_).

    If as many words stand in either, each of at most MOST_CHANGED pairs of words differs by one slip, in two letters at most. If
    one has a word more, one pair less may differ, and of the letters that are apart those of that word are a surplus on its side."""
    other = {c: F.col(f"other_{c}") for c in _SHAPE}
    more = F.col("content") - other["content"]
    apart = sum(F.bit_count(F.col(c).bitwiseXOR(other[c])) for c in ("counts_a", "counts_b"))
    words = F.bit_count(F.col("bits").bitwiseXOR(other["bits"]))
    return (F.abs(more) <= 1) & (words <= 2 * MOST_CHANGED - F.abs(more)) & (apart - more * (F.col("letters") - other["letters"]) <= 2 * (MOST_CHANGED - F.abs(more)))


def _signatures(shared, trees: int, depths: tuple[int, ...]):
    """Rows (id, lote, tree, figures, shape, key): for each tree a key of the first words of its order. A key's upper bits
    are the key of the words before, so that entries sorted by key stand as the leaves of a prefix tree.

    bits has one of 64 bits for each word but link words: headlines that differ in m words each differ in at most 2 m bits.
    figures is a hash of all figures, which must agree; content counts the words but link words, letters the characters of these
    without figures, of which counts_a and counts_b tell the numbers of each."""
    salts = mix(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    low, high = min(depths), max(depths)
    upper = np.uint64(((1 << 64) - 1) ^ ((1 << WORD_BITS * (high - low)) - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rare = shared.value, math.log(1 / RARE)
        memo: dict[str, tuple[int, float, int, int, int]] = {}
        for batch in batches:
            owner, hashes, w, bits, figures, content, spelled = [], [], [], [], [], [], []
            for i, words in enumerate(batch.column("words").to_pylist()):
                b = f = c = 0
                spelled.append("".join([x for x in words if x not in LINKS and not x.isdigit()]))
                for x in words:
                    m = memo.get(x)
                    if m is None:
                        h = stable_hash(x)
                        m = memo[x] = (h, known.get(x, rare) ** SHARPNESS, 0 if x in LINKS or x.isdigit() else 1 << (h >> 7 & 63), h if x.isdigit() else 0, x not in LINKS)
                    b ^= m[2]
                    f = (f + m[3]) & 0xFFFFFFFFFFFFFFFF
                    c += m[4]
                    owner.append(i), hashes.append(m[0]), w.append(m[1])
                bits.append(b), figures.append(f), content.append(c)
            if len(memo) > 1_000_000:
                memo.clear()
            if not owner:
                continue
            o, h, w = np.array(owner), np.array(hashes, np.uint64), np.array(w)
            once = np.unique(np.stack([o.astype(np.uint64), h]), axis=1, return_index=True)[1]
            o, h, w = o[once], h[once], w[once]
            starts = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
            size = np.diff(np.r_[starts, len(o)])
            keys: list[np.ndarray] = []
            for t in range(trees):
                r = mix(h ^ salts[t])
                race = -np.log((r >> np.uint64(11)).astype(np.float64) / 2.0**53 + 1e-18) / w
                r = r[np.lexsort((h, race, o))]
                acc = np.zeros(len(starts), np.uint64)
                key = acc
                for d in range(high):
                    with np.errstate(over="ignore"):
                        acc = mix(acc * np.uint64(31) + np.where(size > d, r[np.minimum(starts + d, len(r) - 1)], np.uint64(7)))
                    if d + 1 == low:
                        key = acc & upper
                    elif d + 1 > low:
                        at = np.uint64(WORD_BITS * (high - d - 1))
                        key = key | (acc >> np.uint64(64 - WORD_BITS)) << at
                keys.append(key.view(np.int64))
            at = np.tile(o[starts], trees)
            tree = np.repeat(np.arange(trees, dtype=np.int32), len(starts))
            ids, lotes = (batch.column(c).to_numpy(zero_copy_only=False)[at] for c in ("id", "lote"))
            counts = letter_counts(spelled)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(lotes), pa.array(tree), pa.array(np.array(figures, np.uint64)[at].view(np.int64)), pa.array(np.array(bits, np.uint64)[at].view(np.int64)), pa.array(np.array(content, np.int32)[at]), pa.array(np.array([len(t) for t in spelled], np.int32)[at]), *(pa.array(x[at]) for x in counts), pa.array(np.concatenate(keys))],
                names=["id", "lote", "tree", "figures", *_SHAPE, "key"],
            )

    return run


def signatures(heads: DataFrame, weights: dict[str, float], trees: int = TREES, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    shared = heads.sparkSession.sparkContext.broadcast(weights)
    schema = f"id long, lote int, tree int, figures long, {', '.join(f'{c} {t}' for c, t in _SHAPE.items())}, key long"
    return heads.where(F.size("words") > 0).select("id", "lote", "words").mapInArrow(_signatures(shared, trees, depths), schema)


def trees_for(similarity: float, depth: int, recall: float) -> int:
    """Trees of this depth that find a headline of the weighted similarity with the given probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**depth))


class HashForest:
    """Runs of sorted signatures in a folder that all executors share.

    ``add`` writes a run, ``merge`` makes one sorted run of all, ``search`` gives the candidates of a batch."""

    def __init__(self, spark, folder: str, weights: dict[str, float], trees: int = TREES, depths: tuple[int, ...] = DEPTHS):
        self.spark, self.folder, self.weights, self.trees, self.depths = spark, folder, weights, trees, depths
        self.runs: list[str] = []

    def _write(self, rows: DataFrame) -> str:
        path = f"{self.folder}/run-{len(self.runs)}-{uuid.uuid4().hex}"
        rows.repartitionByRange("tree", "key").sortWithinPartitions("tree", "key").write.parquet(path)
        return path

    def add(self, heads: DataFrame) -> None:
        self.runs.append(self._write(signatures(heads, self.weights, self.trees, self.depths)))

    def merge(self) -> None:
        if len(self.runs) > 1:
            self.runs = [self._write(self.rows())]

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(*self.runs)

    def search(self, batch: DataFrame, depth: int) -> DataFrame:
        """(id, other): entries of the forest that came before a batch entry, share a prefix of this depth with it and can
        still be the same headline by their figures, words and letters."""
        prefix = F.shiftright("key", _shift(depth, self.depths)).alias("prefix")
        asked = signatures(batch, self.weights, self.trees, self.depths).select("tree", prefix, "figures", "id", "lote", *_SHAPE)
        held = self.rows().hint("merge").select("tree", prefix, "figures", F.col("id").alias("other"), F.col("lote").alias("earlier"), *(F.col(c).alias(f"other_{c}") for c in _SHAPE))
        return asked.join(held, ["tree", "prefix", "figures"]).where((F.col("earlier") < F.col("lote")) & _may_match()).select("id", "other").distinct()


def _same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [same_headline(a, b) for a, b in zip(batch.column("words").to_pylist(), batch.column("other_words").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(ok, pa.bool_()))], names=["id"])


def verified(candidates: DataFrame, heads: DataFrame) -> DataFrame:
    """The ids whose headline a candidate repeats."""
    words = heads.select("id", "words").hint("merge")  # its size on disk says little about its size in memory
    both = candidates.join(words, "id").join(words.select(F.col("id").alias("other"), F.col("words").alias("other_words")), "other")
    return both.select("id", "words", "other_words").mapInArrow(_same, "id long").distinct()


def _seen_before(heads: DataFrame, asked: DataFrame, column: str) -> DataFrame:
    """(id) of asked entries whose value of the column an earlier entry has."""
    first = heads.where(F.col(column).isNotNull()).groupBy(column).agg(F.min("lote").alias("first"))
    return asked.join(first.hint("merge"), column).where("first < lote").select("id")


def titles(heads: DataFrame) -> DataFrame:
    """(id, lote, words): one entry for all heads of the same words written together, with the first batch that has it; written
    once. However often a headline stands in the history, it is one entry of the forest."""
    told = heads.where(F.size("words") > 0).select(_title().alias("id"), "lote", "words")
    return written(told.groupBy("id").agg(F.min("lote").alias("lote"), F.min("words").alias("words")), "titles")


def _title():
    return F.when(F.size("words") > 0, F.xxhash64(F.array_join("words", "")))


def _known(heads: DataFrame, asked: DataFrame, told: DataFrame, forest: HashForest, similarity: float, recall: float) -> DataFrame:
    """(id) of asked entries whose story an earlier entry of heads tells; told: the titles of heads."""
    narrow, short = (df.select("id", "lote", "link", _title().alias("title")) for df in (heads, asked))
    known = written(_seen_before(narrow, short, "link").unionByName(_seen_before(narrow, short, "title")).distinct(), "known")
    # the other headlines that are not known are those of their first batch: each is looked for once
    left = written(short.join(known.hint("merge"), "id", "left_anti").where("title is not null").select("id", "title", "lote"), "open")
    open_titles = written(told.join(left.select(F.col("title").alias("id"), "lote").distinct().hint("merge"), ["id", "lote"], "left_semi"), "open-titles")
    found = None
    for depth in sorted(forest.depths, reverse=True):
        again = written(verified(forest.search(open_titles, depth), told), "found")
        found = again if found is None else found.unionByName(again)
        if trees_for(similarity, depth, recall) <= forest.trees:
            break
        open_titles = open_titles.join(again, "id", "left_anti")
    return known.unionByName(left.join(found.select(F.col("id").alias("title")), "title", "left_semi").select("id"))


def known_entries(history: DataFrame, batches: DataFrame, similarity: float = 0.6, recall: float = 0.99) -> DataFrame:
    """(key): entries of the batches whose story is in the history or in an earlier batch.

    history: (key, titulo, url); batches: (key, lote, titulo, url). Keys are strings, unique over both."""
    heads = tokenized(history.select("key", F.lit(-1).alias("lote"), "titulo", "url").unionByName(batches.select("key", F.col("lote").cast("int").alias("lote"), "titulo", "url")))
    told = titles(heads)
    forest = HashForest(heads.sparkSession, f"{shared_folder(heads.sparkSession)}/forest", common_words(told))
    forest.add(told)
    known = _known(heads, heads.where("lote >= 0"), told, forest, similarity, recall)
    return batches.select("key", F.xxhash64("key").alias("id")).distinct().join(known.hint("merge"), "id", "left_semi").select("key")


class History:
    """A growing history: each batch is checked against what was added before, then its headlines that are new to it are added as
    a run of their own.

    Word weights are those of the first records; they only decide how selective the trees are. ``merge_at`` runs are
    merged into one."""

    def __init__(self, records: DataFrame, folder: str, merge_at: int = 8):
        first = self._heads(records, -1)
        self.told = titles(first)
        self.forest = HashForest(first.sparkSession, folder, common_words(self.told))
        self.parts, self.merge_at, self.batches = [first], merge_at, 0
        self.forest.add(self.told)

    @staticmethod
    def _heads(records: DataFrame, lote: int) -> DataFrame:
        return tokenized(records.select("key", F.lit(lote).alias("lote"), "titulo", "url"))

    def check_and_add(self, batch: DataFrame, similarity: float = 0.6, recall: float = 0.99) -> DataFrame:
        """(key) of the batch's entries that are known already; the whole batch is then part of the history."""
        asked = self._heads(batch, self.batches)
        heads = asked
        for p in self.parts:
            heads = heads.unionByName(p)
        fresh = written(titles(asked).join(self.told.select("id"), "id", "left_anti"), "titles")
        told = self.told.unionByName(fresh)
        known = written(_known(heads, asked, told, self.forest, similarity, recall), "known")
        self.parts.append(asked)
        self.told = told
        self.forest.add(fresh)
        self.batches += 1
        if len(self.forest.runs) >= self.merge_at:
            self.forest.merge()
            self.parts, self.told = [written(heads, "headlines")], written(told, "titles")
        return batch.select("key", F.xxhash64("key").alias("id")).distinct().join(known, "id", "left_semi").select("key")


def new_entries(history: DataFrame, batches: DataFrame, **options) -> DataFrame:
    """The batch rows that are new."""
    return batches.join(known_entries(history, batches, **options), "key", "left_anti")
