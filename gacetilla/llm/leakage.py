"""Evaluation texts leaking into documents: a BM25 inverted index of the test items with block-max WAND.

The test items are the indexed side. Every run of ``run`` consecutive words of every document is a passage and queries the
index. An item's threshold is the least score that any ``run`` of its words would get, so retrieving all items above their
threshold loses none. The items, sorted by threshold, stand in blocks; each word has its greatest impact in each block. A
passage and a block meet only if the sum of the passage's block maxima reaches the least threshold of the block, which
is worked out for all passages of a batch at once by running sums (a word counts once in a passage); no posting of any other block is touched. Where they meet, the
block's postings are scored, items below their own threshold are left out, and what is retrieved is verified: a run of
``run`` words of the item in the document, in the same order without a gap, in whatever case, accents, punctuation and spacing.

Scale: items are searched in parts of at most ``max_words`` words, whose index (some 40 bytes a word) is broadcast; each part
reads the documents once, and nothing is shuffled but the pairs found.

Defined results: null, empty and blank texts on either side are in no pair; items shorter than ``run`` words are in
none, as they hold no such run; pairs found in several passages or repeated rows count once. An item id with several texts stands for each of them.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gacetilla.llm.text import stable_hash, word_table, words

K1, B = 1.2, 0.75
#: Blocks of an index.
BLOCKS = 64
#: Room for rounding in the comparison of sums.
_SLACK = 1e-5


class ItemIndex:
    """Postings (item, impact) by word and block, the words' block maxima, thresholds of items and blocks, and the items' runs."""

    def __init__(self, items: list[tuple[int, str]], run: int, blocks: int = BLOCKS):
        self.run = run
        split = [(i, words(t)) for i, t in items if t]
        split = [(i, w) for i, w in split if len(w) >= run]
        df = Counter(w for _, ws in split for w in set(ws))
        n = len(split)
        idf = {w: math.log(1 + (n - k + 0.5) / (k + 0.5)) for w, k in df.items()}
        mean = sum(len(ws) for _, ws in split) / n if n else 1.0
        scored = []
        for i, ws in split:
            impact = {w: idf[w] * k * (K1 + 1) / (k + K1 * (1 - B + B * len(ws) / mean)) for w, k in Counter(ws).items()}
            least = min(sum(impact[w] for w in set(ws[s : s + run])) for s in range(len(ws) - run + 1))
            scored.append((least, i, ws, impact))
        scored.sort(key=lambda r: r[:2])
        self.ids = [i for _, i, _, _ in scored]
        self.thresholds = np.array([t for t, *_ in scored])
        size = -(-n // blocks) if n else 1
        self.block_thresholds = self.thresholds[::size] - _SLACK if n else np.empty(0)  # ascending, so the first is the least
        postings: dict[str, dict[int, list[tuple[int, float]]]] = defaultdict(dict)
        hashes, owners = [], []
        for x, (_, _, ws, impact) in enumerate(scored):
            for w, v in impact.items():
                postings[w].setdefault(x // size, []).append((x, v))
            h = run_hashes(np.array([stable_hash(w) for w in ws], np.uint64), run)
            hashes.append(h)
            owners.append(np.full(len(h), x, np.int32))
        self.vocabulary = {w: k for k, w in enumerate(sorted(postings))}
        self.postings = [postings[w] for w in sorted(postings)]
        # block maxima as (word, block, impact)
        self.maxima = np.array([(k, b, max(v for _, v in p)) for k, by in enumerate(self.postings) for b, p in by.items()] or np.empty((0, 3)))
        order = np.argsort(np.concatenate(hashes), kind="stable") if hashes else np.empty(0, np.int64)
        self.hashes, self.owners = (np.concatenate(c)[order] if hashes else np.empty(0, t) for c, t in ((hashes, np.uint64), (owners, np.int32)))

    def meetings(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, block) of the passages of a sequence of terms (-1 for words without postings) that may reach a block's threshold."""
        nothing = np.empty(0, np.int64)
        if len(terms) < self.run or not len(self.ids):
            return nothing, nothing
        used, at = np.unique(terms, return_inverse=True)
        place = np.full(len(self.vocabulary) + 1, -1, np.int64)
        place[used] = np.arange(len(used))  # -1 lands on the extra last entry
        table = np.zeros((len(used), len(self.block_thresholds)))
        rows = place[self.maxima[:, 0].astype(np.int64)]
        held = rows >= 0
        table[rows[held], self.maxima[held, 1].astype(np.int64)] = self.maxima[held, 2]
        # a word counts once in a passage: from the first passage that it ends, or that its last occurrence no longer begins
        here = np.arange(len(terms))
        order = np.argsort(at, kind="stable")
        before = np.full(len(terms), -1, np.int64)
        again = at[order[1:]] == at[order[:-1]]
        before[order[1:][again]] = order[:-1][again]
        since = np.maximum(np.maximum(here - self.run + 1, before + 1), 0)
        starts, blocks = [], []
        scored = np.flatnonzero(terms >= 0)
        word, enter, leave = at[scored], since[scored], scored + 1
        for b, impacts in enumerate(np.ascontiguousarray(table.T)):
            impact = impacts[word]
            some = np.flatnonzero(impact)
            change = np.bincount(enter[some], impact[some], len(terms) + 1)
            change -= np.bincount(leave[some], impact[some], len(terms) + 1)
            live = np.flatnonzero(np.cumsum(change)[: len(terms) - self.run + 1] >= self.block_thresholds[b])
            starts.append(live)
            blocks.append(np.full(len(live), b, np.int64))
        return np.concatenate(starts), np.concatenate(blocks)

    def retrieved(self, terms: list[int], block: int) -> set[int]:
        """Items of the block whose score for these terms reaches their threshold."""
        scores: dict[int, float] = {}
        for t in set(terms):
            if t >= 0:
                for x, v in self.postings[t].get(block, ()):
                    scores[x] = scores.get(x, 0.0) + v
        return {x for x, v in scores.items() if v >= self.thresholds[x] - _SLACK}

    def holding(self, hashes: np.ndarray) -> set[int]:
        """Items that hold one of these runs."""
        a, b = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        return {int(x) for i, j in zip(a[b > a], b[b > a]) for x in self.owners[i:j]}


def run_hashes(hashes: np.ndarray, run: int) -> np.ndarray:
    """Of every run of words, by their stable hashes."""
    k = max(len(hashes) - run + 1, 0)
    h = np.zeros(k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(run):
            h = (h ^ hashes[i : i + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = shared.value
        size = index.run
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                ids = batch.column("doc_id").to_pylist()
                codes, offsets, vocabulary = word_table(batch.column("text").to_pylist())
                known = np.array([index.vocabulary.get(w, -1) for w in vocabulary], np.int64)
                terms = known[codes] if len(codes) else codes
                docs, items = [], []
                live, blocks = index.meetings(terms)
                owner = np.searchsorted(offsets, live, side="right") - 1
                inside = live + size <= offsets[owner + 1]
                live, blocks, owner = live[inside], blocks[inside], owner[inside]
                # neighbouring passages of a document that meet one block are queried as one stretch
                heads = np.flatnonzero(np.r_[True, (live[1:] != live[:-1] + 1) | (owner[1:] != owner[:-1]) | (blocks[1:] != blocks[:-1])]) if len(live) else live
                for head, after in zip(heads, np.r_[heads[1:], len(live)]):
                    first, last = int(live[head]), int(live[after - 1]) + size
                    got = index.retrieved(terms[first:last].tolist(), int(blocks[head]))
                    if got:
                        got &= index.holding(run_hashes(np.array([stable_hash(vocabulary[c]) for c in codes[first:last].tolist()], np.uint64), size))
                        docs += [ids[owner[head]]] * len(got)
                        items += [index.ids[x] for x in got]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64())], names=["doc_id", "item_id"])

    return run


def find_leaks(documents: DataFrame, items: DataFrame, run: int = 12, max_words: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id): documents that hold ``run`` or more consecutive words of an item.

    documents: (doc_id, text); items: (item_id, text). A text's words are counted by its characters, four to a word at most."""
    kept = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    given = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    # items are spread over the parts by hash
    total = given.agg(F.sum(F.ceil(F.char_length("text") / 4) + 1).alias("n")).first()["n"] or 0
    parts = -(-total // max_words) if total else 0
    found = None
    for part in range(parts):
        rows = given.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()  # about max_words words
        shared = documents.sparkSession.sparkContext.broadcast(ItemIndex(sorted((r["item_id"], r["text"]) for r in rows), run))
        one = kept.mapInArrow(_search(shared), "doc_id long, item_id long")
        found = one if found is None else found.unionByName(one)
    return found.distinct() if found is not None else kept.select("doc_id", F.lit(0).cast("long").alias("item_id")).limit(0)
