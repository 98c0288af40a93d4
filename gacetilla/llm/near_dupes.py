"""Near-duplicate records by a prefix join over globally ordered n-gram sets.

A record is the set of runs of n consecutive words in its text. All sets follow one global order, rare n-grams
first, as the paths of a trie would; no trie is built. If sizes x and y need an overlap of o for similarity t, the first k n-grams in common lie
within the first x - o + k of the one and y - o + k of the other, for else the remaining lengths could no longer reach
o. So only the first x - ceil(t x) + k n-grams are stored, a row each, and joined; of the pairs that meet, those are pruned
whose lengths do not allow t, that meet too deep, or that meet fewer than k times (k is MEETINGS, or o where that is
less). The overlap of the others is counted over the whole sets. Nothing is lost: the order decides the work, not the result.

Identical sets are one node, however many records share it. The n-gram frequencies behind the order are counted over
all records, in 2^21 counters, a size that does not depend on the data; n-grams that share a counter only change the order.

Scale: one Arrow pass over the texts; words are written once as packed 32-bit hashes. The join shuffles one small row
for each n-gram of a prefix. Members of an n-gram are sorted by size and crossed step by step within the length bound;
an n-gram of very many records is spread over cells, so that it is split over tasks.

Defined results: records with no run of n words (null, empty, blank, furniture only) are in no pair; a record delivered
twice counts once; similarity is compared as an exact fraction.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gacetilla.llm.boilerplate import Sites
from gacetilla.llm.lines import kept_text
from gacetilla.llm.text import mix, stable_hash, word_table, written

BUCKETS = 1 << 21
CHUNK = 1 << 13
#: n-grams that two records must share within their prefixes to become a candidate pair.
MEETINGS = 5


def _grams(packed: bytes, n: int) -> np.ndarray:
    """Distinct n-grams (32-bit hashes) of packed word hashes, ascending."""
    w = np.frombuffer(packed, np.uint32)
    k = len(w) - n + 1
    g = np.zeros(k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            g = (g ^ w[i : i + k]) * np.uint64(0x9E3779B97F4A7C15)
            g ^= g >> np.uint64(29)
    g = (g >> np.uint64(16)).astype(np.uint32)
    g.sort()
    first = np.ones(k, bool)
    np.not_equal(g[1:], g[:-1], out=first[1:])
    return g[first]


def _sets(n: int, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                texts = [kept_text(t, g) for t, g in zip(batch.column(text).to_pylist(), batch.column("gone").to_pylist())]
                codes, offsets, vocabulary = word_table(texts)
                hashed = np.array([stable_hash(w) >> 32 for w in vocabulary], np.uint32)[codes] if len(codes) else np.empty(0, np.uint32)
                packed, nodes, sizes = [], [], []
                for a, b in zip(offsets[:-1], offsets[1:]):
                    p = hashed[a:b].tobytes()
                    g = _grams(p, n) if b - a >= n else ()
                    packed.append(p)
                    sizes.append(len(g))
                    nodes.append(int.from_bytes(hashlib.blake2b(g.tobytes(), digest_size=8).digest(), "big") >> 1 if len(g) else None)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary())], names=["id", "node", "n", "words"])

    return run


SETS = "id string, node long, n int, words binary"


def article_sets(notes: DataFrame, n: int) -> DataFrame:
    """``ngram_sets`` of the articles' own lines of notes (id string, cuerpo, url_original, fuente)."""
    return written(Sites(notes).marked(notes.where("cuerpo is not null"), ["id", "cuerpo"], _sets(n, "cuerpo"), SETS).where("n > 0"), "ngram-sets")


def ngram_sets(records: DataFrame, n: int) -> DataFrame:
    """(id, node, n, words) of records (id, text): the words, read on across lines, packed, and the number and name of their set of n-grams; written once. Records with equal
    sets have equal nodes."""
    kept = records.select(F.col("id").cast("string").alias("id"), "text", F.lit(None).cast("array<int>").alias("gone")).where("text is not null")
    return written(kept.mapInArrow(_sets(n, "text"), SETS).where("n > 0"), "ngram-sets")


def _count(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int32)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                grams = [_grams(p, n) for p in batch.column("words").slice(start, 1000).to_pylist()]
                at, k = np.unique(np.concatenate(grams) & np.uint32(BUCKETS - 1), return_counts=True)
                total[at] += k.astype(np.int32)
        parts = total.reshape(-1, CHUNK)
        used = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([parts[i].tobytes() for i in used], pa.binary())], names=["chunk", "counts"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
            c = np.frombuffer(counts, np.int32)
            total[chunk] = total[chunk] + c if chunk in total else c
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], names=["chunk", "counts"])


def _frequencies(sets: DataFrame, n: int) -> np.ndarray:
    """In how many records the n-grams of each bucket stand. BUCKETS counters reach the driver, whatever the data."""
    schema = "chunk int, counts binary"
    total = np.zeros((BUCKETS // CHUNK, CHUNK), np.int32)
    for r in sets.select("words").mapInArrow(_count(n), schema).repartition("chunk").mapInArrow(_add, schema).collect():
        total[r["chunk"]] = np.frombuffer(r["counts"], np.int32)
    return total.reshape(-1)


def _prefixes(shared, n: int, num: int, den: int, hot: int):
    """Rows (place, node, depth) of the prefix of each set: place holds the n-gram and its cell, depth the set's size and
    the position. An n-gram of more than ``hot`` records is spread over a triangle of cells; any two of its members
    meet in one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        frequency = shared.value
        for batch in batches:
            places, nodes, depths = [], [], []
            for node, packed in zip(batch.column("node").to_pylist(), batch.column("words").to_pylist()):
                if node in seen:
                    continue
                seen.add(node)
                g = _grams(packed, n)
                size = len(g)
                long = min(size, size + (-size * num // den) + MEETINGS)
                count = frequency[g & np.uint32(BUCKETS - 1)]
                order = np.argsort(count, kind="stable")[:long]
                place = g[order].astype(np.int64) << 32
                depth = (size << 32) + np.arange(long, dtype=np.int64)
                spread = np.where(count[order] > hot, count[order] // hot + 1, 1).astype(np.int64)
                for i in np.flatnonzero(spread > 1):
                    k = int(spread[i])
                    own, other = node % k, np.delete(np.arange(k), node % k)
                    places.append(place[i] + np.minimum(own, other) * k + np.maximum(own, other) + 1)
                    nodes.append(np.full(k - 1, node, np.int64))
                    depths.append(np.full(k - 1, depth[i]))
                places.append(place + np.where(spread > 1, node % spread * (spread + 1) + 1, 0))
                nodes.append(np.full(long, node, np.int64))
                depths.append(depth)
            if places:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (places, nodes, depths)], names=["place", "node", "depth"])

    return run


def _meetings(num: int, den: int):
    """Streams rows sorted by place and size. Gives (a, b, met, least): how often a pair met early enough in both
    prefixes for the overlap that its sizes need, and how often it must."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            a, b, least = (np.concatenate(c) for c in zip(*held))
            held.clear()
            with np.errstate(over="ignore"):
                _, first, met = np.unique(mix(a.astype(np.uint64)) + b.astype(np.uint64), return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(met.astype(np.int32)), pa.array(least[first].astype(np.int32))], names=["a", "b", "met", "least"])

        rest: list[np.ndarray] | None = None

        def work(g: np.ndarray, v: np.ndarray, depth: np.ndarray) -> Iterator[pa.RecordBatch]:
            at, step = np.arange(len(g)), 0
            n, pos = depth >> 32, depth & 0xFFFFFFFF
            while True:
                step += 1
                at = at[at + step < len(g)]
                to = at + step
                # sizes ascend within a run: beyond the length bound no later member fits
                keep = (g[to] == g[at]) & (n[at] * den >= n[to] * num)
                at, to = at[keep], to[keep]
                if not len(at):
                    return
                need = -(-num * (n[at] + n[to]) // (num + den))
                least = np.minimum(need, MEETINGS)
                fit = (pos[at] < n[at] - need + least) & (pos[to] < n[to] - need + least) & (v[at] != v[to])
                if fit.any():
                    x, y = v[at[fit]], v[to[fit]]
                    held.append((np.minimum(x, y), np.maximum(x, y), least[fit]))
                    if sum(len(h[0]) for h in held) > 1_000_000:
                        yield flush()

        for batch in batches:
            cols = [batch.column(k).to_numpy() for k in ("place", "node", "depth")]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            if not len(cols[0]):
                continue
            cut = np.searchsorted(cols[0], cols[0][-1])
            rest = [c[cut:] for c in cols]
            yield from work(*(c[:cut] for c in cols))
        if rest is not None:
            yield from work(*rest)
        if held:
            yield flush()

    return run


def _verify(n: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, common, union = [], [], [], []
            last, p = None, None
            for x, y, wa, wb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "wa", "wb"))):
                if x != last:
                    last, p = x, _grams(wa, n)
                q = _grams(wb, n)
                both = np.concatenate((p, q))
                both.sort(kind="stable")
                k = int((both[1:] == both[:-1]).sum())
                u = len(both) - k
                if k * den >= u * num:
                    a.append(x), b.append(y), common.append(k), union.append(u)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(common, pa.int32()), pa.array(union, pa.int32())], names=["a", "b", "common", "union"])

    return run


def node_links(sets: DataFrame, n: int, threshold: tuple[int, int] = (4, 5), hot: int = 20_000) -> DataFrame:
    """(a, b, common, union), a < b: every two nodes with Jaccard similarity of at least threshold[0]/threshold[1]."""
    num, den = threshold
    shared = sets.sparkSession.sparkContext.broadcast(_frequencies(sets, n))
    prefixes = sets.select("node", "words").mapInArrow(_prefixes(shared, n, num, den, hot), "place long, node long, depth long")
    met = prefixes.repartition("place").sortWithinPartitions("place", "depth").mapInArrow(_meetings(num, den), "a long, b long, met int, least int")
    candidates = written(met.groupBy("a", "b").agg(F.sum("met").alias("met"), F.max("least").alias("least")).where("met >= least").select("a", "b"), "candidates")
    packed = sets.select("node", "words").dropDuplicates(["node"])  # one of equal sets, map-side first
    joined = candidates.join(packed.select(F.col("node").alias("a"), F.col("words").alias("wa")), "a").join(packed.select(F.col("node").alias("b"), F.col("words").alias("wb")), "b")
    return written(joined.select("a", "b", "wa", "wb").mapInArrow(_verify(n, num, den), "a long, b long, common int, union int").dropDuplicates(["a", "b"]), "links")


def near_pairs(sets: DataFrame, links: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: links between nodes and equal sets, expanded to records."""
    members = sets.select("node", "id").distinct()
    twins = members.select("node", F.col("id").alias("id_a")).join(members.select("node", F.col("id").alias("id_b")), "node").where("id_a < id_b").select("id_a", "id_b")
    x = links.select("a", "b").join(members.select(F.col("node").alias("a"), F.col("id").alias("x")), "a").join(members.select(F.col("node").alias("b"), F.col("id").alias("y")), "b")
    return twins.unionByName(x.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")))


def components(links: DataFrame, nodes: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, class): the least node reachable over links, by alternating large-star and small-star steps.

    Each round is written; rounds end when nothing changes, or raise an error after ``rounds`` if that is given. No
    component is ever held by one task."""
    edges = written(links.select(F.col("b").alias("u"), F.col("a").alias("v")), "stars")
    for done in itertools.count(1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        small_m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(small_m.select("u", F.col("m").alias("v"))).distinct()
        new = written(small, "stars")
        if new.count() == edges.count() and new.exceptAll(edges).isEmpty():
            break
        if done == rounds:
            raise RuntimeError(f"components still change after {rounds} rounds")
        edges = new
    return nodes.select("node").distinct().join(edges.groupBy("u").agg(F.min("v").alias("class")), F.col("node") == F.col("u"), "left").select("node", F.coalesce("class", "node").alias("class"))


def near_groups(sets: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class_id, links): the class of each record that has text and how many other records it is linked with."""
    members = sets.select("node", "id").distinct()
    size = members.groupBy("node").agg(F.count("*").alias("size"), F.min("id").alias("first"))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(size.select(F.col("node").alias("b"), "size"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("size").alias("near"))
    of = components(links, size).join(size, "node")
    named = of.join(of.groupBy("class").agg(F.min("first").alias("class_id")), "class").join(degree, "node", "left").select("node", "class_id", (F.coalesce("near", F.lit(0)) + F.col("size") - 1).alias("links"))
    return members.join(named, "node").select("id", "class_id", "links")
