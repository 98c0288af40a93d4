"""Documents packed into containers of fixed capacity by large-item matching.

Documents above one third of the capacity are large: at most two of them fit one container, so they are matched greedily,
each with the largest partner that still fits; smaller documents then go, largest first, to the container with the
smallest gap that takes them, and new containers are opened for the rest. A document longer than the capacity is
split into full containers and one remainder, which is packed like a document.

The plan is made over the counts of documents by size, not over documents: equal sizes are interchangeable, so the whole
plan is a list of container patterns with multiplicities over at most ``capacity`` sizes, whatever the number of
documents. Each document then finds its place by its rank among the documents of its size.

Scale: counts by size are the only thing the driver sees; ranks are taken within (size, salt) and offset by the counts of
earlier salts, so a size that a third of all documents share is ranked by many tasks.

Defined results: null, empty and blank texts have no tokens and are not packed; documents of equal size are ordered by
salt and id; a container never holds more than its capacity.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gacetilla.llm.text import written

SALTS = 64
#: Word pattern of the byte-level vocabulary (a fixed value of that vocabulary).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count_tokens(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            n = [len(encoder.encode_ordinary(t)) if t and not t.isspace() else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "tokens"])

    return run


def token_counts(documents: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, tokens) by the byte-level vocabulary in the file ``tokenizer``; written once."""
    kept = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    return written(kept.mapInArrow(_count_tokens(tokenizer), "doc_id long, tokens long").where("tokens > 0").dropDuplicates(["doc_id"]), "tokens")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Container patterns (sizes) with how many containers follow each, for items of the given sizes and counts."""
    left = Counter({s: n for s, n in counts.items() if n > 0})
    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    bins: list[list] = []  # [sizes, multiplicity, gap]
    for s in large:
        while left[s]:
            partner = next((p for p in large if p <= capacity - s and left[p] - (p == s) > 0), None) if 2 * s > capacity or left[s] > 1 or any(left[p] for p in large if p < s) else None
            if partner is None:
                bins.append([[s], left[s], capacity - s])
                left[s] = 0
            elif partner == s:
                k = left[s] // 2
                bins.append([[s, s], k, capacity - 2 * s])
                left[s] -= 2 * k
            else:
                k = min(left[s], left[partner])
                bins.append([[s, partner], k, capacity - s - partner])
                left[s] -= k
                left[partner] -= k
    open_by_gap: dict[int, list[list]] = {}
    for b in bins:
        open_by_gap.setdefault(b[2], []).append(b)
    for s in sorted((s for s in left if left[s]), reverse=True):
        while left[s]:
            gap = min((g for g, bs in open_by_gap.items() if g >= s and bs), default=None)
            if gap is None:
                per = capacity // s
                whole, rest = divmod(left[s], per)
                for sizes, k in (([s] * per, whole), ([s] * rest, 1 if rest else 0)):
                    if k:
                        b = [sizes, k, capacity - s * len(sizes)]
                        bins.append(b)
                        open_by_gap.setdefault(b[2], []).append(b)
                left[s] = 0
                continue
            b = open_by_gap[gap].pop()
            fit = min(gap // s, left[s] // b[1]) if left[s] >= b[1] else 0
            if fit:
                b[0] += [s] * fit
                b[2] -= s * fit
                left[s] -= fit * b[1]
                open_by_gap.setdefault(b[2], []).append(b)
            else:  # fewer items than containers of this pattern: split it
                k = left[s]
                b[1] -= k
                open_by_gap[gap].append(b)
                new = [[*b[0], s], k, gap - s]
                bins.append(new)
                open_by_gap.setdefault(new[2], []).append(new)
                left[s] = 0
    return [(tuple(b[0]), b[1]) for b in bins if b[1]]


def placements(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int]]:
    """(size, first rank, last rank, first container): runs of ranks that go to consecutive containers, one each."""
    rank: Counter = Counter()
    out, first = [], 0
    for sizes, k in patterns:
        for s in sizes:
            out.append((s, rank[s], rank[s] + k - 1, first))
            rank[s] += k
        first += k
    return out


def pack(counts: DataFrame, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, first_token, tokens, container) of documents (doc_id, tokens)."""
    spark = counts.sparkSession
    full = F.floor(F.col("tokens") / capacity).cast("int")
    pieces = counts.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), F.ceil(F.col("tokens") / capacity).cast("int") - 1)).alias("piece")).select(
        "doc_id", "piece", (F.col("piece") * capacity).cast("long").alias("first_token"), F.when(F.col("piece") < full, F.lit(capacity)).otherwise(F.col("tokens") % capacity).cast("int").alias("size")
    )
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    salted = pieces.groupBy("size", "salt").agg(F.count("*").alias("n"))
    total = {r["size"]: r["n"] for r in salted.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    placed = placements(plan(total, capacity))
    earlier = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offset = salted.select("size", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    runs: dict[int, list] = {}
    for s, a, b, c in placed:
        runs.setdefault(s, []).append((a, b, c))
    by_size = spark.createDataFrame([(s, sorted(v)) for s, v in runs.items()], "size int, runs array<struct<a: long, b: long, c: long>>")
    w = Window.partitionBy("size", "salt").orderBy("doc_id", "piece")
    ranked = pieces.withColumn("rank", F.row_number().over(w) - 1).join(offset, ["size", "salt"]).withColumn("rank", F.col("rank") + F.col("offset"))
    run = F.element_at(F.filter("runs", lambda r: (r["a"] <= F.col("rank")) & (F.col("rank") <= r["b"])), 1)
    return ranked.join(F.broadcast(by_size), "size").select("doc_id", "piece", "first_token", F.col("size").alias("tokens"), run.alias("r"), "rank").select("doc_id", "piece", "first_token", "tokens", (F.col("r.c") + F.col("rank") - F.col("r.a")).alias("container"))


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens, the least number of containers any packing needs, and the share of room used."""
    each = packed.groupBy("container").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    return each.agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.ceil(F.sum("t") / capacity).alias("lower_bound"), F.max("t").alias("fullest"), (F.sum("t") / (F.count("*") * capacity)).alias("used"))
