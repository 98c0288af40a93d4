"""Main content of pages by nearest-URL page differencing.

Pages are sorted by site and address; each page is aligned with its nearest neighbours of the same site by longest common
subsequence over its lines. Two lines align if they share a token (``lines``): they are word for word the same but for
figures, or have the same opening, the same shape around other names, the same closing, or follow the same line. What
neighbouring pages share belongs to the site. Pages that carry the same story are no pair; a token that the next
neighbours lack is looked for in the nearest earlier page of the site that has it.

Each site decides by its own pages: a token's lines are deleted on the sites whose pairs shared it often enough, and everywhere
only if pairs of several sites did.

Scale: one pass over the texts in Arrow batches leaves some ten eight-byte tokens a page, written once, one row a page;
it is range-partitioned by site and address, so that a site with a third of all pages is split over many tasks. Nothing is
collected here. ``Sites`` gives other operators the site's lines by a broadcast of (site, token) hashes only if these are
counted to be at most ``MOST_SHARED``; else by a join.

Defined results: null, empty and blank texts have no lines; a page without address takes its source as
site; repeated rows give one result and no evidence; a site with few comparable pages is judged by what pages of all sites share.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gacetilla.llm.lines import AFTER, LITERAL, PROSE, SHAPE, WITHIN, Describer, page_tokens
from gacetilla.llm.text import article_number, mix, site, source_key, stable_hash, written

PAGE_SCHEMA = "id string, host string, path string, nos array<int>, toks array<array<long>>, sorts array<byte>"
#: (site, token) hashes that may be broadcast, 16 MB; with more of them the lines are joined instead.
MOST_SHARED = 2_000_000


def host_of(url: Column, source: Column) -> Column:
    """The site of a page: that of its address, else its source, else ''."""
    return F.coalesce(site(url), source_key(source), F.lit(""))


def _paginate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    describer = Describer()
    for batch in batches:
        nos, toks, sorts = [], [], []
        for text in batch.column("cuerpo").to_pylist():
            rows = page_tokens(text, describer)
            nos.append([r[0] for r in rows])
            toks.append([r[1] for r in rows])
            sorts.append([r[2] for r in rows])
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("host"), batch.column("path"), pa.array(nos, pa.list_(pa.int32())), pa.array(toks, pa.list_(pa.list_(pa.int64()))), pa.array(sorts, pa.list_(pa.int8()))],
            names=["id", "host", "path", "nos", "toks", "sorts"],
        )


def pages(notes: DataFrame) -> DataFrame:
    """The line tokens of each page with its site and a sortable address, one row an id, written once."""
    number = article_number(F.col("url_original"))
    address = F.lower(F.regexp_replace(F.trim("url_original"), r"^[a-z]+://[^/?]*|#.*$", ""))
    keyed = notes.select("id", host_of(F.col("url_original"), F.col("fuente")).alias("host"), F.coalesce(F.lpad(number, 18, "0"), address, F.lit("")).alias("path"), "cuerpo").where("cuerpo is not null and id is not null")
    return written(keyed.mapInArrow(_paginate, PAGE_SCHEMA).dropDuplicates(["id"]), "pages")


def common_subsequence(a: list[tuple[int, ...]], b: list[tuple[int, ...]]) -> set[int]:
    """The tokens by which the lines of a longest common subsequence of two pages align; lines are tuples of tokens and align
    if they share one."""
    common = {t for x in a for t in x} & {t for x in b for t in x}
    if not common:
        return set()
    sa = [k for x in a if (k := common.intersection(x))]
    sb = [k for x in b if (k := common.intersection(x))]
    met: set[int] = set()
    while sa and sb and sa[0] & sb[0]:
        met |= sa.pop(0) & sb.pop(0)
    while sa and sb and sa[-1] & sb[-1]:
        met |= sa.pop() & sb.pop()
    if sa and sb:
        width = len(sb) + 1
        best = [[0] * width for _ in range(len(sa) + 1)]
        for i in range(len(sa) - 1, -1, -1):
            row, below, x = best[i], best[i + 1], sa[i]
            for j in range(len(sb) - 1, -1, -1):
                row[j] = max(below[j + 1] + (not x.isdisjoint(sb[j])), below[j], row[j + 1])
        i = j = 0
        while i < len(sa) and j < len(sb):
            if best[i][j] == best[i + 1][j]:
                i += 1
            elif best[i][j] == best[i][j + 1]:
                j += 1
            else:
                met |= sa[i] & sb[j]
                i, j = i + 1, j + 1
    return met


class _Page:
    __slots__ = ("lines", "own", "prose")

    def __init__(self, lines: list[tuple[int, ...]], sorts: list[int], recurrent: frozenset[int]):
        self.lines = list({x[0]: x for x in reversed(lines) if x}.values())[::-1]  # a line that a page repeats counts once
        self.prose = {x[0] for x, s in zip(lines, sorts) if x and s == PROSE}
        self.own = self.prose - recurrent or {x[0] for x, s in zip(lines, sorts) if x and s != PROSE} - recurrent

    def same_story(self, other: _Page) -> bool:
        """Whether two pages tell one story, by their prose but for lines that recur over the site (by other lines if there is none).

        Recurrent lines alone make no story, unless there are three and they are most of a page or nothing else is there."""
        both = len(self.prose & other.prose)
        if not self.own or not other.own:
            return both > 0 and both * 3 >= min(len(self.prose), len(other.prose))
        same = len(self.own & other.own)
        return same > 0 and same * 3 >= min(len(self.own), len(other.own)) or both >= 3 and both * 2 > min(len(self.prose), len(other.prose))


def _differences(partners: int):
    """Compares each page with the nearest earlier pages of its site in a partition sorted by site and address.

    Each page is paired with the nearest ``partners`` earlier pages that carry another story, however far back they are, and
    for each token that may be the site's with the nearest earlier page that has it and another story: what is rare is never met
    next door. A pair counts once for a token. The row with a null token counts the compared pages of a site."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared: dict[tuple[str, int | None], int] = {}
        recent: deque[_Page] = deque(maxlen=64)
        carriers: dict[int, deque[_Page]] = {}
        site_now = None
        for batch in batches:
            for host, toks, sorts, recurrent in zip(*(batch.column(c).to_pylist() for c in ("host", "toks", "sorts", "recurrent"))):
                if host != site_now:
                    site_now = host
                    recent.clear()
                    carriers.clear()
                again = frozenset(recurrent or ())
                page = _Page(toks, sorts, again)
                kinds = {t for x, s in zip(toks, sorts) if s != PROSE for t in x} | again
                met: set[int] = set()
                used = 0
                for other in reversed(recent):
                    if page.same_story(other):
                        continue
                    for t in common_subsequence(page.lines, other.lines):
                        shared[host, t] = shared.get((host, t), 0) + 1
                        met.add(t)
                    used += 1
                    if used == partners:
                        break
                if used:
                    shared[host, None] = shared.get((host, None), 0) + 1
                wanted: dict[int, tuple[_Page, list[int]]] = {}
                for t in kinds - met:
                    for other in reversed(carriers.get(t, ())):
                        if not page.same_story(other):
                            wanted.setdefault(id(other), (other, []))[1].append(t)
                            break
                for other, tokens in wanted.values():
                    for t in common_subsequence(page.lines, other.lines).intersection(tokens):
                        shared[host, t] = shared.get((host, t), 0) + 1
                recent.append(page)
                for t in kinds:
                    held = carriers.get(t)
                    if held is None:
                        held = carriers[t] = deque(maxlen=2)
                    # of pages that tell one story the first is enough, so that a story's copies do not hide the others
                    if not held or not page.same_story(held[-1]):
                        held.append(page)
            if len(shared) > 200_000:
                yield _flush(shared)
        yield _flush(shared)

    return run


def _flush(shared: dict[tuple[str, int | None], int]) -> pa.RecordBatch:
    out = pa.RecordBatch.from_arrays([pa.array([h for h, _ in shared], pa.string()), pa.array([t for _, t in shared], pa.int64()), pa.array(list(shared.values()), pa.int64())], names=["host", "tok", "shared"])
    shared.clear()
    return out


def _kind(tok: Column) -> Column:
    return tok.bitwiseAND(7)


def recurrent_lines(pages_table: DataFrame, many: int) -> DataFrame:
    """(id, recurrent): the literal tokens of each page that stand on at least ``many`` pages of its site."""
    literal = pages_table.select("id", "host", F.explode(F.array_distinct(F.transform(F.filter("toks", lambda x: F.size(x) > 0), lambda x: x[0]))).alias("tok")).select("id", "tok", F.xxhash64("host", "tok").alias("key"))
    often = literal.groupBy("key").count().where(F.col("count") >= many).select("key")
    return literal.join(often, "key", "left_semi").groupBy("id").agg(F.collect_list("tok").alias("recurrent"))


def site_tokens(pages_table: DataFrame, partners: int = 2, least_pairs: int = 5, least_rate: float = 0.01, least_open_rate: float = 0.002, least_pooled_rate: float = 0.0005, least_compared: int = 50, many: int = 10, most_within: float = 0.35, least_followed: float = 0.4, least_sites: int = 5) -> DataFrame:
    """(host, tok) of the tokens that belong to each site; written once.

    A literal token needs ``least_pairs`` pairs of the site's pages that share it (on sites of fewer than 20 times as many
    compared pages one in 20 of these) and as many as ``least_rate`` of its occurrences there; or one pair if on all sites
    together pairs as many as ``least_pooled_rate`` of the compared pages share it.

    The other tokens leave something open. They need as many pairs as ``least_open_rate`` of the site's compared pages, one at
    least, and ``least_pooled_rate`` over all sites. A shape must not be the article's own (a subhead): not more than
    ``most_within`` of its lines stand between the article's sentences. A line that others follow must be followed so in
    ``least_followed`` of its occurrences.

    What pairs of at least ``least_sites`` sites share, and as many as ``least_pooled_rate`` asks for, is taken for the
    site's on every site. Sites of fewer than ``least_compared`` compared pages take the evidence of all sites."""
    order = pages_table.select("id", "host", "path", "toks", "sorts").join(recurrent_lines(pages_table, many), "id", "left")
    aligned = (
        order.repartitionByRange("host", "path", "id").sortWithinPartitions("host", "path", "id").select("host", "toks", "sorts", "recurrent")
        .mapInArrow(_differences(partners), "host string, tok long, shared long").groupBy("host", "tok").agg(F.sum("shared").alias("shared"))
    )
    aligned = written(aligned, "aligned")
    sites = aligned.where("tok is null").select("host", F.col("shared").alias("compared"))
    shares = aligned.where("tok is not null")
    # how often the tokens that any pair shared stand on each site, in one row a token
    flat = pages_table.select("host", F.explode(F.arrays_zip("toks", "sorts")).alias("l")).select("host", F.explode("l.toks").alias("tok"), (F.col("l.sorts") == WITHIN).cast("int").alias("within"))
    seen = flat.groupBy("host", "tok").agg(F.count("*").alias("seen"), F.sum("within").alias("within")).join(shares.select("tok").distinct(), "tok", "left_semi")
    own = written(seen.join(shares, ["host", "tok"], "left").join(sites, "host", "left").fillna(0, ["shared", "compared"]).select("host", "tok", "seen", "within", "shared", "compared"), "shares")
    pooled = own.groupBy("tok").agg(F.sum("shared").alias("all_shared"), F.sum("seen").alias("all_seen"), F.sum("within").alias("all_within"), F.count_if(F.col("shared") > 0).alias("sharing"))
    followed = pooled.where(_kind(F.col("tok")) == LITERAL).select((F.col("tok") + AFTER - LITERAL).alias("tok"), F.col("all_seen").alias("anchors"))
    pooled = pooled.join(followed, "tok", "left").crossJoin(sites.agg(F.coalesce(F.sum("compared"), F.lit(0)).alias("all_compared")))
    kind, few = _kind(F.col("tok")), F.col("compared") < least_compared
    common = F.col("all_shared") >= F.greatest(F.lit(1.0), least_pooled_rate * F.col("all_compared"))
    usual = common & (F.col("sharing") >= least_sites)

    def literal(shared: str, seen: str, compared: str) -> Column:
        return (F.col(shared) >= F.greatest(F.lit(1.0), F.least(F.lit(float(least_pairs)), F.col(compared) / 20))) & (F.col(shared) >= least_rate * F.col(seen))

    whole = usual | F.when(few, literal("all_shared", "all_seen", "all_compared")).otherwise(literal("shared", "seen", "compared") | (F.col("shared") >= 1) & common)
    open_ = common & (usual | few | (F.col("shared") >= F.greatest(F.lit(1.0), least_open_rate * F.col("compared"))))
    outside = (kind != SHAPE) | (F.col("all_within") <= most_within * F.col("all_seen"))
    follows = (kind != AFTER) | F.coalesce(F.col("all_seen") >= least_followed * F.col("anchors"), F.lit(False))
    return written(own.join(pooled, "tok").where(F.when(kind == LITERAL, whole).otherwise(open_ & outside & follows)).select("host", "tok"), "site-tokens")


def furniture_lines(pages_table: DataFrame, tokens: DataFrame) -> DataFrame:
    """(id, line_no) of the lines that hold one of their site's tokens, prose by its literal only."""
    lines = pages_table.select("id", "host", F.explode(F.arrays_zip("nos", "toks")).alias("l")).select("id", "host", F.col("l.nos").alias("line_no"), F.explode("l.toks").alias("tok"))
    return lines.join(tokens, ["host", "tok"], "left_semi").select("id", "line_no").distinct()


def find_boilerplate(notes: DataFrame, **options) -> DataFrame:
    """(id, line_no) of the non-blank lines of cuerpo that belong to the site and not to the article.

    ``notes`` needs id, cuerpo, url_original and fuente; other columns are ignored."""
    table = pages(notes)
    return furniture_lines(table, site_tokens(table, **options))


def _mark(shared, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray = shared.value
        describer = Describer()
        for batch in batches:
            texts = [page_tokens(t, describer) for t in batch.column("cuerpo").to_pylist()]
            lines = [r for rows in texts for r in rows]
            flat = np.array([t for r in lines for t in r[1]], np.int64)
            sizes = np.array([len(r[1]) for r in lines], np.int64)
            page_of = np.repeat(np.arange(len(texts)), [len(rows) for rows in texts])
            hosts = np.array([stable_hash(h) for h in batch.column("_host").to_pylist()], np.uint64)
            keys = _site_key(hosts[np.repeat(page_of, sizes)] if len(flat) else np.empty(0, np.uint64), flat)
            at = np.searchsorted(held, keys)
            hit = held[np.minimum(at, len(held) - 1)] == keys if len(held) else np.zeros(len(keys), bool)
            sums = np.r_[0, np.cumsum(hit)]
            ends = np.cumsum(sizes)
            gone = (sums[ends] > sums[ends - sizes]) if len(lines) else np.zeros(0, bool)
            numbers = np.array([r[0] for r in lines], np.int32)[gone]
            offsets = np.r_[0, np.cumsum(np.bincount(page_of[gone], minlength=len(texts)))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.ListArray.from_arrays(pa.array(offsets), pa.array(numbers, pa.int32()))], names=[*columns, "gone"])

    return run


def _site_key(hosts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(tokens.view(np.uint64) + hosts)


def _site_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts = np.array([stable_hash(h) for h in batch.column("host").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(_site_key(hosts, batch.column("tok").to_numpy()).view(np.int64))], names=["key"])


class Sites:
    """The tokens of all sites, learned from all notes: ``marked`` tells which lines of some of these notes belong to their site.

    The tokens are broadcast as sorted hashes if they are counted to be at most ``most_shared``; else each page's lines are joined."""

    def __init__(self, notes: DataFrame, most_shared: int = MOST_SHARED, **options):
        self.pages = pages(notes)
        self.tokens = site_tokens(self.pages, **options)
        self.shared = None
        if self.tokens.count() <= most_shared:
            keys = self.tokens.mapInArrow(_site_keys, "key long").toArrow()  # at most most_shared
            self.shared = notes.sparkSession.sparkContext.broadcast(np.sort(keys.column("key").to_numpy().view(np.uint64)))

    def marked(self, notes: DataFrame, columns: list[str], then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, schema: str = "") -> DataFrame:
        """The given columns (id and cuerpo among them) and gone, the numbers of the lines of cuerpo that belong to the site; or what
        ``then`` makes of their batches, in the same pass, with its schema.

        Null texts have no such lines; ids and texts must be those from which the sites were learned."""
        if self.shared is None:
            gone = furniture_lines(self.pages, self.tokens).groupBy("id").agg(F.collect_list("line_no").alias("gone"))
            joined = notes.select(*columns).join(gone, "id", "left")
            return joined.mapInArrow(then, schema) if then else joined
        source = notes.select(*columns, host_of(F.col("url_original"), F.col("fuente")).alias("_host"))
        kinds = dict(notes.select(*columns).dtypes)
        mark = _mark(self.shared, columns)
        if then:
            return source.mapInArrow(lambda batches: then(mark(batches)), schema)
        return source.mapInArrow(mark, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", gone array<int>")


def main_text(notes: DataFrame, furniture: DataFrame) -> DataFrame:
    """(id, cuerpo) with the furniture lines deleted and the others kept in their order; null stays null."""
    gone = furniture.groupBy("id").agg(F.collect_list("line_no").alias("_gone"))
    kept = F.filter(F.split("cuerpo", "\n", -1), lambda x, i: ~F.array_contains(F.coalesce("_gone", F.array().cast("array<int>")), i + 1))
    return notes.select("id", "cuerpo").dropDuplicates(["id"]).join(gone, "id", "left").select("id", F.array_join(kept, "\n").alias("cuerpo"))
