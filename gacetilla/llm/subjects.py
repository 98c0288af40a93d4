"""Subject areas of documents by labelling functions and a latent model of their accuracies.

Five labelling functions vote on each paragraph: single words and word pairs of a lexicon, the section, the words of
the address, and the source. Their lexicons come from a bounded sample of labelled documents (``max_labelled``), by
naive Bayes with paragraph labels refined by expectation-maximisation within the labels of a document. The accuracies
of the functions are then learned without labels: votes of all paragraphs of all documents are counted by pattern, and
EM over the patterns fits one accuracy for each function and the prior of each subject. A paragraph treats of a
subject by its posterior; a document has the subjects of at least a third of its paragraphs.

Scale: one Arrow pass over the texts; vote patterns are at most (subjects+1)^5 rows however large the corpus; the
lexicon is bounded by the labelled sample. Counts cover all documents.

Defined results: documents without main text have no subject; unknown sections, sources and words abstain; repeated
rows give one result; without any labelled document nothing is assigned.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gacetilla.llm.boilerplate import Sites
from gacetilla.llm.lines import main_lines
from gacetilla.llm.text import words, written

LEAST_CHARS = 60
FUNCTIONS = 5


def _features(text: str) -> tuple[list[str], list[str]]:
    w = [x for x in words(text) if len(x) > 2 and not x.isdigit()]
    return w, [f"{a} {b}" for a, b in zip(w, w[1:])]


def paragraphs(text: str | None, gone=None, least: int = LEAST_CHARS) -> list[str]:
    return [s for _, s in main_lines(text, gone) if len(s) >= least]


def _section(s: str | None) -> str:
    return " ".join(words(s)) if s else ""


def _slug(url: str | None) -> list[str]:
    return [x for x in words(url.split("://")[-1].partition("/")[2]) if len(x) > 2 and not x.isdigit()] if url else []


class Lexicon:
    """Log-probabilities of words and word pairs by subject, and the majority subject of sections and sources."""

    def __init__(self, subjects: list[int]):
        self.subjects, self.single, self.pair = subjects, {}, {}
        self.section: dict[str, int] = {}
        self.source: dict[str, int] = {}

    @staticmethod
    def fit(documents: list[tuple[list[str], set[int], str, str]], subjects: list[int], seeds: dict[int, list[str]], rounds: int = 4) -> Lexicon:
        """documents: (paragraphs, labels, section, source)."""
        self, k = Lexicon(subjects), len(subjects)
        at = {s: i for i, s in enumerate(subjects)}
        rows = [(_features(p), {at[x] for x in labels if x in at}) for ps, labels, *_ in documents for p in ps]
        rows = [r for r in rows if r[1]]
        if not rows:
            return self
        seen = [Counter(w for (u, _), _ in rows for w in set(u)), Counter(w for (_, b), _ in rows for w in set(b))]
        index = [{w: i for i, (w, n) in enumerate(sorted((w, n) for w, n in c.items() if n >= least))} for c, least in zip(seen, (2, 3))]
        ids = [[np.array(sorted({index[j][w] for w in f[j] if w in index[j]}), np.int64) for f, _ in rows] for j in (0, 1)]
        prior = np.full((len(rows), k), 0.08 / k)
        for i, (_, own) in enumerate(rows):
            prior[i, list(own)] += 0.92 / len(own)
        post = prior.copy()
        for _ in range(rounds):
            tables = []
            for j in (0, 1):
                n = np.full((len(index[j]), k), 0.02)
                for i, ws in enumerate(ids[j]):
                    n[ws] += post[i]
                if j == 0:
                    for s, ws in seeds.items():
                        for w in ws:
                            if w in index[0] and s in at:
                                n[index[0][w], at[s]] += 2
                share = n / n.sum(0)
                rate = share / share.sum(1, keepdims=True)
                weight = 1 - (-(rate * np.log(rate + 1e-12)).sum(1) / math.log(k))  # how much a word tells
                tables.append(np.log(share) * weight[:, None])
            score = np.log(prior)
            for i in range(len(rows)):
                score[i] += tables[0][ids[0][i]].sum(0) + tables[1][ids[1][i]].sum(0)
            score -= score.max(1, keepdims=True)
            post = np.exp(score)
            post /= post.sum(1, keepdims=True)
        self.single = {w: tables[0][i] - tables[0][i].mean() for w, i in index[0].items() if np.ptp(tables[0][i]) > 0.3}
        self.pair = {w: tables[1][i] - tables[1][i].mean() for w, i in index[1].items() if np.ptp(tables[1][i]) > 0.3}
        for n, field in ((2, self.section), (3, self.source)):
            by: dict[str, Counter] = defaultdict(Counter)
            for d in documents:
                for label in d[1]:
                    by[d[n]][label] += 1
            for value, c in by.items():
                label, top = c.most_common(1)[0]
                if value and top >= 3 and top >= 0.6 * sum(c.values()):
                    field[value] = label
        return self

    def vote(self, table: dict[str, np.ndarray], found: list[str], margin: float) -> int:
        total = None
        for w in found:
            x = table.get(w)
            if x is not None:
                total = x.copy() if total is None else total + x
        if total is None:
            return 0
        best = int(total.argmax())
        rest = np.partition(total, -2)[-2] if len(total) > 1 else -math.inf
        return best + 1 if total[best] - rest >= margin else 0


def _vote(lexicon: Lexicon, margin: float):
    at = {s: i + 1 for i, s in enumerate(lexicon.subjects)}
    base = len(lexicon.subjects) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, gone, section, url, source in zip(*(batch.column(c).to_pylist() for c in ("cuerpo", "gone", "seccion", "url_original", "fuente"))):
                codes = []
                ps = paragraphs(text, gone)
                if ps:
                    shared = (at.get(lexicon.section.get(_section(section)), 0), lexicon.vote(lexicon.single, _slug(url), margin), at.get(lexicon.source.get(_section(source)), 0))
                    for p in ps:
                        single, pair = _features(p)
                        code = 0
                        for v in (lexicon.vote(lexicon.single, single, margin), lexicon.vote(lexicon.pair, pair, margin), *shared):
                            code = code * base + v
                        codes.append(code)
                out.append(codes)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.list_(pa.int64()))], names=["id", "codes"])

    return run


def latent_accuracies(patterns: dict[int, int], k: int, rounds: int = 25) -> dict[int, np.ndarray]:
    """Posterior over k subjects of each vote pattern: one accuracy for each function, fitted by EM over counts."""
    base = k + 1
    codes = sorted(patterns)
    n = np.array([patterns[c] for c in codes], float)
    votes = np.array([[c // base**j % base for j in range(FUNCTIONS - 1, -1, -1)] for c in codes])
    accuracy, prior = np.array([0.9, 0.9, 0.6, 0.6, 0.4]), np.full(k, 1 / k)
    post = np.full((len(codes), k), 1 / k)
    for _ in range(rounds):
        score = np.tile(np.log(prior), (len(codes), 1))
        for j in range(FUNCTIONS):
            score += np.log((1 - accuracy[j]) / max(k - 1, 1)) * (votes[:, j] > 0)[:, None]
            hit = np.flatnonzero(votes[:, j])
            score[hit, votes[hit, j] - 1] += np.log(accuracy[j]) - np.log((1 - accuracy[j]) / max(k - 1, 1))
        score -= score.max(1, keepdims=True)
        post = np.exp(score)
        post /= post.sum(1, keepdims=True)
        for j in range(FUNCTIONS):
            hit = np.flatnonzero(votes[:, j])
            if len(hit):
                right = (post[hit, votes[hit, j] - 1] * n[hit]).sum()
                accuracy[j] = min(0.995, max(1.0 / k + 1e-3, (right + 1) / (n[hit].sum() + 2)))
        voted = votes.any(1)
        prior = (post[voted] * n[voted, None]).sum(0) + 1
        prior /= prior.sum()
    silent = ~votes.any(1)
    post[silent] = 0
    return dict(zip(codes, post))


_COLUMNS = ["id", "cuerpo", "seccion", "url_original", "fuente"]


def fit_lexicon(notes: DataFrame, labels: DataFrame, themes: DataFrame, sites: Sites, max_labelled: int = 4000, max_themes: int = 1000) -> Lexicon:
    """The lexicon from at most ``max_labelled`` labelled documents, taken by hash of their id."""
    names = themes.limit(max_themes + 1).collect()
    if len(names) > max_themes:
        raise ValueError(f"more than {max_themes} subjects")
    subjects = sorted(r["tema_id"] for r in names)
    seeds = {r["tema_id"]: words(f"{r['nombre']} {r['descripcion'] or ''}") for r in names}
    sample = labels.where("id is not null and tema_id is not null").groupBy("id").agg(F.collect_set("tema_id").alias("temas")).orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    named = notes.select(*_COLUMNS).join(F.broadcast(sample), "id").dropDuplicates(["id"])
    rows = sites.marked(named, [*_COLUMNS, "temas"]).collect()
    documents = [(paragraphs(r["cuerpo"], r["gone"]), set(r["temas"]), _section(r["seccion"]), _section(r["fuente"])) for r in sorted(rows, key=lambda r: r["id"])]
    return Lexicon.fit(documents, subjects, seeds)


def subject_votes(notes: DataFrame, lexicon: Lexicon, sites: Sites, margin: float = 1.0) -> DataFrame:
    """(id, codes): the vote pattern of each paragraph, written once."""
    return written(sites.marked(notes.where("cuerpo is not null"), _COLUMNS, _vote(lexicon, margin), "id string, codes array<long>"), "subject-votes")


def find_subjects(notes: DataFrame, labels: DataFrame, themes: DataFrame, max_labelled: int = 4000, least_share: float = 1 / 3, least_posterior: float = 0.5, max_patterns: int = 1_000_000) -> DataFrame:
    """(id, tema_id, share, posterior) of each document's subjects. Vote patterns are at most (subjects + 1)^5, some 371,000 for
    twelve; more than ``max_patterns`` raise an error."""
    sites = Sites(notes)
    lexicon = fit_lexicon(notes, labels, themes, sites, max_labelled)
    k = len(lexicon.subjects)
    voted = subject_votes(notes, lexicon, sites)
    patterns = voted.select(F.explode("codes").alias("code")).groupBy("code").count()
    known = patterns.limit(max_patterns + 1).collect()
    if len(known) > max_patterns:
        raise ValueError(f"more than {max_patterns} vote patterns")
    counted = {r["code"]: r["count"] for r in known}
    rows = [(c, lexicon.subjects[int(p.argmax())], float(p.max())) for c, p in latent_accuracies(counted, k).items() if p.max() >= least_posterior] if counted and k else []
    posterior = notes.sparkSession.createDataFrame(rows, "code long, tema_id int, posterior double")
    each = voted.select("id", F.size("codes").alias("n"), F.explode("codes").alias("code")).join(posterior, "code")
    shares = each.groupBy("id", "tema_id").agg(F.count("*").alias("k"), F.first("n").alias("n"), F.avg("posterior").alias("posterior"))
    # a document delivered twice has each paragraph twice: k counts over deliveries
    deliveries = voted.groupBy("id").agg(F.count("*").alias("times"))
    return shares.join(deliveries, "id").where(F.col("k") / F.col("times") >= least_share * F.col("n") - 1e-9).select("id", "tema_id", (F.col("k") / F.col("times") / F.col("n")).alias("share"), "posterior")
