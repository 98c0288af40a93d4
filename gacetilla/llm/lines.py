"""Lines of a page as tokens by which pages are aligned, and the article's own lines once the site's are known.

No list of phrases is kept: a line is described by its own words and signs, in five ways, and what belongs to a site is
learned by comparing its pages (``boilerplate``).

- literal: the folded line without ornaments, figures taken as the same (long prose: the line but for case and ornaments);
- head: what stands before the line's first ``: | » > /`` ("etiquetas:", "inicio >"), or a mark of two signs before the line;
- shape: the line with its names (runs of capitalised words) left open ("por NAME", "NAME, NAME, calle NAME, NAME"), and of
  a short line with figures or several separators also with all longer words open ("WORD 0 de WORD de 0");
- tail: the words that open its last part after a comma ("saludos desde");
- after: a line of some length that is no sentence and follows a certain line, alone or in a list (a teaser below
  "mas leidas"); it carries that line's literal.

Prose (sentences) has its literal only.
"""

from __future__ import annotations

import re

from gacetilla.llm.text import fold, stable_hash

#: Ways to describe a line, in the low three bits of a token.
LITERAL, HEAD, SHAPE, TAIL, AFTER = range(5)
#: Sorts of lines: prose, other lines between the first and the last prose of a page, other lines.
PROSE, WITHIN, OUTSIDE = range(3)

LEAST_PROSE, LEAST_LISTED, LEAST_EXACT, MOST_OPEN = 60, 45, 120, 300

_NUMBERED = re.compile(r"^\d{1,2}[.)°-]+\s+")
_SENTENCES = re.compile(r"[.!?][\"”»]? +[\"“«¿¡]*[A-ZÁÉÍÓÚÜÑ]")
_NAME = re.compile(r"[A-ZÁÉÍÓÚÜÑ][\w'’-]*(?:\s+[A-ZÁÉÍÓÚÜÑ][\w'’-]*)*")
_FIRST = re.compile(r"\w+")
_HEAD = re.compile(r"^([^:|»>/]{2,45}?)\s*[:|»>/](?=\s*\S)")
_MARK = re.compile(r"^\W*?(?<!\S)([^\w\s\"“«¿¡(\[]{2,3})(?=\s)")
_LONG_WORDS = re.compile(r"(?:\b[^\W\d]{4,}\b ?)+")
_SEPARATORS = re.compile(r"[,|#·]")
_WORDS = re.compile(r"[a-z]{2}")
_DIGITS = re.compile(r"\d+")
_DELIMITERS = re.compile(r"[:|»>/]")
_BREAK = re.compile(r"(?:\.\.\.|…|\(\+\)|\[\+\]|\(contin[uú]a?[^)]*\)|\(sigue\)|\(\.\.\.\)|\[\.\.\.\]|\(…\)|\[…\])$")


def token(kind: int, text: str) -> int:
    """Signed 64 bits of a description."""
    h = stable_hash(text) & ~7 | kind
    return h - (1 << 64) if h >= 1 << 63 else h


def _trimmed(s: str, left: str = "", right: str = "") -> str:
    """Without signs at both ends but for those given."""
    a, b = 0, len(s)
    while a < b and not (s[a].isalnum() or s[a] in left):
        a += 1
    while a < b and not (s[b - 1].isalnum() or s[b - 1] in right):
        b -= 1
    return s[a:b]


def _core(line: str) -> str:
    """Without ornaments at both ends and without a number before it."""
    bare = line.rstrip("»…*!·|-–—")
    if bare != line and bare.endswith(" "):
        line = bare
    s = _trimmed(line, '("“«¿¡', ')"”».?…')
    return _NUMBERED.sub("", s) if s[:1].isdigit() else s


def _figures(folded: str) -> str:
    return _DIGITS.sub("0", folded)


def _open(folded: str, spans: list[tuple[int, int]]) -> str:
    parts, at = [], 0
    for a, b in spans:
        parts += [folded[at:a], "§"]
        at = b
    return _figures("".join([*parts, folded[at:]]))


def _shapes(core: str, folded: str, shouted: bool) -> list[str]:
    """The line with its names open; once with its first word kept and once as part of a name."""
    if shouted:
        return [_figures(_LONG_WORDS.sub("§ ", folded)).strip()]
    spans = [m.span() for m in _NAME.finditer(core)]
    if not spans or spans[0][0] > 0:
        return [_open(folded, spans)]
    first = _FIRST.match(core).end()
    inner = _NAME.search(core, first, spans[0][1]) if first < spans[0][1] else None
    return [_open(folded, [(inner.start(), spans[0][1]), *spans[1:]] if inner else spans[1:]), _open(folded, spans)]


def describe(line: str) -> tuple[int, tuple[int, ...], bool, bool, bool]:
    """(literal, other tokens, whether it is prose, whether it may stand in a list of headlines, whether it has a literal) of
    one line with white space collapsed."""
    core = _core(line)
    n = len(core)
    several = bool(_SENTENCES.search(core))
    sentence = several or core.endswith((".", "?", "…", '"', "”", "»"))
    if n > MOST_OPEN or several and n > LEAST_EXACT:  # long lines and prose are compared as they are but for case and ornaments
        literal = _trimmed(core).lower()
        return token(LITERAL, literal), (), sentence, not sentence, bool(literal)
    folded = fold(core)
    literal = _trimmed(_DIGITS.sub("0", folded))
    out: set[int] = set()
    if literal and not several:
        if len(folded) != n:  # a letter that folds to several: names are sought in the folded line's own case
            core = folded
        shouted = core == core.upper() and core != folded
        headed = _DELIMITERS.search(core, 0, 60)
        shapes = _shapes(core, folded, shouted) if headed or not sentence else []
        for s in ([_figures(folded)] if shouted else shapes) if headed else ():
            m = _HEAD.match(s)
            if m and _WORDS.search(m[1]) and m[1].count(" ") < 5:
                out.add(token(HEAD, m[0].replace(" ", "")))
        if m := _MARK.match(line):
            out.add(token(HEAD, m[1]))
        if not sentence:
            if n < LEAST_PROSE and core.count(" ") < 9 and (_DIGITS.search(core) or len(_SEPARATORS.findall(core)) >= 3):
                out.add(token(SHAPE, "§" + _LONG_WORDS.sub("§", _figures(folded))))
            for s in shapes:
                if "§" in s and (_WORDS.search(s) or "(" in s) or "0" in s and _WORDS.search(s):
                    out.add(token(SHAPE, s))
            if "," in core:
                last = core.rsplit(",", 1)[1].split()
                opening = last[:2] if shouted else last[: next((i for i, w in enumerate(last) if w[0].isupper()), len(last))]
                if 0 < len(opening) <= 3:
                    out.add(token(TAIL, _figures(fold(" ".join(opening)))))
    return token(LITERAL, literal), tuple(sorted(out)), sentence and n >= LEAST_PROSE, not sentence and n >= LEAST_LISTED, bool(literal)


class Describer:
    """``describe`` with a bounded memory: a site's lines come again and again."""

    def __init__(self, most: int = 100_000):
        self.most, self.held = most, {}

    def __call__(self, line: str) -> tuple[int, tuple[int, ...], bool, bool, bool]:
        if len(line) > MOST_OPEN:
            return describe(line)
        d = self.held.get(line)
        if d is None:
            if len(self.held) >= self.most:
                self.held.clear()
            d = self.held[line] = describe(line)
        return d


def page_tokens(text: str | None, describer=describe) -> list[tuple[int, tuple[int, ...], int]]:
    """(line number from 1, tokens with the literal first, sort) of every non-blank line; lines of signs only have no token."""
    rows: list[tuple[int, tuple[int, ...], int]] = []
    if not text:
        return rows
    anchor = None
    for no, raw in enumerate(text.split("\n"), 1):
        s = " ".join(raw.split())
        if not s:
            continue
        literal, others, prose, listed, some = describer(s)
        if not some:
            rows.append((no, (), OUTSIDE))
            continue
        if listed:
            if anchor is not None:
                others = (*others, anchor & ~7 | AFTER)
        else:
            anchor = None if prose else literal
        rows.append((no, (literal, *others), PROSE if prose else OUTSIDE))
    told = [i for i, r in enumerate(rows) if r[2] == PROSE]
    if told:
        for i in range(told[0] + 1, told[-1]):
            if rows[i][2] != PROSE:
                rows[i] = (rows[i][0], rows[i][1], WITHIN)
    return rows


def main_lines(text: str | None, gone) -> list[tuple[int, str]]:
    """The article's own lines (number, line with white space collapsed): the non-blank ones whose number is not in ``gone``."""
    if not text:
        return []
    away = frozenset(gone or ())
    return [(no, s) for no, raw in enumerate(text.split("\n"), 1) if no not in away and (s := " ".join(raw.split()))]


def kept_text(text: str | None, gone) -> str:
    """The text without the lines whose number is in ``gone``."""
    if not text or not gone:
        return text or ""
    away = frozenset(gone)
    return "\n".join(raw for no, raw in enumerate(text.split("\n"), 1) if no not in away)


def is_whole(own: list[tuple[int, str]]) -> bool:
    """Whether the main text (the page's own lines) is there and is not broken off before its end.

    A page may end with a subhead or an item of a list; a sentence must be finished."""
    if not any(len(s) >= LEAST_PROSE or s.endswith((".", "!", "?")) for _, s in own):
        return False
    last = own[-1][1]
    return len(last) < LEAST_PROSE and not last.endswith("…") and not _BREAK.search(last) or not _BREAK.search(last) and last.endswith((".", "!", "?", '"', "”", "»", ")"))
