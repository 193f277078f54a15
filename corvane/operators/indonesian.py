"""Provisions of Indonesian regulations from scanned pages.

Scans confuse letters with digits, merge headings with their text, split numbers by blanks and repeat a letterhead on each
page. Lines are read in three steps: page furniture is dropped, by its likeness to what a letterhead says; lines that may
be headings get all readings of their numbers; then the headings of articles are the longest chain of readings 1, 2, 3 and
so on in their order, found from the last line backwards, so that a line that only refers to an article, or a quoted
article of another law, is text unless the chain needs it. The tree is built from what was settled.
"""

from __future__ import annotations

import difflib
import functools
import itertools
import re
from dataclasses import dataclass, field

# What letterheads say, ordinal words of parts, and digits that scans take for letters, likelier ones first.
LETTERHEADS = ("PRESIDEN", "REPUBLIK INDONESIA", "PRESIDEN REPUBLIK INDONESIA")
ORDINALS = ("kesatu", "kedua", "ketiga", "keempat", "kelima", "keenam", "ketujuh", "kedelapan", "kesembilan", "kesepuluh", "kesebelas")
CONFUSED = {"O": "0", "o": "0", "I": "1", "l": "1", "T": "71"}
#: How like a letterhead a line must be, and its length at most; readings of a number at most.
LIKENESS, LONGEST, READINGS = 0.72, 34, 16
LEVELS = {"appendix": 0, "notes": 0, "chapter": 0, "part": 1, "division": 2, "article": 3, "clause": 4, "point": 5}

_ROMAN = re.compile(r"[IVXLCDM]+")
_CHAPTER = re.compile(r"BAB\s*([IVXLCDM]+)[\s.]*", re.IGNORECASE)
_PART = re.compile(r"bagian\s+(\S+)\s*(.*)", re.IGNORECASE)
_DIVISION = re.compile(r"paragraf\s+(\d+)\s*(.*)", re.IGNORECASE)
_ARTICLE = re.compile(r"Pasa[l17]\s*([0-9OoIlT]+(?: \d+)*|[IVXLCDM]{2,})[\s.]*((?:\(|[A-Z]).*)?")
_CLAUSE = re.compile(r"\(([0-9OoIlT]+)\)\s*(.*)")
_POINT = re.compile(r"([a-z])\.\s*(.*)")
_NOTES = re.compile(r"PENJ[E\[]LA?\s?SA?\s?N(?:\s+ATAS\b.*)?|.*PASAL\s*DEMI\s*PASAL.*")
_APPENDIX = re.compile(r"LAMPIRAN\b.*")
_AMENDS = re.compile(r".*\b(?:diubah|disisipkan|ditambahkan)\b.*\b(?:berbunyi|berikut)\s*:?", re.IGNORECASE)
_FURNITURE = re.compile(r"-\s*\d+.{0,3}|\d+|SK\s*No\.?\s*\d+\s*A?", re.IGNORECASE)


def roman(numeral: str) -> int:
    """The value of a Roman numeral."""
    values = [{"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}[c] for c in numeral.upper()]
    return sum(-a if a < b else a for a, b in zip(values, [*values[1:], 0], strict=True))


def readings(number: str) -> list[int]:
    """What a scanned number may be, the likeliest first: Roman if it has such letters only, else letters as digits, with and without what stands behind a blank."""
    if len(number) > 1 and _ROMAN.fullmatch(number):
        return [roman(number)]
    out: list[int] = []
    for text in dict.fromkeys((number.replace(" ", ""), number.split(" ")[0])):
        for digits in itertools.islice(itertools.product(*(CONFUSED.get(c, c) for c in text)), READINGS):
            out.append(int("".join(digits)))
    return list(dict.fromkeys(out))


@functools.cache
def _matchers() -> list[difflib.SequenceMatcher]:
    """A matcher for each letterhead, which has its letters' places already."""
    return [difflib.SequenceMatcher(None, "", head, autojunk=False) for head in LETTERHEADS]


def _like_a_letterhead(line: str) -> bool:
    """Whether a line in capitals is as like a letterhead as is asked; bounds of the likeness that cost less are tried first."""
    for m in _matchers():
        m.set_seq1(line)
        if m.real_quick_ratio() >= LIKENESS and m.quick_ratio() >= LIKENESS and m.ratio() >= LIKENESS:
            return True
    return False


def is_furniture(line: str) -> bool:
    """Whether a line is a page number, a watermark or a letterhead, however misread."""
    if _FURNITURE.fullmatch(line):
        return True
    if len(line) > LONGEST or len(line.split()) > 4:
        return False
    letters = "".join(c for c in line if c.isalpha())
    if sum(map(str.isupper, letters)) < 0.6 * len(letters) or len(letters) < 6:
        return False
    return _like_a_letterhead(line.upper().strip(" .,"))


def body(text: str) -> list[str]:
    """Lines without furniture and marks before them."""
    lines = (re.sub(r"^[^\w(]+", "", raw.replace(" ", " ").replace(" ", " ").strip()) or raw.strip() for raw in text.split("\n"))
    return [x for raw, x in zip(text.split("\n"), lines, strict=True) if x and not is_furniture(raw.strip()) and (x == raw.strip() or not is_furniture(x))]


@dataclass
class _Heading:
    line: int
    options: list[int]
    rest: str
    quality: int


def article_chain(lines: list[str], end: int) -> dict[int, tuple[int, str]]:
    """The article headings among the first `end` lines: line to (number, text behind it).

    Of the chains 1, 2, 3 ... the longest is taken; of equally long ones that with more headings that stand alone and
    fewer within amendments, then the earliest.
    """
    found: list[_Heading] = []
    amending = False
    for k, line in enumerate(lines[:end]):
        m = _ARTICLE.fullmatch(line)
        quoted = k > 0 and _AMENDS.fullmatch(lines[k - 1]) is not None
        if _CHAPTER.fullmatch(line):
            amending = False
        if m and not quoted:
            rest = (m[2] or "").strip()
            found.append(_Heading(k, readings(m[1]), rest, 2 * (not rest) - amending))
        if _AMENDS.fullmatch(line):
            amending = True
    # number -> (length, quality, heading, next): the best chain from it, over the headings seen from the end
    best: dict[int, tuple[int, int, _Heading, tuple | None]] = {}
    for h in reversed(found):
        fresh = {}
        for n, v in enumerate(h.options):
            after = best.get(v + 1)
            chain = (1 + (after[0] if after else 0), h.quality - n + (after[1] if after else 0), h, after)
            if v not in best or chain[:2] >= best[v][:2]:
                fresh[v] = chain
        best |= fresh
    out: dict[int, tuple[int, str]] = {}
    at, number = best.get(1), 1
    while at:
        out[at[2].line] = number, at[2].rest
        at, number = at[3], number + 1
    return out


@dataclass
class _Tree:
    rows: list[list] = field(default_factory=list)
    stack: list[tuple[int, int]] = field(default_factory=list)
    counts: dict[tuple, int] = field(default_factory=dict)
    last: dict[tuple, int] = field(default_factory=dict)

    def top(self) -> list | None:
        return self.rows[self.stack[-1][1]] if self.stack else None

    def inside(self, kind: str) -> bool:
        return any(self.rows[k][2] == kind for _, k in self.stack)

    def parent(self, level: int) -> int | None:
        return next((k for at, k in reversed(self.stack) if at < level), None)

    def open(self, kind: str, label: str, text: str = "") -> None:
        level = LEVELS[kind]
        while self.stack and self.stack[-1][0] >= level:
            self.stack.pop()
        parent = self.stack[-1][1] if self.stack else None
        path = (f"{self.rows[parent][6]}/" if parent is not None else "") + (f"{kind}-{label.lower()}" if label else kind)
        n = self.counts[path] = self.counts.get(path, 0) + 1
        ordinal = self.counts[parent, None] = self.counts.get((parent, None), 0) + 1
        self.rows.append([len(self.rows), parent, kind, ordinal, label, text, path if n == 1 else f"{path}~{n}"])
        self.stack.append((level, len(self.rows) - 1))

    def add(self, text: str, between: str = "\n") -> None:
        if row := self.top():
            row[5] = f"{row[5]}{between}{text}" if row[5] else text


def _continues(line: str) -> bool:
    """Whether a line may go on a heading: short and mostly capitals."""
    letters = [c for c in line if c.isascii() and c.isalpha()]
    return len(line) <= 60 and bool(letters) and sum(map(str.isupper, letters)) >= 0.6 * len(letters)


def parse(text: str) -> list[tuple[int, int | None, str, int, str, str, str]]:
    """(node, parent, kind, ordinal, label, content, path) in reading order; what stands before the first chapter or article is left out.

    Explanatory notes and annexes are one node each. A text without headings is one document node, an empty one has no rows.
    """
    lines = body(text)
    end = next((k for k, x in enumerate(lines) if _NOTES.fullmatch(x) or _APPENDIX.fullmatch(x)), len(lines))
    articles = article_chain(lines, end)
    chapters = [k for k in range(end) if _CHAPTER.fullmatch(lines[k])]
    first = min([*chapters[:1], *list(articles)[:1]], default=None)
    if first is None:
        whole = "\n".join(lines)
        return [(0, None, "document", 1, "", whole, "document")] if whole else []
    tree, titled, amended = _Tree(), False, False
    for k in range(first, end):
        line = lines[k]
        before = k > first and _AMENDS.fullmatch(lines[k - 1]) is not None
        part, division = _PART.fullmatch(line), _DIVISION.fullmatch(line)
        if m := _CHAPTER.fullmatch(line):
            tree.open("chapter", m[1].upper())
            titled, amended = True, False
        elif part and part[1].lower().startswith("ke") and not before:
            tree.open("part", str(ORDINALS.index(part[1].lower()) + 1) if part[1].lower() in ORDINALS else part[1], part[2])
            titled, amended = not part[2], False
        elif division and not before and not amended:
            tree.open("division", division[1], division[2])
            titled = not division[2]
        elif k in articles:
            number, rest = articles[k]
            tree.open("article", str(number))
            titled = amended = False
            if rest:
                _provision(tree, rest)
        elif not titled and _provision(tree, line, strict=True):
            pass
        elif titled and tree.top():
            tree.add(line, " ")
            titled = _continues(line)
        else:
            tree.add(line)
        amended = amended or _AMENDS.fullmatch(line) is not None
    for k in range(end, len(lines)):
        line = lines[k]
        if _NOTES.fullmatch(line):
            if not tree.inside("notes"):
                tree.open("notes", "")
        elif _APPENDIX.fullmatch(line):
            tree.open("appendix", line.partition(" ")[2].strip())
        else:
            tree.add(line)
    return [tuple(r) for r in tree.rows]


def _provision(tree: _Tree, line: str, strict: bool = False) -> bool:
    """Opens the clause or point that a line begins, within an article; other lines are text, unless `strict`."""
    if tree.inside("article"):
        if m := _CLAUSE.fullmatch(line):
            options, parent = readings(m[1]), tree.parent(LEVELS["clause"])
            wanted = tree.last.get((parent, "clause"), 0) + 1
            number = wanted if wanted in options else options[0]
            tree.last[parent, "clause"] = number
            tree.open("clause", str(number), m[2])
            return True
        if m := _POINT.fullmatch(line):
            tree.open("point", m[1], m[2])
            return True
    if not strict:
        tree.add(line)
    return False
