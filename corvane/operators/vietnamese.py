"""Provisions of Vietnamese legal texts: statutes, amendments with quoted provisions, appendices, and older outlines.

A line is looked at with its marks of emphasis taken off. A keyword and a number make a heading only if nothing, a full
stop, a colon or a capital follows, so that a reference that a line break has brought to the front stays text. Within a
quotation, curly or straight, nothing is a heading. Appendices close what is open and may hold articles of their own.
Texts without articles are read as outlines: I, A, 1, 1.1 and so on, each level below those that began before it.
"""

from __future__ import annotations

import re

LEVELS = {"appendix": 0, "part": 1, "chapter": 2, "section": 3, "article": 4, "clause": 5, "point": 6}
_NUMBER = {"part": r"(?:thứ\s+\w+|[IVXLC]+|\d+)", "chapter": r"(?:[IVXLC]+|\d+)", "section": r"(?:[IVXLC]+|\d+)", "article": r"\d+[a-zđ]?"}
_WORDS = {"part": "phần", "chapter": "chương", "section": "mục", "article": "điều"}
_HEADINGS = [(kind, re.compile(rf"(?:{word}|{word.capitalize()}|{word.upper()})\s+({_NUMBER[kind]})(?:\s*[.:]\s*|\s+(?=[A-ZÀ-ỸĐ“\"(])|$)(.*)")) for kind, word in _WORDS.items()]
_APPENDIX = re.compile(r"(?:[Pp]hụ\s+[Ll]ục(?:\s+(?:số\s+)?(\d+[a-zđ]?|[IVXLC]+[a-zđ]?))?\s*[.:]?|PHỤ\s+LỤC(?:\s+(?:SỐ\s+)?(\d+[A-ZĐ]?|[IVXLC]+[A-ZĐ]?)\b)?\s*[.:–-]?\s*(.*))")
_CLAUSE = re.compile(r"(\d{1,3})\.\s+(.*)")
_POINT = re.compile(r"([a-zđ]{1,2})[)./]\s+(.*)")
_OUTLINE = (
    (1, "chapter", re.compile(r"([IVXLC]+)\s*[.–-]\s+(.+)")),
    (2, "section", re.compile(r"([A-ZĐ])\s*[.–-]\s+(.+)")),
    (3, "clause", re.compile(r"(\d+(?:\.\d+)*)[.)]\s+(.+)")),
    (9, "point", re.compile(r"([a-zđ])[)./]\s+(.+)")),
)


def bare(line: str) -> str:
    """A line without Markdown's heading marks and emphasis, no-break spaces as spaces, spaces single."""
    line = re.sub(r"^#{1,6}\s+", "", line.replace(" ", " ").replace(" ", " ").strip())
    if not line.startswith("|"):
        line = re.sub(r"\*\*|__|(?<!\w)[*_]|[*_](?!\w)", "", line)
    return re.sub(r"[ \t]+", " ", line).strip()


def quoted_after(line: str, quoted: bool) -> bool:
    """Whether a quotation is open behind a line: curly marks are counted, an odd number of straight ones opens or closes."""
    if line.count('"') % 2:
        quoted = not quoted
    opened, closed = line.count("“"), line.count("”")
    return quoted if opened == closed else opened > closed


class _Tree:
    def __init__(self) -> None:
        self.rows: list[list] = []
        self.stack: list[tuple[int, int]] = []
        self.seen: dict[str, int] = {}
        self.children: dict[int | None, int] = {}

    def has(self, kind: str) -> bool:
        return any(self.rows[k][2] == kind for _, k in self.stack)

    def open(self, level: int, kind: str, label: str, text: str) -> None:
        while self.stack and self.stack[-1][0] >= level:
            self.stack.pop()
        above = self.stack[-1][1] if self.stack else None
        path = (f"{self.rows[above][6]}/" if above is not None else "") + (f"{kind}-{label}" if label else kind)
        n = self.seen[path] = self.seen.get(path, 0) + 1
        ordinal = self.children[above] = self.children.get(above, 0) + 1
        self.rows.append([len(self.rows), above, kind, ordinal, label, text, path if n == 1 else f"{path}~{n}"])
        self.stack.append((level, len(self.rows) - 1))

    def add(self, text: str) -> None:
        if self.stack:
            row = self.rows[self.stack[-1][1]]
            row[5] = f"{row[5]}\n{text}" if row[5] else text


def _heading(line: str, tree: _Tree) -> tuple[str, str, str] | None:
    """Kind, label and text of the heading that a line is; clauses need an open article, points a clause or an article."""
    for kind, pattern in _HEADINGS:
        if m := pattern.fullmatch(line):
            return kind, m[1], m[2].strip()
    if m := _APPENDIX.fullmatch(line):
        return "appendix", m[1] or m[2] or "", (m[3] or "").strip()
    if tree.has("article"):
        if m := _CLAUSE.fullmatch(line):
            return "clause", m[1], m[2]
        if m := _POINT.fullmatch(line):
            return "point", m[1], m[2]
    return None


def _outline(lines: list[str]) -> list[list]:
    """The tree of an outline; a text needs two headings at least to be one."""
    tree = _Tree()
    for line in lines:
        for level, kind, pattern in _OUTLINE:
            if m := pattern.fullmatch(line):
                tree.open(level + m[1].count("."), kind, m[1], m[2])
                break
        else:
            tree.add(line)
    return tree.rows if len(tree.rows) > 1 else []


def parse(text: str) -> list[tuple[int, int | None, str, int, str, str, str]]:
    """(node, parent, kind, ordinal, label, content, path) in reading order. What stands before the first heading is left out; a text that is no outline either is one document node."""
    lines = [x for x in map(bare, text.split("\n")) if x]
    tree, quoted = _Tree(), False
    for line in lines:
        found = None if quoted or line[0] in "“\"" else _heading(line, tree)
        if found:
            tree.open(LEVELS[found[0]], *found)
        else:
            tree.add(line)
        quoted = quoted_after(line, quoted)
    rows = tree.rows
    if not any(r[2] == "article" for r in rows):
        rows = _outline(lines) or rows
    if not rows and lines:
        rows = [[0, None, "document", 1, "", "\n".join(lines), "document"]]
    return [tuple(r) for r in rows]
