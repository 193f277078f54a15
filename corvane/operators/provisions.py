"""Legal provisions: a line-based tree parser, citations, and chunks with a lead-in."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators import indonesian, vietnamese

_ROMAN = r"[IVXLC]+|\d+[A-Z]?"
_THAI = r"[\d๐-๙]+(?:/[\d๐-๙]+)?"
_KHMER = r"[\d០-៩]+"


def _grammar(*rules: tuple[str, int, str]) -> tuple[tuple[str, int, re.Pattern], ...]:
    return tuple((kind, level, re.compile(pattern)) for kind, level, pattern in rules)


#: (kind, level, pattern) of headings by jurisdiction, outermost first; a pattern's groups are label and heading.
GRAMMARS = {
    "common": _grammar(
        ("part", 1, r"^(?:PART|Part|PHẦN|Phần)\s+([IVXLC\d]+|THỨ \w+)\b\.?\s*(.*)$"),
        ("chapter", 2, r"^(?:CHAPTER|Chapter|CHƯƠNG|Chương|BAB)\s+([IVXLC\d]+)\b\.?\s*(.*)$"),
        ("section", 3, r"^(?:SECTION|Section|MỤC|Mục)\s+(\d+)\b\.?\s*(.*)$"),
        ("article", 4, r"^(?:Article|ARTICLE|Điều|Pasal)\s+(\d+[a-zđ]?)\b\.?\s*(.*)$"),
        ("clause", 5, r"^(\d{1,3})\.\s+(.*)$"),
        ("point", 6, r"^([a-zđ])\)\s+(.*)$"),
    ),
    "vn": _grammar(
        ("appendix", 1, r"^(?:PHỤ LỤC|Phụ lục)\s*([IVXLC\d]*)\b\.?\s*(.*)$"),
        ("part", 1, r"^(?:PHẦN|Phần)\s+([IVXLC\d]+|(?i:thứ \w+))\b\.?\s*(.*)$"),
        ("chapter", 2, r"^(?:CHƯƠNG|Chương)\s+([IVXLC\d]+)\b\.?\s*(.*)$"),
        ("section", 3, r"^(?:MỤC|Mục)\s+([IVXLC\d]+)\b\.?\s*(.*)$"),
        ("article", 4, r"^(?:ĐIỀU|Điều)\s+(\d+[a-zđ]?)\b[.:]?\s*(.*)$"),
        ("clause", 5, r"^(\d{1,3})\.\s+(.*)$"),
        ("point", 6, r"^([a-zđ]{1,2})\)\s+(.*)$"),
    ),
    "my": _grammar(
        ("schedule", 1, r"^(?:THE )?((?:FIRST|SECOND|THIRD|FOURTH|FIFTH|SIXTH|SEVENTH|EIGHTH|NINTH|TENTH)? ?)SCHEDULE\b\s*(.*)$"),
        ("part", 1, rf"^(?:PART|Part)\s+({_ROMAN})\b\s*(.*)$"),
        ("chapter", 2, rf"^(?:CHAPTER|Chapter)\s+({_ROMAN})\b\s*(.*)$"),
        ("division", 3, rf"^(?:DIVISION|Division)\s+({_ROMAN})\b\s*(.*)$"),
        ("section", 4, r"^(\d{1,4}[A-Z]{0,2})\.\s+(.*)$"),
        ("subsection", 5, r"^\((\d{1,3}[A-Z]?)\)\s+(.*)$"),
        ("paragraph", 6, r"^\(([a-z]{1,2})\)\s+(.*)$"),
    ),
    "id": _grammar(
        ("appendix", 1, r"^LAMPIRAN\s*([IVXLC\d]*)\b\s*(.*)$"),
        ("chapter", 2, r"^B[AE]B\s+([IVXLC1l]+)\b\s*(.*)$"),
        ("part", 3, r"^(?i:bagian)\s+(?i:ke)([a-z]+)\b\s*(.*)$"),
        ("article", 4, r"^P[ao]sa[l1I]\s+(\d+[A-Z]?)\b\s*(.*)$"),
        ("clause", 5, r"^\((\d{1,3}[a-z]?)\)\s+(.*)$"),
        ("point", 6, r"^([a-z])\.\s+(.*)$"),
    ),
    "sg": _grammar(
        ("schedule", 1, r"^((?:FIRST|SECOND|THIRD|FOURTH|FIFTH|SIXTH|SEVENTH|EIGHTH|NINTH|TENTH)? ?)SCHEDULE\b\s*(.*)$"),
        ("part", 1, rf"^PART\s+({_ROMAN})\b\s*(.*)$"),
        ("division", 3, rf"^Division\s+({_ROMAN})\b\s*[—–-]?\s*(.*)$"),
        ("section", 4, r"^(\d{1,4}[A-Z]{0,2})\.\s*[—–-]?\s*(.*)$"),
        ("subsection", 5, r"^\((\d{1,3}[A-Z]?)\)\s+(.*)$"),
        ("paragraph", 6, r"^\(([a-z]{1,2})\)\s+(.*)$"),
    ),
    "th": _grammar(
        ("part", 1, rf"^ภาค(?:ที่)?\s*({_THAI})\s*(.*)$"),
        ("chapter", 2, rf"^หมวด(?:ที่)?\s*({_THAI})\s*(.*)$"),
        ("division", 3, rf"^ส่วน(?:ที่)?\s*({_THAI})\s*(.*)$"),
        ("section", 4, rf"^(?:มาตรา|ข้อ)\s*({_THAI})\s*(.*)$"),
        ("paragraph", 5, rf"^\(({_THAI})\)\s*(.*)$"),
        ("item", 6, r"^\(([ก-ฮ])\)\s*(.*)$"),
    ),
    "kh": _grammar(
        ("chapter", 2, rf"^(?:CHAPTER|Chapter|ជំពូក(?:ទី)?)\s*([IVXLC]+|{_KHMER})\s*[.:៖]?\s*(.*)$"),
        ("section", 3, rf"^(?:SECTION|Section|ផ្នែក(?:ទី)?)\s*([IVXLC]+|{_KHMER})\s*[.:៖]?\s*(.*)$"),
        ("article", 4, rf"^(?:ARTICLE|Article|មាត្រា|ប្រការ)\s*({_KHMER})\s*[.:៖-]*\s*(.*)$"),
        ("clause", 5, rf"^({_KHMER})[.-]\s*(.*)$"),
        ("point", 6, r"^([a-zក-អ])[.)]\s+(.*)$"),
    ),
}
_ROWS = "doc_id bigint, node int, parent int, kind string, ordinal int, label string, content string, path string"


#: Layouts that need more than a grammar of headings: regulations from scanned pages, amendments, outlines.
PARSERS = {"id-scan": indonesian.parse, "vn-text": vietnamese.parse}


def label(found: str) -> str:
    """A heading's label with digits of any script as 0-9."""
    return "".join(str(unicodedata.digit(c)) if c.isdigit() and unicodedata.digit(c, -1) >= 0 else c for c in found.strip())


def _opens(lines: list[str], at: int) -> bool:
    """Whether a quotation begins in a line and ends in a later one, before another begins; one that nobody closes is none."""
    if "“" not in lines[at]:
        return False
    for line in lines[at + 1 :]:
        if "”" in line:
            return "“" not in line or line.index("”") < line.index("“")
        if "“" in line:
            return False
    return False


def parse(text: str, grammar: str = "common") -> list[tuple[int, int | None, str, int, str, str, str]]:
    """(node, parent, kind, ordinal, label, content, path) in reading order. Text without headings is one whole-document node; a path that repeats gets ~2, ~3 and so on. A name in PARSERS or GRAMMARS; an unknown one counts as the common grammar."""
    if grammar in PARSERS:
        return PARSERS[grammar](text)
    headings = GRAMMARS.get(grammar, GRAMMARS["common"])
    rows: list[list] = []
    stack: list[tuple[int, int]] = []
    seen: dict[str, int] = {}
    children: dict[int | None, int] = {}
    quoted = False
    lines = [x for raw in text.split("\n") if (x := raw.strip())]
    for at, line in enumerate(lines):
        found = None
        if not quoted:
            for kind, level, pattern in headings:
                if (m := pattern.match(line)) and (level < 5 or stack):
                    found = kind, level, m
                    break
        quoted = (quoted or _opens(lines, at)) and "”" not in line
        if found:
            kind, level, m = found
            while stack and stack[-1][0] >= level:
                stack.pop()
            parent = stack[-1][1] if stack else None
            path = (f"{rows[parent][6]}/" if parent is not None else "") + f"{kind}-{label(m[1])}"
            seen[path] = seen.get(path, 0) + 1
            if seen[path] > 1:
                path += f"~{seen[path]}"
            children[parent] = children.get(parent, 0) + 1
            rows.append([len(rows), parent, kind, children[parent], label(m[1]), m[2], path])
            stack.append((level, len(rows) - 1))
        elif stack:
            row = rows[stack[-1][1]]
            row[5] = f"{row[5]}\n{line}" if row[5] else line
        elif rows and rows[0][2] == "document":
            rows[0][5] += f"\n{line}"
        else:
            children[None] = children.get(None, 0) + 1
            rows.append([len(rows), None, "document", children[None], "", line, "document"])
    return [tuple(r) for r in rows]


def _emitted(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in _ROWS.split(", ")])


def provisions(docs: DataFrame, grammar: str | Column = "common") -> DataFrame:
    """The provision tree of each row of docs (doc_id, text), as rows; adjacency by node and parent. `grammar` is a name in GRAMMARS or a column of names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *r) for i, t, g in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in parse(t or "", g)]
            if rows:
                yield _emitted(rows)

    g = F.lit(grammar) if isinstance(grammar, str) else grammar
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), g.alias("grammar")).mapInArrow(run, _ROWS)


def tree_rows(tree: str | None) -> list[tuple[int, int | None, str, int, str, str, str]]:
    """A provision tree as JSON, nodes of (kind, label, content, children), in the rows of parse(). What is no tree gives none."""
    try:
        top = json.loads(tree or "null")
    except ValueError:
        return []
    rows: list[tuple] = []
    seen: dict[str, int] = {}
    stack: list[tuple] = [(n, None, k, "") for k, n in reversed(list(enumerate(top if isinstance(top, list) else [top], 1)))]
    while stack:
        node, parent, ordinal, above = stack.pop()
        if not isinstance(node, dict):
            continue
        kind, name = str(node.get("kind") or "section"), label(str(node.get("label") or ordinal))
        path = f"{above}{kind}-{name}"
        seen[path] = seen.get(path, 0) + 1
        if seen[path] > 1:
            path += f"~{seen[path]}"
        rows.append((len(rows), parent, kind, ordinal, name, str(node.get("content") or ""), path))
        below = node.get("children")
        here = len(rows) - 1
        stack += [(n, here, k, f"{path}/") for k, n in reversed(list(enumerate(below if isinstance(below, list) else [], 1)))]
    return rows


def tree_provisions(trees: DataFrame) -> DataFrame:
    """provisions() of first-party trees (doc_id, tree as JSON)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if rows := [(i, *r) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in tree_rows(t)]:
                yield _emitted(rows)

    return trees.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("tree").cast("string").alias("tree")).mapInArrow(run, _ROWS)


def split_words(text: str, most: int) -> list[str]:
    """Parts of at most `most` estimated tokens (two characters each), cut at sentence ends, then at words."""
    out, held = [], ""
    for piece in re.split(r"(?<=[.!?;])\s+|\n+", text):
        for part in [piece] if len(piece) <= 2 * most else _by_words(piece, 2 * most):
            if held and len(held) + 1 + len(part) > 2 * most:
                out.append(held)
                held = part
            else:
                held = f"{held} {part}" if held else part
    return [*out, held] if held else out


def _by_words(piece: str, most: int) -> Iterator[str]:
    held = ""
    for w in piece.split():
        for k in range(0, len(w), most):
            x = w[k : k + most]
            if held and len(held) + 1 + len(x) > most:
                yield held
                held = x
            else:
                held = f"{held} {x}" if held else x
    if held:
        yield held


def chunks(docs: DataFrame, most: int = 512, least: int = 20) -> DataFrame:
    """(doc_id, ordinal, citation, content): parts of every text within `most` tokens; equal contents of a document once, then those of under `least` characters left out; ordinals count what is kept."""
    rows = "doc_id bigint, ordinal bigint, citation string, content string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, seen = 0, set()
                for _, _, kind, _, name, content, path in parse(t or ""):
                    for part in split_words(content, most):
                        if part not in seen:
                            seen.add(part)
                            if len(part) >= least:
                                out.append((i, n, path if kind == "document" else f"{kind} {name}", part))
                                n += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True)], ["doc_id", "ordinal", "citation", "content"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, rows)
