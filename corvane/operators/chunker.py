"""Chunks of provisions: a document's tree is cut from the top into the largest parts that keep within a budget of tokens.

Lengths of subtrees are added up from the leaves first, so that no text is joined before it is known to be a chunk. An
article that fits is one chunk; a longer one gives a chunk for each clause, each headed by what the article says before
its clauses, and so on for points; a leaf that is still too long is cut at lines, then at words. Appendices give their own
text, and a document without articles its clauses, leaves or roots. Citations name the places, and containers where
numbers begin again.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.provisions import parse

#: Estimated tokens of a chunk at most (two characters each), characters of one at least, characters of a prefix's field.
MOST, LEAST, FIELD = 512, 20, 220


@dataclass(frozen=True)
class Style:
    """How a jurisdiction names its provisions: for each kind the citation and the beginning of its text; roles of kinds."""

    names: dict[str, tuple[str, str]]
    article: str
    below: dict[str, tuple[str, ...]]
    top: tuple[str, ...] = ("part", "chapter")
    sub: tuple[str, ...] = ("section", "division")
    appendix: tuple[str, ...] = ("appendix", "schedule")
    passage: str = "Paragraph"
    again: str = " [{}]"
    effective: str = "Effective"


def _named(words: dict[str, str], marks: dict[str, tuple[str, str]]) -> dict[str, tuple[str, str]]:
    return {kind: (f"{word} {{}}", f"{word} {{}}. ") for kind, word in words.items()} | marks


_BRACKETS = {"subsection": ("({})", "({}) "), "paragraph": ("({})", "({}) "), "item": ("({})", "({}) ")}
_ACT = _named({"schedule": "Schedule", "part": "Part", "chapter": "Chapter", "division": "Division", "section": "Section"}, _BRACKETS)
#: The words of each jurisdiction.
STYLES = {
    "common": Style(_named({"part": "Part", "chapter": "Chapter", "section": "Section", "article": "Article"}, {"clause": ("Clause {}", "{}. "), "point": ("Point {}", "{}) ")}), "article", {"article": ("clause",), "clause": ("point",)}),
    "vn": Style(_named({"appendix": "Phụ lục", "part": "Phần", "chapter": "Chương", "section": "Mục", "article": "Điều"}, {"clause": ("Khoản {}", "{}. "), "point": ("Điểm {}", "{}) ")}), "article", {"article": ("clause",), "clause": ("point",)}, passage="Đoạn", again=", Đoạn {}", effective="Hiệu lực"),
    "my": Style(_ACT, "section", {"section": ("subsection", "paragraph"), "subsection": ("paragraph",)}, sub=("division",)),
    "sg": Style(_ACT, "section", {"section": ("subsection", "paragraph"), "subsection": ("paragraph",)}, sub=("division",)),
    "id": Style(_named({"appendix": "LAMPIRAN", "chapter": "BAB", "part": "Bagian Ke", "article": "Pasal"}, {"clause": ("ayat ({})", "({}) "), "point": ("huruf {}", "{}. ")}), "article", {"article": ("clause", "point"), "clause": ("point",)}, top=("chapter",), sub=("part",), passage="Paragraf", effective="Berlaku"),
    "th": Style(_named({"part": "ภาค", "chapter": "หมวด", "division": "ส่วนที่", "section": "มาตรา"}, _BRACKETS), "section", {"section": ("paragraph",)}, sub=("division",), passage="วรรค", effective="มีผล"),
    "kh": Style(_named({"chapter": "Chapter", "section": "Section", "article": "Article"}, {"clause": ("Clause {}", "{}. "), "point": ("Point {}", "{}. ")}), "article", {"article": ("clause",), "clause": ("point",)}),
}
STYLES |= {"id-scan": STYLES["id"], "vn-text": STYLES["vn"]}


def tokens(text: str) -> int:
    """A rough count: two characters a token."""
    return max(1, len(text) // 2) if text else 0


def normal(text: str) -> str:
    """A label to compare: lower case, single blanks, no marks around it."""
    return " ".join(text.lower().split()).strip(" .:;,)(")


def words_within(line: str, most: int) -> Iterator[str]:
    """A line's words in parts of `most` tokens at most; a longer word is a part of its own."""
    held: list[str] = []
    length = 0
    for w in line.split():
        if held and (length + 1 + len(w)) // 2 > most:
            yield " ".join(held)
            held, length = [], 0
        length += len(w) + bool(held)
        held.append(w)
    if held:
        yield " ".join(held)


def passages(text: str, most: int) -> list[str]:
    """A text in parts of `most` tokens at most: whole lines as long as they fit together, long lines by words."""
    if tokens(text) <= most:
        return [text] if text else []
    out: list[str] = []
    held: list[str] = []
    length = 0

    def close() -> None:
        nonlocal length
        if held:
            out.append("\n".join(held))
            held.clear()
        length = 0

    for line in filter(None, map(str.strip, text.split("\n"))):
        if tokens(line) > most:
            close()
            out.extend(words_within(line, most))
            continue
        if held and (length + 1 + len(line)) // 2 > most:
            close()
        length += len(line) + bool(held)
        held.append(line)
    close()
    return out


@dataclass
class _Node:
    kind: str
    label: str
    content: str
    path: str
    ordinal: int
    parent: int | None
    children: list[int] = field(default_factory=list)
    length: int = 0


@dataclass(frozen=True)
class About:
    """What a chunk's prefix tells of its document."""

    number: str = ""
    title: str = ""
    effective: str = ""


class Chunker:
    """The chunks of one document, from its rows (node, parent, kind, ordinal, label, content, path) in reading order."""

    def __init__(self, rows: list[tuple], style: Style, about: About, most: int = MOST, least: int = LEAST):
        self.style, self.about, self.most, self.least = style, about, most, least
        place = {r[0]: k for k, r in enumerate(rows)}
        self.nodes = [_Node(kind, label or path.rsplit("/", 1)[-1], (content or "").strip(), path or "", ordinal, place.get(parent)) for _, parent, kind, ordinal, label, content, path in rows]
        for k, n in enumerate(self.nodes):
            n.length = len(self.own(n))
            if n.parent is not None:
                self.nodes[n.parent].children.append(k)
        for n in reversed(self.nodes):
            if n.parent is not None and n.length:
                above = self.nodes[n.parent]
                above.length += n.length + bool(above.length)
        self.repeats = Counter(self.part(n) for n in self.nodes if n.kind == style.article or n.kind in style.appendix)
        self.seen: set[str] = set()
        self.out: list[tuple] = []

    def own(self, n: _Node) -> str:
        """A node's own text behind its label."""
        if n.kind == "document" or n.kind not in self.style.names:
            return n.content
        return (self.style.names[n.kind][1].format(n.label) + n.content).strip()

    def part(self, n: _Node) -> str:
        """What a citation says of a node; nodes that share a path are told apart by its number."""
        if n.kind == "document":
            return ""
        label = n.label.strip().rstrip(".):").strip()
        name = self.style.names.get(n.kind, ("{}", ""))[0].format(label).strip()
        again = re.search(r"~(\d+)$", n.path)
        return name + (self.style.again.format(again[1]) if again else "")

    def above(self, n: _Node) -> Iterator[_Node]:
        while n.parent is not None:
            n = self.nodes[n.parent]
            yield n

    def text(self, k: int) -> str:
        """The text of a subtree."""
        lines, stack = [], [k]
        while stack:
            n = self.nodes[stack.pop()]
            lines.append(self.own(n))
            stack += reversed(n.children)
        return "\n".join(filter(None, lines))

    def containers(self, n: _Node) -> tuple[str, str]:
        """The nearest containers of either level with their headings."""
        found = {"top": "", "sub": ""}
        for a in self.above(n):
            role = "top" if a.kind in self.style.top else "sub" if a.kind in self.style.sub else ""
            if role and not found[role]:
                found[role] = f"{self.part(a)} {a.content.split(chr(10))[0]}".strip()
        return found["top"], found["sub"]

    def prefix(self, top: str, sub: str) -> str:
        def cut(x: str) -> str:
            x = x.strip()
            return x if len(x) <= FIELD else x[: FIELD - 3].strip() + "..."

        head = ": ".join(filter(None, (self.about.number.strip(), cut(self.about.title))))
        date = f"{self.style.effective}: {self.about.effective}" if self.about.effective else ""
        return "\n".join(filter(None, (head, cut(top), cut(sub), date)))

    def bare(self, n: _Node, citation: str, text: str) -> bool:
        """Whether a text says no more than where it stands."""
        heading = n.content.split("\n")[0]
        known = {n.label, self.part(n), citation} | ({f"{self.part(n)}. {heading}", f"{self.part(n)} {heading}"} if "\n" in n.content else set())
        return normal(text) in {"", *map(normal, known)}

    def emit(self, k: int, citation: str, prefix: str, text: str) -> None:
        """A text as one chunk, or as passages; equal contents of a document once, then too short ones never."""
        n = self.nodes[k]
        if self.bare(n, citation, text):
            return
        parts = passages(text, self.most)
        if len(parts) > 1:
            parts = [p for p in parts if not self.bare(n, citation, p)]
        for i, p in enumerate(parts, 1):
            if p in self.seen or len(normal(p)) < self.least:
                continue
            self.seen.add(p)
            cited = citation if len(parts) == 1 else f"{citation}, {self.style.passage} {i}" if citation else f"{self.style.passage} {i}"
            self.out.append((len(self.out) + 1, cited, prefix, p, tokens(f"{prefix}\n{p}"), k))

    def divide(self, k: int, citation: str, prefix: str) -> None:
        """A provision in the largest parts that fit; parents' own texts lead those of their parts."""
        stack = [(k, citation, "")]
        while stack:
            k, citation, lead = stack.pop()
            n = self.nodes[k]
            size = n.length + (len(lead) + bool(n.length) if lead else 0)
            wanted = self.style.below.get(n.kind, ())
            parts = next((found for kind in wanted if (found := [c for c in n.children if self.nodes[c].kind == kind])), [])
            if size // 2 <= self.most or not parts:
                self.emit(k, citation, prefix, "\n".join(filter(None, (lead, self.text(k)))))
                continue
            own = self.own(n)
            if n.content and not self.bare(n, self.part(n), own):
                lead = "\n".join(filter(None, (lead, own)))
            stack += [(c, ", ".join(filter(None, (citation, self.part(self.nodes[c])))), lead) for c in reversed(parts)]

    def chunks(self) -> list[tuple]:
        """(ordinal from 1, citation, prefix, content, tokens, node) in reading order."""
        counters: Counter = Counter()
        for k, n in enumerate(self.nodes):
            if n.kind == self.style.article:
                top, sub = self.containers(n)
                citation = self.part(n)
                appendix = next((a for a in self.above(n) if a.kind in self.style.appendix), None)
                if appendix is not None:
                    name = self.part(appendix)
                    citation = f"{name} {appendix.ordinal}, {citation}" if self.repeats[name] > 1 else f"{name}, {citation}"
                elif self.repeats[citation] > 1:
                    around = [self.part(a) for a in self.above(n) if a.kind in self.style.top + self.style.sub]
                    citation = ", ".join([*reversed(around), citation])
                self.divide(k, citation, self.prefix(top, sub))
            elif n.kind in self.style.appendix and n.content:
                name = self.part(n)
                if self.repeats[name] > 1:
                    counters[name] += 1
                    name = f"{name} ({counters[name]})"
                self.emit(k, name, self.prefix(*self.containers(n)), self.own(n))
        if not self.out:
            self.fall_back()
        return self.out

    def fall_back(self) -> None:
        """Chunks of a document without articles: of its clauses, or else of its leaves, or of its roots."""
        filled = [k for k, n in enumerate(self.nodes) if n.length]
        some = [k for k in filled if self.nodes[k].kind == "clause"] or [k for k in filled if not self.nodes[k].children] or [k for k in filled if self.nodes[k].parent is None]
        for k in some:
            n = self.nodes[k]
            citation = ", ".join(filter(None, [*reversed([self.part(a) for a in self.above(n)]), self.part(n)]))
            self.emit(k, citation, self.prefix("", ""), self.text(k))


_CHUNKS = "doc_id bigint, ordinal bigint, citation string, prefix string, content string, tokens bigint, node bigint"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], [x.split()[0] for x in _CHUNKS.split(", ")])


def _facts(df: DataFrame) -> list:
    """Number, title and date of documents, empty where the table has no such column."""
    there = {c.lower() for c in df.columns}
    date = F.date_format("effective_at", "dd/MM/yyyy") if "effective_at" in there else F.lit("")
    text = [F.col(c).cast("string") if c in there else F.lit("") for c in ("doc_number", "title")]
    return [F.coalesce(x, F.lit("")).alias(n) for x, n in zip([*text, date], ("number", "title", "effective"), strict=True)]


def text_chunks(docs: DataFrame, grammar: str = "common", most: int = MOST, least: int = LEAST) -> DataFrame:
    """(doc_id, ordinal, citation, prefix, content, tokens, node) of docs (doc_id, text; doc_number, title, effective_at if there), parsed where they are read.

    Null and empty texts give no chunks; texts without headings are cut at lines. Repeated rows give equal chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t, *about in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows += [(i, *c) for c in Chunker(parse(t or "", grammar), STYLES[grammar], About(*about), most, least).chunks()]
            yield _batch(rows)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *_facts(docs)).mapInArrow(run, _CHUNKS)


def section_chunks(sections: DataFrame, documents: DataFrame, grammar: str = "common", most: int = MOST, least: int = LEAST) -> DataFrame:
    """text_chunks() of stored trees: sections (doc_id, node, parent, kind, ordinal, label, content, path), node in reading order; a document's sections are one group."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["node"])
        about = About(*(rows[0][n] for n in ("number", "title", "effective")))
        tree = [tuple(r[n] for n in ("node", "parent", "kind", "ordinal", "label", "content", "path")) for r in rows]
        return pa.Table.from_batches([_batch([(rows[0]["doc_id"], *c) for c in Chunker(tree, STYLES[grammar], about, most, least).chunks()])])

    facts = documents.select(F.col("doc_id"), *_facts(documents)).dropDuplicates(["doc_id"])
    joined = sections.join(facts, "doc_id", "left").fillna("", ["number", "title", "effective"])
    return joined.groupBy("doc_id").applyInArrow(run, _CHUNKS)
