"""Thousands of terms in one pass over each text, by an Aho-Corasick automaton that goes out with the tasks.

The time for a text is that of its length and its matches, not of the number of terms. The vocabulary is configuration:
small, held by the driver, and as a compiled automaton some tens of bytes for each letter of a term.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.query import fold

# Classes of terms. Strong ones count anywhere, strong_title ones in number and title, weak ones there and only with a signal.
STRONG, STRONG_TITLE, WEAK, SIGNAL = "strong", "strong_title", "weak", "signal"
CLASSES = (STRONG, STRONG_TITLE, WEAK, SIGNAL)
_PLACES = ("number", "title", "body")


def normal(text: str | None) -> str:
    """Lower case, composed letters, single blanks."""
    return " ".join(unicodedata.normalize("NFC", (text or "").lower()).split())


def folded(text: str | None) -> str:
    """normal() without accents."""
    return " ".join(fold(text or "").split())


def automaton(terms: Iterable[str]) -> ahocorasick.Automaton:
    """An automaton whose matches give the terms' numbers; of equal terms the first number, empty ones none."""
    a = ahocorasick.Automaton()
    for k, t in enumerate(terms):
        if t and t not in a:
            a.add_word(t, (k, len(t)))
    if len(a):
        a.make_automaton()
    return a


def found(a: ahocorasick.Automaton, text: str) -> Iterator[tuple[int, int]]:
    """(number of the term, begin) of every occurrence, overlapping ones too."""
    return ((k, end + 1 - n) for end, (k, n) in a.iter(text)) if len(a) else iter(())


@dataclass(frozen=True)
class Vocabulary:
    """Terms of a corpus's domain by class; terms of other classes are ignored, equal ones count once, in their first place."""

    terms: tuple[tuple[str, str], ...]

    @staticmethod
    def of(rows: Iterable[tuple[str, str]]) -> Vocabulary:
        kept = dict.fromkeys((normal(t), c) for t, c in rows if c in CLASSES and normal(t))
        return Vocabulary(tuple(kept))

    def compiled(self, fold_terms: bool = False) -> tuple[ahocorasick.Automaton, list[list[int]]]:
        """An automaton over the distinct terms, and for each the places in `terms` that it stands for."""
        known: dict[str, list[int]] = {}
        for k, (t, _) in enumerate(self.terms):
            known.setdefault(folded(t) if fold_terms else t, []).append(k)
        return automaton(known), list(known.values())


def matched(vocabulary: Vocabulary, compiled: tuple[ahocorasick.Automaton, list[list[int]]], number: str, title: str, body: str) -> list[tuple[str, str]]:
    """(term, where it stands first) of the terms that bring a document into the domain, by class and then in the vocabulary's order.

    number, title and body are normal() or folded() as the terms are.
    """
    a, stands_for = compiled
    seen: dict[int, str] = {}
    for place, text in zip(_PLACES, (number, title, body), strict=True):
        for n, _ in found(a, text):
            for k in stands_for[n]:
                seen.setdefault(k, place)
    head = {k for k, place in seen.items() if place != "body"}
    signal = any(vocabulary.terms[k][1] == SIGNAL for k in head)
    out = []
    for wanted in (STRONG, STRONG_TITLE, WEAK):
        for k in sorted(seen):
            term, kind = vocabulary.terms[k]
            if kind == wanted and (kind == STRONG or (k in head and (kind == STRONG_TITLE or signal))):
                out.append((term, seen[k]))
    return out


def query_scope(vocabulary: Vocabulary, text: str) -> list[str]:
    """The terms that bring a question into the domain; one without accents that has none is tried again without the terms' accents."""
    low = normal(text)
    if terms := [t for t, _ in matched(vocabulary, vocabulary.compiled(), "", low, low)]:
        return terms
    plain = folded(text)
    return [t for t, _ in matched(vocabulary, vocabulary.compiled(True), "", plain, plain)] if plain == low else []


def scoped(docs: DataFrame, vocabulary: Vocabulary, id_column: str = "id", rescue: bool = False) -> DataFrame:
    """(id, in_scope, matched, places) of docs (id, doc_number, title, body), each text read once.

    With `rescue`, terms and texts are compared without accents. Nulls count as empty texts, and repeated rows get equal
    results. Nothing is in scope of an empty vocabulary; who demotes documents by this must not do so without terms.
    """
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, vocabulary.compiled(rescue)))
    same = folded if rescue else normal
    out = "id bigint, in_scope boolean, matched array<string>, places array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, compiled = sent.value
        for b in batches:
            rows = [matched(known, compiled, same(n), same(t), same(x)) for n, t, x in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)]
            lists = [pa.array([[m[k] for m in r] for r in rows], pa.list_(pa.string())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bool(r) for r in rows], pa.bool_()), *lists], ["id", "in_scope", "matched", "places"])

    return docs.select(F.col(id_column).cast("bigint").alias("id"), *(F.col(c).cast("string").alias(c) for c in ("doc_number", "title", "body"))).mapInArrow(run, out)


def occurrences(docs: DataFrame, terms: Sequence[str], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, term, first, n): how often each term stands in each text, and where first, in characters; texts and terms in lower case as they are.

    Terms that equal each other in lower case are one; null and empty texts hold none; repeated rows give equal rows.
    """
    low = list(dict.fromkeys(t.lower() for t in terms if t))
    sent = docs.sparkSession.sparkContext.broadcast((automaton(low), low))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, names = sent.value
        for b in batches:
            rows: list[tuple] = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                first: dict[int, int] = {}
                count: dict[int, int] = {}
                for k, at in found(a, (text or "").lower()):
                    first.setdefault(k, at)
                    count[k] = count.get(k, 0) + 1
                rows += [(i, names[k], first[k], n) for k, n in count.items()]
            columns = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["id", "term", "first", "n"])

    return docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, "id bigint, term string, first bigint, n bigint")
