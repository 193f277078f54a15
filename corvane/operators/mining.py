"""Relations between documents found in their texts and in structured payloads."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of context on either side of a mention.
WINDOW = 180
_MENTION = re.compile(r"\b\d{1,4}/\d{4}(?:/[\w-]+)?|\b[Aa]ct \d{1,4}\b")
#: (relation, pattern), the first that the context before or after a mention holds decides.
OPERATORS = tuple(
    (name, re.compile(words, re.IGNORECASE))
    for name, words in (
        ("amends_and_supplements", r"amend\w* and supplement|sửa đổi,? bổ sung"),
        ("replaces", r"\breplac|\bsupersed|thay thế|\bmenggantikan"),
        ("repeals", r"\brepeal|\brevok|bãi bỏ|\bmencabut"),
        ("amends", r"\bamend|sửa đổi|\bperubahan\b|\bmengubah"),
        ("guides", r"\bimplement|hướng dẫn|quy định chi tiết|\bpelaksanaan"),
        ("based_on", r"\bpursuant to|\bin accordance with|căn cứ|\bberdasarkan"),
    )
)
_CITED = re.compile(r"\b(?:Article|Section|Điều|Pasal)\s+\d+\w?", re.IGNORECASE)
_BOUND = re.compile(r"[.;:!?](?:\s|$)|\n")
_OUT = "doc_id bigint, number string, relation string, target string, start bigint, evidence string"


def mentions(text: str) -> Iterator[tuple[str, str | None, str | None, int, str]]:
    """(number, relation, cited target, start, statement) of each document number in a text, within its statement and at most WINDOW characters away."""
    for m in _MENTION.finditer(text):
        low, high = max(0, m.start() - WINDOW), min(len(text), m.end() + WINDOW)
        for b in _BOUND.finditer(text, low, m.start()):
            low = b.end()
        if b := _BOUND.search(text, m.end(), high):
            high = b.start()
        said = text[low:high]
        relation = next((name for name, p in OPERATORS if p.search(said)), None)
        target = _CITED.search(said)
        yield m[0].lower(), relation, target and target[0], m.start(), said.strip()


def mined_relations(docs: DataFrame) -> DataFrame:
    """(doc_id, number, relation, target, start, evidence), one row for each (document, number, relation, target), its first mention, with a relation or without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                first: dict[tuple, tuple] = {}
                for number, relation, target, start, said in mentions(t or ""):
                    first.setdefault((number, relation, target), (i, number, relation, target, start, said))
                out += first.values()
            if out:
                types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [x.split()[0] for x in _OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _OUT)


def structured_relations(payloads: DataFrame, kinds: DataFrame) -> DataFrame:
    """(doc_id, number, relation, promoted) of payloads (doc_id, json), a list of {type, number}; kinds (code, label, trusted) names types. Unknown types stay under their code and are not promoted; entries without a number are left out."""
    items = F.from_json("json", "array<struct<type: string, number: string>>")
    e = payloads.select("doc_id", F.explode(items).alias("e")).select("doc_id", F.trim("e.number").alias("number"), F.col("e.type").alias("code")).where("length(number) > 0")
    return e.join(F.broadcast(kinds), "code", "left").select("doc_id", "number", F.coalesce("label", "code").alias("relation"), F.coalesce("trusted", F.lit(False)).alias("promoted")).distinct()


_SUPERSEDES = re.compile(r"\bsupersedes?\b(?: the)?(?: following)?:?\s*(.+?)(?:\.(?:\s|$)|\n\n|$)", re.IGNORECASE | re.DOTALL)
_LISTED = re.compile(r"\([a-z]\)\s*|;\s*(?:and\s+)?")
_ISSUED = re.compile(r",?\s*(?:which was\s+)?(?:issued|dated)(?:\s+on)?\s+(\d{1,2} \w+ \d{4})\b", re.IGNORECASE)


def superseded_titles(text: str) -> list[tuple[str, str | None]]:
    """(title, date issued) of the documents that a text says it supersedes."""
    out = []
    for m in _SUPERSEDES.finditer(text):
        for part in _LISTED.split(m[1]):
            issued = _ISSUED.search(part)
            title = re.sub(r"\s+", " ", _ISSUED.sub("", part)).strip(" ,;.'\"“”")
            if len(title) > 3:
                out.append((title, issued and issued[1]))
    return out


def base_of(text: str, preamble: int = 400) -> str | None:
    """The number that a consolidated text names most often in its preamble and footnotes; the smallest of several."""
    notes = "\n".join(x for x in text.split("\n") if re.match(r"\s*\[\d+\]", x))
    votes = Counter(m[0].lower() for m in _MENTION.finditer(f"{text[:preamble]}\n{notes}"))
    return min(votes, key=lambda n: (-votes[n], n)) if votes else None


# How far a relation is trusted that has weak evidence only, by (authority, in a title, with an operator word).
OFFICIAL = ("official_tree", "official_text", "official_metadata")
TRANSCRIBED = "non_binding_transcription"
WEAK_CONFIDENCE = {
    ("official", True, True): 0.65,
    ("official", True, False): 0.5,
    ("official", False, True): 0.55,
    ("official", False, False): 0.45,
    ("transcribed", True, True): 0.45,
    ("transcribed", True, False): 0.35,
    ("transcribed", False, True): 0.35,
    ("transcribed", False, False): 0.25,
    ("other", True, True): 0.3,
    ("other", True, False): 0.3,
    ("other", False, True): 0.2,
    ("other", False, False): 0.2,
}


def weak_confidence(authority: Column, title_level: Column, operator: Column) -> Column:
    """The confidence of weak evidence; an operator of blanks is none, and an unknown authority counts as other."""
    kind = F.when(authority.isin(*OFFICIAL), "official").when(authority == TRANSCRIBED, "transcribed").otherwise("other")
    named = F.trim(F.coalesce(operator, F.lit(""))) != ""
    out = F.lit(None).cast("double")
    for (k, title, word), value in WEAK_CONFIDENCE.items():
        out = F.when((kind == k) & (F.coalesce(title_level, F.lit(False)) == F.lit(title)) & (named == F.lit(word)), value).otherwise(out)
    return out
