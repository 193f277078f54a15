"""Citations, dates, document numbers and damage marks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import _ACCENTED, _BASE


def diacritic_free(text: Column) -> Column:
    """Whether no letter has an accent."""
    low = F.lower(text)
    return (F.translate(low, _ACCENTED, _BASE) == low) & ~low.rlike(r"\p{Mn}")


def citation_up_to(citation: Column, prefix: str) -> Column:
    """The parts of a citation up to the first that begins with the prefix; the whole citation if none does."""
    parts = F.transform(F.split(citation, ","), lambda p: F.trim(p))
    at = F.array_position(F.transform(parts, lambda p: p.startswith(prefix)), F.lit(True))
    return F.when(at > 0, F.array_join(F.slice(parts, F.lit(1), F.greatest(at, F.lit(1)).cast("int")), ", ")).otherwise(F.array_join(parts, ", "))


def path_citation(path: Column) -> Column:
    """Kinds and labels of a path: chapter-1/article-2~3 becomes Chapter 1, Article 2 [3]."""

    def part(p: Column) -> Column:
        kind, label, again = (F.regexp_extract(p, r"^(\w+?)-([^~]*)(?:~(\d+))?$", k) for k in (1, 2, 3))
        named = F.concat(F.initcap(kind), F.lit(" "), label, F.when(again != "", F.concat(F.lit(" ["), again, F.lit("]"))).otherwise(""))
        return F.when(kind == "", F.initcap(p)).otherwise(named)

    return F.array_join(F.transform(F.split(path, "/"), part), ", ")


def chunk_label(label: Column) -> Column:
    """A label without marks around it and with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(label, r"[\s ]+", " "), r"^[\s.:;,–-]+|[\s.:;,–-]+$", ""))


def label_only(content: Column, least: int = 2) -> Column:
    """Whether a chunk holds nothing but a heading's label and number."""
    return F.coalesce(F.lower(F.trim(content)).rlike(r"^(?:part|chapter|section|article|điều|chương|mục|phần|pasal|bab)?\s*[\divxlc]+[a-z]?[.):]?$"), F.lit(True)) | (F.length(F.trim(content)) < least)


def enacting_date(text: Column) -> Column:
    """The first date written out, in Vietnamese, English or Indonesian, as a date; null if there is none or it does not exist."""
    vn = r"(?i)ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"
    spelled = r"(?i)\b(\d{1,2})\s+(january|januari|february|februari|march|maret|april|may|mei|june|juni|july|juli|august|agustus|september|october|oktober|november|december|desember)\s+(\d{4})"
    months = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "mei": 5, "jun": 6, "jul": 7, "aug": 8, "agu": 8, "sep": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12, "des": 12}
    name = F.lower(F.regexp_extract(text, spelled, 2))
    number = F.lit("")
    for m, k in months.items():
        number = F.when(name.startswith(m), str(k)).otherwise(number)

    def date(*parts: Column) -> Column:
        return F.try_to_timestamp(F.concat_ws("-", *parts), F.lit("yyyy-M-d")).cast("date")

    return F.coalesce(date(*(F.regexp_extract(text, vn, k) for k in (3, 2, 1))), date(F.regexp_extract(text, spelled, 3), number, F.regexp_extract(text, spelled, 1)))


def number_variants(reference: Column) -> Column:
    """Forms of an Indonesian reference: nomor N tahun Y, no. N tahun Y, N/Y; other references stand alone."""
    low = F.trim(F.regexp_replace(F.lower(reference), r"\s+", " "))
    n, y = (F.regexp_extract(low, r"(?:nomor |no\.? ?)?(\d+)(?: tahun |/)(\d{4})", k) for k in (1, 2))
    forms = F.array(F.concat(F.lit("nomor "), n, F.lit(" tahun "), y), F.concat(F.lit("no."), n, F.lit(" tahun "), y), F.concat(n, F.lit("/"), y))
    return F.when(n == "", F.array(low)).otherwise(forms)


def locally_damaged(text: Column) -> Column:
    """Whether a line of 12 characters or more holds three damage marks and 8 % of them."""

    def bad(line: Column) -> Column:
        marks = F.length(line) - F.length(F.regexp_replace(line, "[ÃÂ�]|â€", ""))
        return (F.length(line) >= 12) & (marks >= 3) & (marks >= 0.08 * F.length(line))

    return F.coalesce(F.exists(F.split(text, "\n"), bad), F.lit(False))


def titles_match(a: Column, b: Column, share: float = 0.85) -> Column:
    """Whether two titles are equal, or one holds the other and is hardly longer, letter case and marks apart."""
    x, y = (F.trim(F.regexp_replace(F.lower(t), r"[^\p{L}\p{Nd}]+", " ")) for t in (a, b))
    short, long = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    return F.coalesce((short > 0) & ((x == y) | ((x.contains(y) | y.contains(x)) & (short >= share * long))), F.lit(False))


def detail(df, level: str):
    """Columns of hits by level of detail; never their order or number."""
    compact = ["id", "doc_number", "citation", "status_class", "score"]
    keep = {"compact": compact, "standard": [*compact, "title", "snippet", "is_binding"], "full": df.columns}[level]
    return df.select(*(c for c in df.columns if c in keep))


def prefix(number: Column, title: Column, chapter: Column, section: Column, label: Column, effective: Column, most: int = 220) -> Column:
    """What stands before a chunk: number and title, chapter, section, and the label with the date; each but the date cut to `most` characters."""

    def cut(x: Column) -> Column:
        x = F.trim(F.coalesce(x, F.lit("")))
        return F.when(F.length(x) <= most, x).otherwise(F.concat(F.trim(F.substring(x, 1, most - 3)), F.lit("...")))

    number, title = F.coalesce(number, F.lit("")), cut(title)
    head = F.concat_ws(": ", F.when(number != "", number), F.when(title != "", title))
    rest = (F.when(x != "", x) for x in (head, cut(chapter), cut(section)))
    return F.concat_ws("\n", *rest, F.concat(label, F.lit(": "), F.date_format(effective, "dd/MM/yyyy")))
