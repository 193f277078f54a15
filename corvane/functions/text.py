"""Text functions as column expressions: folding, tokens, identity keys, references."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_map() -> tuple[str, str]:
    """Accented letters of the Latin blocks and their bases, by Unicode's own decompositions; d with stroke by rule."""
    pairs = {"đ": "d", "Đ": "D"}
    for code in (*range(0xC0, 0x250), *range(0x1EA0, 0x1EFA)):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code):
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


_ACCENTED, _BASE = _fold_map()


def unaccented(text: Column) -> Column:
    """Lower case without accents, all else as it is."""
    return F.regexp_replace(F.translate(F.lower(text), _ACCENTED, _BASE), r"\p{Mn}", "")


def folded(text: Column) -> Column:
    """Lower case without accents; what is no letter or digit becomes a space."""
    return F.regexp_replace(unaccented(text), r"[^\p{L}\p{Nd}]+", " ")


def repeats_a_word(text: Column) -> Column:
    """Whether a word of two letters or more stands twice in a row, with blanks or an opening bracket between."""
    return text.rlike(r"(?iu)(?<![\p{L}\p{N}_])(\p{L}{2,})[\s(]+\1(?![\p{L}\p{N}_])")


def folded_tokens(text: Column) -> Column:
    return F.filter(F.split(folded(text), " "), lambda t: t != "")


def document_number(number: Column) -> Column:
    """A number as it is stored: upper case, letters and digits only."""
    return F.regexp_replace(F.translate(F.upper(F.trim(number)), "Đ", "D"), r"[^\p{L}\p{Nd}]", "")


def document_key(kind: Column, number: Column, source: Column, external: Column) -> Column:
    """TYPE|NUMBER; the number alone without a type; source:external without a number."""
    n = document_number(F.coalesce(number, F.lit("")))
    k = F.upper(F.trim(F.coalesce(kind, F.lit(""))))
    return F.when(n == "", F.concat_ws(":", source, external)).when(k == "", n).otherwise(F.concat_ws("|", k, n))


def references(text: Column) -> Column:
    """Document numbers named in a text, lower case, unique and sorted: 12/2020/AB-CD, act 123."""
    found = F.concat(F.regexp_extract_all(text, F.lit(r"(\d{1,4}/\d{4}/[\p{L}\d-]+)"), 1), F.regexp_extract_all(text, F.lit(r"(?i)\b(act \d{1,4})\b"), 1))
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))


def terms_in(text: Column, terms: list[str]) -> Column:
    """Which of the terms a text holds, letter case apart; the text is lower-cased once, and no join is needed."""
    return F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), lambda low: F.filter(F.array(*map(F.lit, terms)), lambda t: low.contains(F.lower(t))))[0]


def in_scope(text: Column, strong: list[str], weak: list[str], signals: list[str]) -> Column:
    """A strong term, or a weak one together with a signal; terms are compared folded, as whole words."""
    padded = F.concat(F.lit(" "), folded(text), F.lit(" "))

    def some(terms: list[str]) -> Column:
        out = F.lit(False)
        for t in terms:
            out = out | padded.contains(f" {t} ")
        return out

    return some(strong) | (some(weak) & some(signals))
