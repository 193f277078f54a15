"""What is done to a query before the search: accents restored, abbreviations spelled out, lexical weight, documents named in it."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, replace

_NUMBER = re.compile(r"\b\d{1,4}/\d{4}(?:/[\w-]+)?|\bact \d{1,4}\b", re.IGNORECASE)


@dataclass(frozen=True)
class Options:
    """Settings of a search; None leaves a setting to the one below."""

    top_k: int | None = None
    pool: int | None = None
    doc_cap: int | None = None
    in_force_only: bool | None = None
    other_pass: bool | None = None
    #: hybrid, vector or bm25; a date; the constant of rank fusion; none, clause or article.
    mode: str | None = None
    as_of: str | None = None
    rrf_k: int | None = None
    roll_up: str | None = None

    def over(self, *below: Options) -> Options:
        """These settings, gaps filled from the ones below in turn; a search within named documents has no pass for others."""
        out = self
        for b in below:
            out = replace(out, **{k: getattr(b, k) for k in self.__dataclass_fields__ if getattr(out, k) is None})
        return out


DEFAULTS = Options(top_k=8, pool=50, doc_cap=3, in_force_only=True, other_pass=True, mode="hybrid", rrf_k=60, roll_up="article")


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn").replace("đ", "d")


def restored(query: str, words: dict[str, str], pairs: dict[str, str]) -> str:
    """Accents put back by a dictionary of folded words and of folded pairs; pairs go first. Words with accents stay."""
    parts, out, k = query.split(), [], 0
    while k < len(parts):
        two = " ".join(parts[k : k + 2]).lower()
        if k + 1 < len(parts) and fold(two) == two and two in pairs:
            out.append(pairs[two])
            k += 2
        else:
            one = parts[k].lower()
            out.append(words.get(one, parts[k]) if fold(one) == one else parts[k])
            k += 1
    return " ".join(out)


def expanded(query: str, abbreviations: dict[str, str]) -> str:
    """The query, and in brackets what its abbreviations stand for, sorted; whole words only."""
    padded = f" {' '.join(re.findall(r'[\w&-]+', query.lower()))} "
    found = sorted({full for short, full in abbreviations.items() if f" {short.lower()} " in padded})
    return f"{query} ({', '.join(found)})" if found else query


def named_documents(query: str) -> list[str]:
    """Document numbers in a query, lower case, unique and sorted."""
    return sorted({m[0].lower() for m in _NUMBER.finditer(query)})


def lexical_weight(query: str, boosted: float = 1.0, usual: float = 0.5) -> float:
    """More weight for words where the query has no accents, or names a document."""
    return boosted if fold(query) == query.lower() or named_documents(query) else usual
