"""Repairs of extracted text: page noise, look-alike letters, parted accents; and clusters of Thai letters."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Rows of a batch whose values are Python objects at one time.
ROWS = 64
_PAGE = re.compile(r"^\s*(?:[-–—]?\s*\d{1,4}\s*[-–—]?|(?:page|trang|halaman)\s+\d{1,4}(?:\s*(?:of|/|dari)\s*\d{1,4})?)\s*$", re.IGNORECASE)
#: Cyrillic letters and the Latin ones they look like.
CYRILLIC, LATIN = "АВЕКМНОРСТУХаеорсухіјѕ", "ABEKMHOPCTYXaeopcyxijs"
_LOOKS = str.maketrans(CYRILLIC, LATIN)
_MIXED = re.compile(r"\w*[A-Za-zÀ-ɏḀ-ỹ]\w*")


def without_page_noise(text: str) -> str:
    """Text without page numbers next to page or paragraph ends, or short lines that open several pages; two blank lines at most."""
    pages = [p.split("\n") for p in text.split("\f")]
    opening = Counter(next((x.strip() for x in p if x.strip()), "") for p in pages)
    running = {x for x, n in opening.items() if x and n >= 3 and len(x) < 100}
    out: list[str] = []
    for p in pages:
        first = next((k for k, x in enumerate(p) if x.strip()), -1)
        for k, x in enumerate(p):
            edge = k < 3 or k >= len(p) - 3 or not p[k - 1].strip() or not p[k + 1].strip()
            if not (edge and _PAGE.match(x) or k == first and x.strip() in running):
                out.append(x.rstrip())
    return re.sub(r"\n{4,}", "\n\n\n", "\n".join(out)).strip("\n")


def letters_repaired(text: str) -> str:
    """Cyrillic look-alikes in words with Latin letters as Latin ones, accents joined to the letter before a space, lone replacement marks dropped; NFC."""
    text = _MIXED.sub(lambda m: m[0].translate(_LOOKS), text)
    text = re.sub(r"(?<=[^\W\d_]) +(?=[̀-̣ͯ])", "", text)
    text = re.sub(r"(?<!�)�(?!�)", "", text)
    return unicodedata.normalize("NFC", text)


#: A Thai cluster: a leading vowel, a consonant with what stands above or below it, and vowels that follow; or one other character.
_CLUSTER = re.compile(r"[เ-ไ]?[ก-ฮ][ัิ-ฺ็-๎]*(?:[ะาำๅ][็-๎]*ะ?)?(?:[ก-ฮ]์)?|.", re.DOTALL)


def clusters(text: str) -> list[str]:
    """Letters, digits and marks of a text in Thai clusters; runs of other scripts stay whole words."""
    out = []
    for run in re.findall(r"[ก-๎]+|[^\W_ก-๎]+", unicodedata.normalize("NFC", text.lower())):
        out += _CLUSTER.findall(run) if "ก" <= run[0] <= "๎" else [run]
    return out


def _each(values: pa.Array, function: Callable, kind: pa.DataType) -> pa.Array:
    """The function of each value; only ROWS values and results at a time are Python objects, the rest of a batch stays in Arrow."""
    parts = [pa.array([function(x) for x in values.slice(a, ROWS).to_pylist()], kind) for a in range(0, len(values), ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


@F.arrow_udf(StringType())
def cleaned(text: pa.Array) -> pa.Array:
    return _each(text, lambda t: None if t is None else letters_repaired(without_page_noise(t)), pa.string())


@F.arrow_udf(ArrayType(StringType()))
def thai_clusters(text: pa.Array) -> pa.Array:
    return _each(text, lambda t: clusters(t or ""), pa.list_(pa.string()))


@F.arrow_udf(StringType())
def decoded_thai(content: pa.Array) -> pa.Array:
    """Text of bytes in the legacy Thai code page; what it lacks becomes a replacement mark."""
    return _each(content, lambda b: None if b is None else bytes(b).decode("cp874", "replace"), pa.string())
