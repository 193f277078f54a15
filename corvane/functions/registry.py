"""Functions by key, for callers to add their own: normalizers of text, canonical forms of document numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import citations, repair, text

#: Text to tokens, by language.
NORMALIZERS: dict[str, Callable[[Column], Column]] = {"": text.folded_tokens, "vn": text.folded_tokens, "th": repair.thai_clusters}
#: A document number to its candidate forms, best first, by jurisdiction.
CANONICAL: dict[str, Callable[[Column], Column]] = {"": lambda n: F.array(text.document_number(n)), "id": citations.number_variants}
