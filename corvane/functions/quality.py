"""Whether extracted text can be trusted: the quality gate, source placeholders, scanned layers; as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import unaccented

# The settings' names and defaults, marks of UTF-8 read in another encoding, and the floors of mojibake.
SETTINGS = {
    "max_bad_ratio": "extract.pdf.max_bad_ratio",
    "min_diacritic_density": "extract.pdf.min_diacritic_density",
    "min_letters": "extract.pdf.min_letters",
    "pass_threshold": "extract.pdf.pass_threshold",
    "max_whitespace_ratio": "extract.pdf.max_whitespace_ratio",
    "max_pua_ratio": "extract.pdf.max_pua_ratio",
    "max_scan_image_ratio": "extract.pdf.max_scan_image_ratio",
}
MOJIBAKE_MARKS = "√∆·ªƒ∫≠‚ÄØ"
MOJIBAKE_COUNT, MOJIBAKE_RATIO = 8, 0.005
CYRILLIC_COUNT, CYRILLIC_RATIO = 8, 0.005


@dataclass(frozen=True)
class Gate:
    """Thresholds of the quality gate."""

    max_bad_ratio: float = 0.01
    min_diacritic_density: float = 0.02
    min_letters: int = 50
    pass_threshold: float = 0.6
    max_whitespace_ratio: float = 0.40
    max_pua_ratio: float = 0.005
    max_scan_image_ratio: float = 0.8

    @classmethod
    def of_settings(cls, settings: dict[str, str]) -> Gate:
        """Thresholds from the settings; what is missing or no number keeps its default."""
        out = {}
        for f in fields(cls):
            raw = settings.get(SETTINGS[f.name])
            try:
                out[f.name] = type(f.default)(raw.strip())
            except (AttributeError, ValueError):
                pass
        return cls(**out)

    def scan_layer_suspect(self, probed: Column, image_pages: Column) -> Column:
        """Whether most probed pages are images, so that their text layer is someone else's OCR; never without probes."""
        return F.lit(self.max_scan_image_ratio > 0) & (probed > 0) & (image_pages / probed >= self.max_scan_image_ratio)


def _count(text: Column, kind: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, kind, ""))


def cyrillic_mojibake(text: Column) -> Column:
    """Cyrillic letters beyond a stray few, which texts in Latin script don't hold."""
    n = _count(text, r"[Ѐ-ӿ]")
    return (n >= CYRILLIC_COUNT) & (n >= CYRILLIC_RATIO * F.length(text))


def assess(text: Column, gate: Gate = Gate()) -> Column:  # noqa: B008
    """(confidence, ok, reason) of a text: penalties for damaged, blank and private-use characters, mojibake, missing accents and too few letters.

    A letter with marks behind it counts as one accented letter. Null is an empty text, which fails.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\p{L}\p{Mn}+", "é")
    return _once(_once(t, _counts), lambda c: _verdict(c, gate))


def _once(value: Column, then) -> Column:
    """`then` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def _counts(t: Column) -> Column:
    kinds = {"letters": r"\p{L}", "ascii": "[A-Za-z]", "bad": r"[\x00-\x08\x0B\x0E-\x1F\x7F-\x9F�]", "blank": r"[\t\n\x0B\f\r\x85\p{Z}]", "private": r"[\x{E000}-\x{F8FF}]", "marks": f"[{MOJIBAKE_MARKS}]", "cyrillic": "[Ѐ-ӿ]"}
    return F.struct(F.length(t).alias("n"), *(_count(t, k).alias(name) for name, k in kinds.items()))


def _verdict(c: Column, gate: Gate) -> Column:
    n, letters, marks = c.n, c.letters, c.marks
    share = lambda x: x / F.greatest(n, F.lit(1))
    bad, blank, private = share(c.bad), share(c.blank), share(c.private)
    garbled = (marks >= MOJIBAKE_COUNT) & (share(marks) > MOJIBAKE_RATIO)
    cyrillic = (c.cyrillic >= CYRILLIC_COUNT) & (c.cyrillic >= CYRILLIC_RATIO * n)
    plain = (letters >= 200) & ((letters - c.ascii) / F.greatest(letters, F.lit(1)) < gate.min_diacritic_density)
    faults = (
        (bad > gate.max_bad_ratio, bad * 5.0, "bad chars"),
        (letters < gate.min_letters, F.lit(0.3), "too few letters"),
        (blank > gate.max_whitespace_ratio, F.lit(0.3), "high whitespace"),
        (private > gate.max_pua_ratio, F.lit(0.5), "PUA runes (TCVN3/VNI mojibake)"),
        (garbled, F.lit(0.7), "UTF-8 mojibake markers"),
        (cyrillic, F.lit(0.7), "Cyrillic mojibake (CP1251 double-encode)"),
        (plain, F.lit(0.5), "low diacritic density"),
    )
    left = F.lit(1.0)
    for found, penalty, _ in faults:
        left = left - F.when(found, penalty).otherwise(0.0)
    confidence = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), left)))
    failed = (bad >= gate.max_bad_ratio) | (private > gate.max_pua_ratio) | garbled | cyrillic | (letters < gate.min_letters)
    ok = (n > 0) & (confidence >= gate.pass_threshold) & ~failed
    named = F.concat_ws("; ", *(F.when(found, F.lit(reason)) for found, _, reason in faults))
    reason = F.when(ok, "").when(n == 0, "empty text").when(named == "", "below confidence threshold").otherwise(named)
    return F.struct(confidence.alias("confidence"), ok.alias("ok"), reason.alias("reason"))


def official_placeholder(text: Column) -> Column:
    """Whether a source says that its file is still to come; at most 200 letters, and blank text is none."""
    t = F.regexp_replace(unaccented(F.coalesce(text, F.lit(""))), r"\s+", " ")
    letters = _count(t, r"\p{L}")
    return (letters <= 200) & t.contains("dang cap nhat") & (t.contains("file") | t.contains("dinh kem") | (letters < 80))


def source_unavailable(text: Column) -> Column:
    """A placeholder, or no text at all."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "").isin("") | official_placeholder(text)
