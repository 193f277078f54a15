"""Scanned Indonesian regulations: confused digits, letterheads, merged headings, quoted articles, notes and annexes."""

import random

import pytest

from corvane.operators import indonesian, provisions
from corvane.operators.chunker import STYLES, About, Chunker


def paths(text):
    return [r[6] for r in indonesian.parse(text)]


@pytest.mark.parametrize(("number", "first"), [("7", 7), ("1O", 10), ("l2", 12), ("T", 7), ("2T", 27), ("II", 2), ("XIV", 14), ("I", 1), ("1 1 2", 112)])
def test_readings(number, first):
    assert indonesian.readings(number)[0] == first


def test_a_regulation_read_from_scans():
    text = """UNDANG-UNDANG REPUBLIK INDONESIA
Menimbang: bahwa Pasal 5 perlu
BAB I
KETENTUAN UMUM
Pasal 1
Dalam Undang-Undang ini:
1. Data adalah data.
PRESIDEN
REPUELIK INDONESIA
- 2 -
SK No 016999A
BABII
ASAS
DAN TUJUAN
Bagian Kesatu
Umum
Pasal2
(1) Satu.
(2) Dua:
a. alfa;
b. beta.
' Pasal 3. . .
Isi
Pasal 4 (1) Langsung pada baris yang sama.
(l) bukan
(2) Kedua
PENJELASAN
ATAS
Pasal 1 Cukup jelas."""
    rows = indonesian.parse(text)
    assert [r[6] for r in rows] == ["chapter-i", "chapter-i/article-1", "chapter-ii", "chapter-ii/part-1", "chapter-ii/part-1/article-2", "chapter-ii/part-1/article-2/clause-1", "chapter-ii/part-1/article-2/clause-2", "chapter-ii/part-1/article-2/clause-2/point-a", "chapter-ii/part-1/article-2/clause-2/point-b", "chapter-ii/part-1/article-3", "chapter-ii/part-1/article-4", "chapter-ii/part-1/article-4/clause-1", "chapter-ii/part-1/article-4/clause-1~2", "chapter-ii/part-1/article-4/clause-2", "notes"]
    content = {r[6]: r[5] for r in rows}
    assert content["chapter-i"] == "KETENTUAN UMUM" and content["chapter-ii"] == "ASAS DAN TUJUAN" and content["chapter-ii/part-1"] == "Umum"
    assert content["chapter-i/article-1"] == "Dalam Undang-Undang ini:\n1. Data adalah data." and content["notes"] == "ATAS\nPasal 1 Cukup jelas."


def test_numbers_are_settled_by_their_neighbours():
    rng = random.Random(3)
    for _ in range(30):
        lines = []
        for n in range(1, 120):
            shown = "".join(rng.choice({"0": "0Oo", "1": "1Il", "7": "7T"}.get(c, c)) for c in str(n))
            if not (len(shown) > 1 and set(shown) <= set("IVXLCDM")):
                lines.append(f"Pasa{rng.choice('l17')}{rng.choice(['', ' '])}{shown}{rng.choice(['', '. .', ''])}")
            else:
                lines.append(f"Pasal {n}")
            lines.append(f"sebagaimana dimaksud dalam angka {rng.randrange(99)}")
        assert paths("\n".join(lines)) == [f"article-{n}" for n in range(1, 120)]


def test_references_are_text():
    text = "Pasal 1\nsatu\nPasal 3 Undang-Undang lama tetap berlaku\nPasal 2\ndua\nPasal 3\ntiga\nPasal 4\nempat"
    rows = indonesian.parse(text)
    assert [r[6] for r in rows] == ["article-1", "article-2", "article-3", "article-4"] and "Pasal 3 Undang" in rows[0][5]


def test_quoted_articles_of_an_amended_law_are_text():
    text = "Pasal 1\nKetentuan Pasal 2 diubah sehingga berbunyi sebagai berikut:\nPasal 2\nbaru\nPasal 2\nUndang-Undang ini mulai berlaku"
    rows = indonesian.parse(text)
    assert [r[6] for r in rows] == ["article-1", "article-2"] and rows[0][5].endswith("Pasal 2\nbaru") and rows[1][5].startswith("Undang")


@pytest.mark.parametrize("line", ["PRESIDEN", "FRESIDEN", "PRES1DEN REPUBLIK INDONESIA", "REPI.JBLIK INDONESIA", "PRESlDEN REPUBUK INDONESTA", "REPUBLIK INDONES", "12", "- 15 -", "SK No 1234A"])
def test_furniture(line):
    assert indonesian.is_furniture(line)


@pytest.mark.parametrize("line", ["Presiden mengangkat dan memberhentikan", "Pasal 7", "BAB I", "KETENTUAN UMUM", "KETENTUAN PIDANA", "(1) Presiden", "Republik", "PENYIDIKAN", "PERIZINAN"])
def test_no_furniture(line):
    assert not indonesian.is_furniture(line)


def test_annexes_roman_articles_and_plain_texts():
    assert paths("Pasal I\nsatu\nPasal II\ndua\nLAMPIRAN I\ntabel\nLAMPIRAN II\nformulir") == ["article-1", "article-2", "appendix-i", "appendix-ii"]
    assert indonesian.parse("hanya teks\nbiasa") == [(0, None, "document", 1, "", "hanya teks\nbiasa", "document")] and indonesian.parse("") == [] and indonesian.parse("12\n- 3 -") == []


def test_the_parser_is_a_grammar_for_provisions_and_chunks():
    text = "BAB I\nUMUM\nPasal 1\n(1) Setiap orang berhak atas data pribadi.\n(2) Hak dimaksud dijamin."
    assert provisions.parse(text, "id-scan") == indonesian.parse(text)
    chunks = Chunker(provisions.parse(text, "id-scan"), STYLES["id-scan"], About()).chunks()
    assert [(c[1], c[2]) for c in chunks] == [("Pasal 1", "BAB I UMUM")]


def test_likeness_equals_the_plain_ratio_and_mostly_needs_its_bounds_only(monkeypatch):
    import difflib
    import random

    rng, full = random.Random(3), []
    ratio = difflib.SequenceMatcher.ratio
    monkeypatch.setattr(difflib.SequenceMatcher, "ratio", lambda m: full.append(1) or ratio(m))
    lines = ["".join(rng.choice(h[k] + "AEIOU .") if rng.random() < 0.3 else h[k] for k in range(len(h))) for h in indonesian.LETTERHEADS * 60]
    lines += ["KETENTUAN UMUM", "DENGAN RAHMAT TUHAN", "PENUTUP LAIN"] * 60
    got = [indonesian._like_a_letterhead(x) for x in lines]
    assert len(full) < 0.8 * len(lines) * len(indonesian.LETTERHEADS)
    assert got == [any(ratio(difflib.SequenceMatcher(None, x, h, autojunk=False)) >= indonesian.LIKENESS for h in indonesian.LETTERHEADS) for x in lines]
