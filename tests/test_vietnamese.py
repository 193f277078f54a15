"""Vietnamese texts: emphasis, references, quotations, appendices, outlines, repeats."""

import pytest

from corvane.operators import provisions, vietnamese


def paths(text):
    return [r[6] for r in vietnamese.parse(text)]


def test_a_statute():
    text = "NGÂN HÀNG NHÀ NƯỚC\nPhần thứ nhất\nChương I\nQUY ĐỊNH CHUNG\nMục 1. Phạm vi\nĐiều 1.\nPhạm vi điều chỉnh\n1. Thông tư này.\na) một;\nđ) năm.\n2. Hai\nĐiều 21b. Chèn thêm\nChương II\nĐIỀU 2: Khác"
    rows = vietnamese.parse(text)
    assert [r[6] for r in rows] == ["part-thứ nhất", "part-thứ nhất/chapter-I", "part-thứ nhất/chapter-I/section-1", "part-thứ nhất/chapter-I/section-1/article-1", "part-thứ nhất/chapter-I/section-1/article-1/clause-1", "part-thứ nhất/chapter-I/section-1/article-1/clause-1/point-a", "part-thứ nhất/chapter-I/section-1/article-1/clause-1/point-đ", "part-thứ nhất/chapter-I/section-1/article-1/clause-2", "part-thứ nhất/chapter-I/section-1/article-21b", "part-thứ nhất/chapter-II", "part-thứ nhất/chapter-II/article-2"]
    assert rows[3][5] == "Phạm vi điều chỉnh" and rows[1][5] == "QUY ĐỊNH CHUNG" and rows[10][5] == "Khác"


@pytest.mark.parametrize("line", ["**Điều 1.** Phạm vi", "## Điều 1. Phạm vi", "**Điều 1. Phạm vi**", "Điều 1. Phạm vi", "Điều  1.  Phạm vi", "\u00a0Điều\u00a01.\u202fPhạm vi", "*Điều 1. Phạm vi*"])
def test_emphasis_and_blanks(line):
    assert vietnamese.parse(f"{line}\nnội dung") == [(0, None, "article", 1, "1", "Phạm vi\nnội dung", "article-1")]


@pytest.mark.parametrize("line", ["Điều 5 của Luật này quy định", "Điều kiện kinh doanh", "Chương trình hành động", "Mục lục", "theo Phụ lục 01 ban hành kèm theo", "Phụ lục 01 ban hành kèm theo Thông tư này"])
def test_references_are_text(line):
    rows = vietnamese.parse(f"Điều 4. Theo\n{line}\nĐiều 5. Sau")
    assert [r[6] for r in rows] == ["article-4", "article-5"] and rows[0][5] == f"Theo\n{line}"


@pytest.mark.parametrize("quote", ["“Điều 9. Cũ\n1. một\n2. hai”", '"Điều 9. Cũ\n1. một\n2. hai"', "như sau: “\nĐiều 9. Cũ\n1. một”"])
def test_quoted_provisions_are_text(quote):
    rows = vietnamese.parse(f"Điều 1. Sửa đổi\n1. Sửa Điều 9 như sau:\n{quote}\n2. Bãi bỏ\nĐiều 2. Hiệu lực")
    assert [r[6] for r in rows] == ["article-1", "article-1/clause-1", "article-1/clause-2", "article-2"] and "Điều 9. Cũ" in rows[1][5]


def test_appendices_close_articles_and_hold_their_own():
    rows = vietnamese.parse("Điều 1. Ban hành\nPHỤ LỤC I DANH MỤC\nbảng\nPhụ lục số 2\nChương I\nĐiều 1. Trong phụ lục")
    assert [r[6] for r in rows] == ["article-1", "appendix-I", "appendix-2", "appendix-2/chapter-I", "appendix-2/chapter-I/article-1"] and rows[1][5] == "DANH MỤC\nbảng"


def test_outlines():
    text = "Thông tư hướng dẫn\nI. QUY ĐỊNH CHUNG\n1. Đối tượng\n1.1. Tổ chức\na) loại một\n1.2. Cá nhân\n2. Phạm vi\nII - TỔ CHỨC\nA. Trung ương\n1. Bộ"
    assert paths(text) == ["chapter-I", "chapter-I/clause-1", "chapter-I/clause-1/clause-1.1", "chapter-I/clause-1/clause-1.1/point-a", "chapter-I/clause-1/clause-1.2", "chapter-I/clause-2", "chapter-II", "chapter-II/section-A", "chapter-II/section-A/clause-1"]


def test_repeats_lists_before_articles_and_plain_texts():
    assert paths("1. Căn cứ\n2. Xét\nĐiều 1. Một\n1. a b\n1. c d") == ["article-1", "article-1/clause-1", "article-1/clause-1~2"]
    assert vietnamese.parse("chỉ có văn bản\nthường") == [(0, None, "document", 1, "", "chỉ có văn bản\nthường", "document")] and vietnamese.parse(" \n") == []
    assert provisions.parse("Điều 1. Một", "vn-text") == vietnamese.parse("Điều 1. Một")
