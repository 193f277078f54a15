"""Chunks of trees: budgets, leads, citations, repeats, fallbacks; and of tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corvane.operators import chunker, provisions
from corvane.operators.chunker import STYLES, About, Chunker


def cut(text, grammar="common", about=About(), **bounds):  # noqa: B008
    return [(c[1], c[3]) for c in Chunker(provisions.parse(text, grammar), STYLES[grammar], about, **bounds).chunks()]


def test_an_article_that_fits_is_one_chunk():
    assert cut("Article 1. Scope\nThis law applies to banks.\n1. one\na) point") == [("Article 1", "Article 1. Scope\nThis law applies to banks.\n1. one\na) point")]


def test_long_articles_are_led_by_their_own_text():
    text = f"Article 7. Rules\nBanks shall:\n1. {'alpha ' * 20}\n2. {'beta ' * 5}:\na) {'gamma ' * 20}\nb) {'delta ' * 20}"
    got = cut(text, most=100)
    lead = "Article 7. Rules\nBanks shall:"
    assert [c for c, _ in got] == ["Article 7, Clause 1", "Article 7, Clause 2, Point a", "Article 7, Clause 2, Point b"]
    assert got[0][1] == f"{lead}\n1. {('alpha ' * 20).strip()}"
    assert got[2][1] == f"{lead}\n2. {'beta ' * 5}:\nb) {('delta ' * 20).strip()}"


def test_a_bare_label_leads_nothing():
    got = cut("Pasal 8\n(1) " + "kata " * 30 + "\n(2) " + "lain " * 30, "id", most=90)
    assert got == [("Pasal 8, ayat (1)", "(1) " + ("kata " * 30).strip()), ("Pasal 8, ayat (2)", "(2) " + ("lain " * 30).strip())]


def test_leaves_are_cut_at_lines_then_words():
    got = cut(f"Article 1. Long\n{'a' * 50}\n{'b' * 50}\n{' '.join(f'word{k}' for k in range(60))}", most=40)
    assert [c for c, _ in got] == [f"Article 1, Paragraph {k}" for k in range(1, len(got) + 1)]
    assert all(chunker.tokens(x) <= 40 for _, x in got) and "".join(x for _, x in got).count("word") == 60


@pytest.mark.parametrize("most", [1, 3, 10, 40])
def test_passages_keep_all_words_within_the_budget(most):
    text = "one two three\n\nfour five six seven eight nine ten\n" + "longer words here " * 9
    parts = chunker.passages(text, most)
    assert " ".join(parts).split() == text.split()
    assert all(chunker.tokens(p) <= most or " " not in p for p in parts)


def test_repeated_numbers_name_their_containers():
    text = "\n".join(f"Chương {c}. Chung\nĐiều {n}. Quy định số {c} {n} của ngân hàng" for c, n in (("I", 1), ("I", 2), ("II", 1)))
    assert [c for c, _ in cut(text, "vn")] == ["Chương I, Điều 1", "Điều 2", "Chương II, Điều 1"]
    twice = "Điều 1. Sửa đổi các nội dung\n1. " + "một " * 300 + "\n1. " + "hai " * 300
    assert [c for c, _ in cut(twice, "vn", most=400)] == [f"Điều 1, Khoản 1, Đoạn {k}" for k in (1, 2, 3)] + [f"Điều 1, Khoản 1, Đoạn 2, Đoạn {k}" for k in (2, 3)]


def test_appendices():
    text = "Điều 1. Ban hành quy chế kèm theo đây\nPhụ lục I\nBảng biểu mẫu số liệu báo cáo\nĐiều 1. Nội dung của quy chế này\nPhụ lục II\nMẫu đơn đề nghị cấp phép"
    got = cut(text, "vn")
    assert [c for c, _ in got] == ["Điều 1", "Phụ lục I", "Phụ lục I, Điều 1", "Phụ lục II"]


def test_equal_contents_once_and_short_ones_never():
    long = "the same words in both parts"
    got = cut(f"Chapter I. A\nArticle 1. {long}\nArticle 2. tiny\nChapter II. B\nArticle 1. {long}")
    assert got == [("Chapter I, Article 1", f"Article 1. {long}")]


def test_documents_without_articles():
    assert [c for c, _ in cut("Chapter I. A\n1. first clause of some length\n2. second clause of some length")] == ["Chapter I, Clause 1", "Chapter I, Clause 2"]
    assert [c for c, _ in cut("Chapter I. heading with some length\nChapter II. another heading with length")] == ["Chapter I", "Chapter II"]
    assert cut("only a plain text of some length") == [("", "only a plain text of some length")] and cut("") == []
    assert [c for c, _ in cut(" ".join(f"word{k}" for k in range(25)), most=50)] == ["Paragraph 1", "Paragraph 2"]


def test_prefixes():
    c = Chunker(provisions.parse("PART I. General\nSECTION 2. Duties\nArticle 3. Something to be done here"), STYLES["common"], About("1/2020", "t" * 300, "05/03/2020")).chunks()[0]
    assert c[2] == f"1/2020: {'t' * 217}...\nPart I General\nSection 2 Duties\nEffective: 05/03/2020" and c[4] == len(f"{c[2]}\n{c[3]}") // 2


def test_deep_trees_need_no_recursion():
    rows = [(k, k - 1 if k else None, "article" if k == 0 else "clause", 1, str(k), "some text here that counts", f"p{k}") for k in range(5000)]
    got = Chunker(rows, STYLES["common"], About()).chunks()
    assert sum(x[3].count("some text") for x in got) >= 5000


def test_tables(spark):
    text = f"Article 1. Scope\nThis law applies to banks.\nArticle 2. Rules\n1. {'alpha ' * 200}\n2. {'beta ' * 200}"
    docs = spark.createDataFrame([(1, text, "1/2020", None, dt.date(2020, 3, 5)), (2, None, None, "t", None), (3, "", None, None, None), (1, text, "1/2020", None, dt.date(2020, 3, 5))], "doc_id bigint, text string, doc_number string, title string, effective_at date").withColumn("node", F.lit("x"))
    whole = chunker.text_chunks(docs)
    rows = whole.orderBy("ordinal").collect()
    assert {r.doc_id for r in rows} == {1} and len(rows) == 2 * len({r.citation for r in rows})
    assert rows[0].prefix == "1/2020\nEffective: 05/03/2020"
    once = docs.dropDuplicates(["doc_id"])
    stored = chunker.section_chunks(provisions.provisions(once), once)
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert key(stored) == key(chunker.text_chunks(once))
    assert chunker.text_chunks(docs.where("doc_id > 9")).count() == 0
