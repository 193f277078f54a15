"""Scores of question sets: matching of citations, metrics, coverage, and a set searched over a small corpus."""

import pytest
from pyspark.sql import functions as F

from corvane.functions.query import Options
from corvane.operators import evaluation as E
from corvane.operators.evaluation import Matcher
from corvane.sources.readers import _GOLDEN
from tests.test_search import corpus, unit  # noqa: F401


def cite(number, article=None, clause=None, point=None, relation_ok=None, others=None):
    return (number, article, clause, point, relation_ok, others)


def cases(spark, *rows):
    return spark.createDataFrame([(i, f"question {i}", list(c), a, f, None) for i, c, a, f in rows], _GOLDEN)


HITS = "case_id string, place int, document_id bigint, doc_number string, citation string, status_class string"


def test_numbers(spark):
    pairs = [("Peraturan Otoritas Jasa Keuangan Nomor 21 Tahun 2023", "POJK 21/2023", True), ("50/2024/TT-NHNN", " 50/2024/tt-nhnn ", True), ("1/2020", "11/2020/AB", True), ("Undang-Undang No. 4 Tahun 2023", "UU 4/2023", True), ("", "1", False), ("", "", True), ("NOVA 1", "VA 1", True), ("2/2020", "3/2020", False)]
    df = spark.createDataFrame(pairs, "a string, b string, same boolean")
    assert df.where(E.same_number(F.col("a"), F.col("b")) != F.col("same")).count() == 0


@pytest.mark.parametrize(("citation", "word", "label", "held"), [("Chapter I, Article 5, Clause 2", "article", "5", True), ("Article 15", "article", "5", False), ("ARTICLE (5).", "article", "5", True), ("Section 5, (6), (a)", "", "6", True), ("Section 5(6)", "", "6", False), ("Article 5", "clause", "1", False), ("Article 5", "clause", "", True), (None, "article", "1", False), ("Article", "article", "1", False)])
def test_citations(spark, citation, word, label, held):
    row = spark.createDataFrame([(citation, label)], "c string, l string").select(E.cites(F.col("c"), word, F.col("l"))).first()
    assert row[0] is held


def test_scores_and_metrics(spark):
    c = cases(spark, ("a", [cite("1/2020", "5"), cite("2/2020")], False, False), ("b", [cite("9/2020", relation_ok=True)], False, False), ("c", [], True, False), ("d", [cite("1/2020")], False, True), ("e", [cite("7/2020", others=["1/2020"])], None, None))
    rows = [("a", 1, 3, "3/2020", "Article 1", "in_force"), ("a", 2, 1, "1/2020", "Article 6", "in_force"), ("a", 3, 1, "1/2020", "Article 5, Clause 1", "expired"), ("a", 4, 2, "2/2020", None, "partial"), ("a", 5, 4, "4/2020", None, "expired"), ("b", 1, 1, "1/2020", "Article 1", "expired"), ("d", 1, 1, "1/2020", None, "in_force"), ("e", 1, 3, "3/2020", None, None), ("e", 2, 1, "1/2020", None, "in_force")]
    hits = spark.createDataFrame(rows, HITS)
    related = spark.createDataFrame([(1, "9/2020")], "document_id bigint, doc_number string")
    abstained = spark.createDataFrame([("c",), ("b",)], "case_id string")
    pool = spark.createDataFrame([*rows, ("b", 2, 9, "9/2020", None, None)], HITS)
    got = {r.case_id: r for r in E.diagnosis(E.scored(c, hits, abstained, Matcher(), related, pool)).collect()}
    assert [(k, got[k].recall_hits, got[k].recall_want, got[k].rank, got[k].hits_in_force, got[k].hits_total) for k in "abcde"] == [("a", 2, 2, 3, 3, 4), ("b", 1, 1, 1, 0, 1), ("c", 0, 0, None, 0, 0), ("d", 1, 1, 1, 1, 1), ("e", 1, 1, 2, 1, 2)]
    assert {k: got[k].abstain_correct for k in "abcde"} == {"a": True, "b": False, "c": True, "d": True, "e": True}
    without = E.scored(c, hits, abstained, Matcher(), None, pool)
    assert {r.case_id: r.failure for r in E.diagnosis(without).collect()}["b"] == "ranking"
    m = E.summary(E.scored(c, hits, abstained, Matcher(), related)).first()
    assert (m.cases, m.expect_fail_cases, m.gap_pass_cases, m.recall_cases, m.in_force_cases, m.pool_cases) == (5, 1, 1, 3, 3, 0)
    assert m.recall == 1.0 and abs(m.mrr - (1 / 3 + 1 + 1 / 2) / 3) < 1e-12 and abs(m.in_force_precision - 4 / 7) < 1e-12 and m.abstain_accuracy == 0.75 and m.pool_recall == 0
    lines = {r.case_id: r.line for r in E.report_lines(E.scored(c, hits, abstained)).collect()}
    assert lines["a"].startswith("ok  ") and lines["b"].startswith("MISS") and "abstain WRONG" in lines["b"]
    nothing = E.summary(E.scored(c.where("id = 'z'"), hits, abstained)).first()
    assert nothing.cases == 0 and nothing.recall == 0 and nothing.abstain_accuracy == 0


def test_a_set_over_a_corpus(spark, corpus):  # noqa: F811
    c = cases(spark, ("a", [cite("1/2020/ab", "1")], False, False), ("b", [cite("2/2020/AB")], False, False), ("c", [], True, False), ("d", [cite("77/2020")], False, True))
    c = c.withColumn("question", F.when(F.col("id") == "c", "weather tomorrow").otherwise("reserve ratio"))
    vectors = spark.createDataFrame([("a", unit(0)), ("b", unit(0)), ("d", unit(0))], "id string, vector array<float>")
    got = {r.case_id: r for r in E.evaluate(corpus, c, vectors, Options(top_k=3), pool_k=20).collect()}
    assert got["a"].recall_hits == 1 and got["b"].recall_hits == 1 and got["c"].abstained and got["c"].abstain_correct and got["d"].recall_hits == 0
    assert all(got[k].pool_hits >= 1 or k == "b" for k in "ab")
    state = {r.doc_number: r.state for r in E.coverage(c, corpus).collect()}
    assert state == {"1/2020/ab": "indexed", "2/2020/ab": "indexed", "77/2020": "missing"}


def test_words_of_many_questions_are_cut_where_they_are_scored(spark):
    from pyspark.sql import functions as F

    from corvane.operators import retrieval

    docs = spark.range(600, numPartitions=2).select("id", F.concat_ws(" ", F.lit("the"), F.concat(F.lit("w"), F.col("id") % 7), F.concat(F.lit("v"), F.col("id") % 70)).alias("content"))
    groups = [("the", f"w{k % 7}", f"v{k}") for k in range(70)]
    counts = retrieval.term_counts(docs, sorted({t for g in groups for t in g}), "id", "content")
    assert counts.unique() and not retrieval.Counts(counts.table.unionByName(counts.table), counts.terms).unique()
    got = retrieval.best_by_words(counts, groups, [3] * 70)
    # every document has a word of every group: 42,000 pairs
    assert got.count() <= 6 * 70 * counts.table.rdd.getNumPartitions()
    for g in (0, 33):
        best = [tuple(r) for r in got.where(F.col("group") == g).orderBy(F.desc("score"), "id").limit(3).select("id", "score").collect()]
        plain = retrieval.bm25(docs, list(groups[g]), "id", "content").select("id", F.round("score", 9).alias("score"))
        assert best == [tuple(r) for r in plain.orderBy(F.desc("score"), "id").limit(3).collect()]
    few = spark.createDataFrame([(0, 5), (0, 590), (1, 6)], "group int, id bigint")
    assert {(r.group, r.id) for r in retrieval.best_by_words(counts, groups[:2], [3, 3], few).collect()} == {(0, 5), (0, 590), (1, 6)}
