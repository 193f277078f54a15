"""The quality gate, placeholders, HTML and the postings index over small cases."""

import pytest
from pyspark.sql import functions as F

from corvane.functions import quality, repair
from corvane.functions.html import text_of
from corvane.functions.text import repeats_a_word
from corvane.operators import provisions, retrieval, workflow
from corvane.sources import readers, sinks
from corvane.storage import shared_folder

LAW = "Điều 3. Tổ chức tín dụng phải công bố lãi suất cho vay bình quân. "


def assessed(spark, *texts, gate=quality.Gate()):  # noqa: B008
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r.a for r in df.select("k", quality.assess(F.col("t"), gate).alias("a")).orderBy("k").collect()]


def test_gate(spark):
    good, nothing, null, private, marks, slavic, lost, plain, blank, few, stray = assessed(
        spark, LAW * 8, "", None, LAW + "" * 40, "NG√ÇN H√ÄNG NH√Ä N∆Ø·ªöC " * 10, "Дҗiб»Ғu mб»ҷt hai ba bб»‘n " * 10, "lost � " * 30, "no accents in this text at all " * 12, "ab " * 20 + " " * 300, "Điều 1", LAW * 8 + "Ж"
    )
    assert (good.ok, good.reason, good.confidence) == (True, "", 1.0)
    assert [(x.ok, x.reason, x.confidence) for x in (nothing, null)] == [(False, "empty text", 0.0)] * 2
    assert not private.ok and "PUA" in private.reason
    assert not marks.ok and "mojibake markers" in marks.reason
    assert not slavic.ok and "Cyrillic" in slavic.reason and stray.ok
    assert not lost.ok and "bad chars" in lost.reason
    assert not plain.ok and plain.reason == "low diacritic density" and plain.confidence == pytest.approx(0.5)
    assert not blank.ok and "high whitespace" in blank.reason
    assert not few.ok and few.reason == "too few letters"
    # accents as marks of their own count as accented letters, too
    import unicodedata

    assert assessed(spark, unicodedata.normalize("NFD", LAW * 8))[0].ok


def test_gate_of_settings(spark):
    g = quality.Gate.of_settings({"extract.pdf.min_letters": " 5 ", "extract.pdf.pass_threshold": "high", "other": "1", "extract.pdf.max_scan_image_ratio": "0.5"})
    assert (g.min_letters, g.pass_threshold, g.max_scan_image_ratio) == (5, 0.6, 0.5)
    assert assessed(spark, "Điều một", gate=g)[0].ok
    df = spark.createDataFrame([(0, 0), (10, 4), (10, 5)], "probed int, images int")
    assert [r.s for r in df.select(g.scan_layer_suspect(F.col("probed"), F.col("images")).alias("s")).collect()] == [False, False, True]


def test_placeholders(spark):
    texts = ["Đang cập nhật file đính kèm", "ĐANG CẬP  NHẬT\nnội dung", LAW * 8 + "đang cập nhật file", "", "  \n", None, "Luật"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    rows = df.select("k", quality.official_placeholder(F.col("t")).alias("p"), quality.source_unavailable(F.col("t")).alias("u")).orderBy("k").collect()
    assert [r.p for r in rows] == [True, True, False, False, False, False, False]
    assert [r.u for r in rows] == [True, True, False, True, True, True, False]


def test_repeated_words(spark):
    texts = ["khoản khoản 2", "the (The book", "a a", "one two one", "data data2", "predata data", "end. end"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    assert [r.x for r in df.select("k", repeats_a_word(F.col("t")).alias("x")).orderBy("k").collect()] == [True, True, False, False, False, False, False]


@pytest.mark.parametrize(
    "html, text",
    [
        ("<html><head><title>x</title><body><p>hi<p>there", "hi\nthere"),
        ("<p>1<p>2<div>3</div>4", "1\n2\n3\n4"),
        ("<table><tr><td>1<td>2<tr><td>3</table>x", "1 2\n3\n\nx"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nbc\n\nd"),
        ("<div><script>x()</script></div>", ""),
        ("<p>a<br/>b</br>c</p>", "a\nb\nc"),
        ("<nav>a</nav><span>b</span><header>c</header>", "abc"),
        ("<body><noscript>n</noscript><p>é &lt;   f</body>", "é < f"),
        ("plain < text", "plain < text"),
        (None, ""),
    ],
)
def test_html(html, text):
    assert text_of(html) == text


def test_a_quotation_that_nobody_closes():
    rows = provisions.parse("Điều 1. Một\nsửa “nội dung\nĐiều 2. Hai\nĐiều 3. Ba\nthay “như sau:\nĐiều 9. trích\n”\nĐiều 4. Bốn")
    assert [r[4] for r in rows] == ["1", "2", "3", "4"]


def test_postings(spark, sf_dir):
    docs = spark.createDataFrame([(1, "The law, the Law"), (2, "a law of the sea"), (2, "sea"), (3, None), (4, ""), (5, "lawless")], "doc_id bigint, text string")
    path = retrieval.build_postings(docs, shared_folder(spark), buckets=4)
    for query in (["law"], ["the", "law", "the"], ["sea", "nothing"], ["nothing"], []):
        plain = {r.id: round(r.score, 9) for r in retrieval.bm25(docs.fillna({"text": ""}), query).collect()}
        assert {r.id: round(r.score, 9) for r in retrieval.search_postings(spark, path, query).collect()} == plain
    plan = retrieval.search_postings(spark, path, ["law"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:80]


def test_workflow(spark):
    kind = "array<struct<doc_number:string,article:string>>"
    cases = spark.createDataFrame([("a", [("12/2020", "5"), ("13/2020", None)], True, False), ("b", [], False, True), ("c", [("1", "")], None, None)], f"id string, final_citations {kind}, must_check_relations boolean, expect_abstain boolean")
    runs = [("a", [(" 12/2020 ", "6"), ("13/2020", "1")], False, ["search", "document", "search"]), ("b", [], True, []), ("c", None, None, None), ("z", [], True, [])]
    s = workflow.scored(cases, spark.createDataFrame(runs, f"case_id string, cited {kind}, abstained boolean, tools array<string>"))
    got = {r.case_id: (r.citation_score, r.abstain_correct, r.followed_relations, r.tool_calls, r.searches, r.documents) for r in s.collect()}
    assert got == {"a": (0.5, True, True, 3, 2, 1), "b": (1.0, True, True, 0, 0, 0), "c": (0.0, True, True, 0, 0, 0)}
    assert tuple(workflow.summary(s).first()) == (3, 0.5, 1.0, 1.0, 1.0)
    assert tuple(workflow.summary(s.limit(0)).first()) == (0, 0.0, 0.0, 0.0, 0.0)


def test_question_sets(spark, tmp_path):
    import json

    good = {"id": "1", "question": "q", "expected_citations": [{"doc_number": "12/2020", "relation_ok": True, "alt_doc_numbers": ["x"]}], "expect_abstain": False}

    def load(cases):
        (tmp_path / "g.json").write_text(json.dumps(cases, indent=1))
        return readers.golden(spark, str(tmp_path / "g.json")).collect()

    row = load([good, {"id": "2", "question": "r", "expect_abstain": True, "expect_fail": True}])[0]
    assert row.expected_citations[0].alt_doc_numbers == ["x"] and row.expected_citations[0].relation_ok
    cited = lambda **e: {**good, "expected_citations": [e]}
    for bad in ([], [good, good], [{**good, "id": ""}], [{**good, "question": None}], [{**good, "typo": 1}], [cited(doc_number="a", artcle="b")], [cited(article="5")], [{**good, "expected_citations": []}]):
        with pytest.raises(ValueError):
            load(bad)


def test_reports(spark, tmp_path):
    words = spark.createDataFrame([("thue", "thuế", 0.98765), ("luat", "luật", 1.0)], "folded string, form string, share double")
    sinks.write_dictionary(words, str(tmp_path / "d"))
    assert "".join(p.read_text() for p in (tmp_path / "d").glob("*.csv")) == "folded,form,share\nluat,luật,1.0\nthue,thuế,0.9877\n"
    sinks.write_report(spark.createDataFrame([("b", 1.0), ("a", 0.5)], "case_id string, score double"), str(tmp_path / "r"))
    assert "".join(p.read_text() for p in (tmp_path / "r").glob("*.json")).startswith('{"case_id":"a"')
    metrics = {"recall": 0.8, "mrr": 0.5, "abstention": 1.0}
    low = sinks.missed(metrics, {"recall": 0.9, "mrr": 0.9, "abstention": 0}, {"recall": 3, "mrr": 0, "abstention": 3})
    assert low == [("recall", 0.8, 0.9)] and "below threshold: recall 0.800 < 0.900" in sinks.report(metrics, low)
    left = [3, 2, 0, 5]
    assert sinks.rounds(lambda: left.pop(0), 6) == 3 and sinks.rounds(lambda: 1, 4) == 4


def test_postings_read_each_text_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def text(k):
        seen.add(1)
        return f"the w{k % 3} the v{k}" if k else None

    docs = spark.range(40, numPartitions=2).select(F.col("id").alias("doc_id"), F.udf(text, "string").asNondeterministic()("id").alias("text"))
    path = retrieval.build_postings(docs, shared_folder(spark), buckets=2)
    assert seen.value == 40
    assert spark.read.parquet(f"{path}/postings").where("term = 'the' and f = 2 and dl = 4").count() == 39
    assert [tuple(r) for r in spark.read.parquet(f"{path}/statistics").collect()] == [(40, 3.9, 2)]


def test_repairs_hold_few_texts_as_python_objects():
    import tracemalloc

    import pyarrow as pa

    texts = pa.array([None, *(f"{k} " + "text " * 4000 for k in range(1500))])
    tracemalloc.start()
    got = repair.cleaned.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 30 MB of text, 1.3 MB of it at a time
    assert len(got) == 1501 and got[0].as_py() is None and got[1500].as_py() == texts[1500].as_py().rstrip() and peak < 10 << 20
