"""Trees, references, articles, citations, parsers, mining, repairs, query rewriting and the ledger on small cases."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from corvane.functions import citations as C
from corvane.functions import query as Q
from corvane.functions import registry, repair
from corvane.operators import mining, provisions, references, sections, upsert
from corvane.sources import readers
from corvane.streaming import ledger
from tests.conftest import DATA


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_preorder(spark):
    t = spark.createDataFrame([(1, 1, None, 2), (1, 2, 1, 1), (1, 3, 2, 1), (1, 4, None, 1), (1, 5, 99, 1), (2, 1, None, 1)], "document_id bigint, id bigint, parent_id bigint, ordinal int")
    got = sections.preorder(t).where("document_id = 1").orderBy("path").collect()
    assert [(r.id, r.depth, r.ancestors) for r in got] == [(4, 0, []), (1, 0, []), (2, 1, [1]), (3, 2, [1, 2])]
    with pytest.raises(ValueError):
        sections.preorder(t, depth=1)


def test_articles(spark):
    c = spark.createDataFrame([(1, "a", 1, "lead\nx"), (1, "a", 2, "lead\ny"), (1, "a", 3, None), (1, "b", 1, "z" * 60), (2, "a", 1, "lead")], "document_id int, article string, ordinal int, content string")
    assert rows(sections.articles(c, 50)) == [(1, "a", 3, 7, "lead\nx\ny"), (1, "b", 1, 60, None), (2, "a", 1, 4, "lead")]


def test_resolution(spark):
    refs = spark.createDataFrame([(1, None, "x", ["k9"]), (2, None, None, ["k2", "k1"]), (3, 7, None, ["k1"]), (4, 10, None, ["k1"]), (5, 7, None, ["k2"]), (6, None, None, ["k2"]), (7, 5, None, ["no"]), (8, None, None, [])], "ref_id int, document_id int, alias string, candidates array<string>")
    docs = spark.createDataFrame([("k1", 10), ("k2", 20), ("k2", 21)], "doc_key string, document_id int")
    aliases = spark.createDataFrame([("x", 30), ("y", 1), ("y", 2)], "alias string, document_id int")
    assert [tuple(r) for r in references.resolved(refs, docs, aliases).orderBy("ref_id").collect()] == [(1, 30, "resolved"), (2, 10, "resolved"), (3, 10, "corrected"), (4, 10, "unchanged"), (5, None, "cleared"), (6, None, "ambiguous"), (7, 5, "unmatched"), (8, None, "unmatched")]


def test_related_hits(spark):
    hits = spark.createDataFrame([(1, 1), (2, 2)], "document_id int, rank int")
    rel = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (2, 4), (2, 5)], "from_id int, to_id int")
    binding = spark.createDataFrame([(3,), (4,), (2,)], "document_id int")
    chunks = spark.createDataFrame([(30, 3, 0.3), (31, 3, 0.1), (32, 3, 0.2), (40, 4, 0.1), (50, 5, 0.0)], "chunk_id int, document_id int, distance double")
    assert [tuple(r) for r in references.related_hits(hits, rel, binding, chunks, 2, 10).orderBy("place").collect()] == [(31, 3, 1, 1), (40, 4, 2, 2), (32, 3, 1, 3)]


def test_citations(spark):
    lit = F.lit
    assert one(spark, C.citation_up_to(lit("Chapter 1,  Article 2 , Clause 3"), "Article")) == "Chapter 1, Article 2"
    assert one(spark, C.path_citation(lit("part-I/article-2~3/x"))) == "Part I, Article 2 [3], X"
    assert one(spark, C.chunk_label(lit(" . a   b :"))) == "a b"
    assert [one(spark, C.label_only(lit(x))) for x in ("Điều 5.", "Article 3 Scope", "xi", "")] == [True, False, True, True]
    assert one(spark, C.enacting_date(lit("Hà Nội, ngày 3 tháng 12 năm 2020"))) == dt.date(2020, 12, 3)
    assert [one(spark, C.enacting_date(lit(x))) for x in ("on 5 Mei 2019 and", "31 February 2020", "none")] == [dt.date(2019, 5, 5), None, None]
    months = "January February March April May June July August September October November December".split()
    assert [one(spark, C.enacting_date(lit(f"1 {m} 2001"))).month for m in months] == list(range(1, 13))
    assert one(spark, C.number_variants(lit("Nomor 5  Tahun 2020"))) == ["nomor 5 tahun 2020", "no.5 tahun 2020", "5/2020"]
    assert one(spark, registry.CANONICAL["id"](lit("POJK-9"))) == ["pojk-9"]
    assert [one(spark, C.locally_damaged(lit(x))) for x in ("fine line of text", "Ã¡ Ã© Ã­ damaged", "Ã Ã Ã")] == [False, True, False]
    assert [one(spark, C.titles_match(lit(a), lit(b))) for a, b in (("Policy on Risk", "policy, on RISK"), ("Policy on Risk Management", "Policy on Risk"), ("", ""))] == [True, False, False]
    assert [one(spark, C.diacritic_free(lit(x))) for x in ("thue", "thuế", "Đo")] == [True, False, False]
    df = spark.createDataFrame([(1, 0.5, "t", "extra")], "id int, score double, title string, other string")
    assert [C.detail(df, x).columns for x in ("compact", "standard", "full")] == [["id", "score"], ["id", "score", "title"], df.columns]


@pytest.mark.parametrize(
    ("grammar", "text", "paths"),
    [
        ("vn", "PHỤ LỤC I\nChương I\nĐiều 1. A\n1. b\nđ) c", ["appendix-I", "appendix-I/chapter-I", "appendix-I/chapter-I/article-1", "appendix-I/chapter-I/article-1/clause-1", "appendix-I/chapter-I/article-1/clause-1/point-đ"]),
        ("my", "PART II\n12A. T\n(1) a\n(b) c", ["part-II", "part-II/section-12A", "part-II/section-12A/subsection-1", "part-II/section-12A/subsection-1/paragraph-b"]),
        ("id", "BAB I\nBagian Kedua\nPasal 3\n(2) a\nb. c", ["chapter-I", "chapter-I/part-dua", "chapter-I/part-dua/article-3", "chapter-I/part-dua/article-3/clause-2", "chapter-I/part-dua/article-3/clause-2/point-b"]),
        ("sg", "PART 1\n2.—Short\nDivision 2 — x\n3. y", ["part-1", "part-1/section-2", "part-1/division-2", "part-1/division-2/section-3"]),
        ("th", "หมวด ๒\nมาตรา ๑๕ ก\n(๑) ข", ["chapter-2", "chapter-2/section-15", "chapter-2/section-15/paragraph-1"]),
        ("kh", "ជំពូកទី១\nមាត្រា ២៖ ក", ["chapter-1", "chapter-1/article-2"]),
    ],
)
def test_grammars(grammar, text, paths):
    assert [r[6] for r in provisions.parse(text, grammar)] == paths


def test_dispatch_and_trees(spark):
    d = spark.createDataFrame([(1, "Pasal 3", "id"), (2, "Pasal 3", "th"), (3, None, "vn"), (4, "x", None)], "doc_id int, text string, j string")
    assert [(r.doc_id, r.path) for r in provisions.provisions(d, F.col("j")).orderBy("doc_id").collect()] == [(1, "article-3"), (2, "document"), (4, "document")]
    tree = json.dumps([{"kind": "chapter", "label": "๑", "children": [{"kind": "article", "content": "t"}, {"kind": "article", "label": "1"}, 5]}])
    t = spark.createDataFrame([(1, tree), (2, "{"), (3, None)], "doc_id int, tree string")
    assert [(r.doc_id, r.parent, r.content, r.path) for r in provisions.tree_provisions(t).orderBy("node").collect()] == [(1, None, "", "chapter-1"), (1, 0, "t", "chapter-1/article-1"), (1, 0, "", "chapter-1/article-1~2")]
    main = spark.createDataFrame([(1, "a", "m")], "document_id int, path string, o string")
    assert rows(sections.merged_appendices(main, spark.createDataFrame([(1, "a", "x"), (1, "b", "x")], main.schema))) == [(1, "a", "m"), (1, "b", "x")]


def test_mining(spark):
    text = "Căn cứ Act 9. This replaces 1/2020/AB; it also amends Article 3 of 2/2021/CD.\nThis replaces 1/2020/AB again. See 3/2022"
    d = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")
    assert [(r.number, r.relation, r.target) for r in mining.mined_relations(d).orderBy("start").collect()] == [("act 9", "based_on", None), ("1/2020/ab", "replaces", None), ("2/2021/cd", "amends", "Article 3"), ("3/2022", None, None)]
    p = spark.createDataFrame([(1, '[{"type":"A","number":" 1 "},{"type":"B","number":"2"},{"type":"A"}]'), (2, None)], "doc_id int, json string")
    kinds = spark.createDataFrame([("A", "amends", True)], "code string, label string, trusted boolean")
    assert rows(mining.structured_relations(p, kinds)) == [(1, "1", "amends", True), (1, "2", "B", False)]
    assert mining.superseded_titles("It supersedes the following: (a) Policy on Risk issued on 1 January 2019; and (b) Guide X, dated 3 May 2018.") == [("Policy on Risk", "1 January 2019"), ("Guide X", "3 May 2018")]
    assert mining.base_of("consolidates 2/2021/B and 1/2020/A\n[1] amended by 2/2021/B") == "2/2021/b"
    assert mining.base_of("none") is None


def test_repairs(spark):
    assert repair.without_page_noise("HEAD\nt\n- 1 -\fHEAD\nu\nPage 2 of 9\fHEAD\nin 1999\n\n\n\n\nw") == "t\nu\nin 1999\n\n\nw"
    assert repair.letters_repaired("Cộng hоa Привет e ̂ x� ��") == "Cộng hoa Привет ê x ��"
    assert repair.clusters("ไทย ABC ได้") == ["ไท", "ย", "abc", "ได้"]
    assert "".join(repair.clusters("ประเทศไทยก็ดี")) == "ประเทศไทยก็ดี"
    df = spark.createDataFrame([(bytes("ไทย".encode("cp874")), "a\n- 3 -"), (None, None)], "b binary, t string")
    assert [tuple(r) for r in df.select(repair.decoded_thai("b"), repair.cleaned("t"), registry.NORMALIZERS["th"](F.col("t"))).collect()] == [("ไทย", "a", ["a", "3"]), (None, None, [])]


def test_query_rewriting():
    assert Q.restored("thue thu nhap ca nhan", {"thue": "thuế", "nhap": "nhập"}, {"ca nhan": "cá nhân"}) == "thuế thu nhập cá nhân"
    assert Q.expanded("The AML rule, aml", {"AML": "anti money laundering", "ml": "no"}) == "The AML rule, aml (anti money laundering)"
    assert Q.expanded("none", {"AML": "x"}) == "none"
    assert Q.named_documents("Act 5, 12/2020/NĐ-CP and act 5") == ["12/2020/nđ-cp", "act 5"]
    assert [Q.lexical_weight(x) for x in ("thue", "thuế", "thuế Act 5")] == [1.0, 0.5, 1.0]
    o = Q.Options(top_k=3, other_pass=False).over(Q.Options(top_k=9, doc_cap=1), Q.DEFAULTS)
    assert (o.top_k, o.doc_cap, o.pool, o.other_pass) == (3, 1, 50, False)


def test_writes(spark):
    a = spark.createDataFrame([("r", 5, None), ("s", None, "x")], "ref_key string, document_id int, src_ref string")
    b = spark.createDataFrame([("r", None, "y"), ("t", 1, None)], a.schema)
    assert rows(upsert.pointers(a, b)) == [("r", 5, "y"), ("s", None, "x"), ("t", 1, None)]
    old, new = (spark.createDataFrame(x, "p int, c string") for x in ([(1, "a"), (2, "b"), (3, "c")], [(1, "n"), (9, "z")]))
    assert rows(upsert.replace_children(old, new, "p", spark.createDataFrame([(1,), (2,)], "p int"))) == [(1, "n"), (3, "c")]


def test_state_machine():
    s = ("pending", 0, 0)
    for action, at, want in (("done", 0, "pending"), ("claim", 0, "claimed"), ("claim", 10, "claimed"), ("fail", 20, "error"), ("claim", 30, "error"), ("claim", 320, "claimed"), ("done", 9999, "claimed"), ("claim", 9999, "claimed"), ("done", 10000, "done"), ("claim", 99999, "done"), ("reopen", 99999, "pending")):
        s = ledger.step(*s, action, at)
        assert s[0] == want, (action, at)
    s = ("pending", 0, 0)
    for k in range(5):
        s = ledger.step(*ledger.step(*s, "claim", 10_000 * k), "fail", 10_000 * k + 1)
    assert s[0] == "dead" and ledger.step("error", 1, 9, "supersede", 0)[0] == "superseded"


def test_ledger_stream_equals_batch_and_plain(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    batch = {r.key: tuple(r) for r in ledger.replayed(ledger.actions_of(events)).collect()}
    plain = {}
    for r in sorted(ledger.actions_of(events).collect(), key=lambda r: (r.at, r.id)):
        state, n = plain.get(r.key, (("pending", 0, 0), 0))
        plain[r.key] = ledger.step(*state, r.action, r.at), n + 1
    assert batch == {k: (k, *s, n) for k, (s, n) in plain.items()}
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(DATA)
    q = ledger.tracked(ledger.actions_of(stream)).writeStream.outputMode("update").format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.key: tuple(r) for r in spark.table("tracked").orderBy("events").collect()} == batch


def test_discovery_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    item = {"source": "s", "external_id": "1", "published": "2024-01-01T00:00:00Z"}
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, (item, item, {**item, "external_id": "2"}))))
    q = readers.discovered(spark, str(tmp_path / "in"), "source string, external_id string, published timestamp").writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.external_id for r in spark.table("found").collect()) == ["1", "2"]


def test_family_collapse_against_plain(spark):
    from corvane.plans import derived, evidence

    hits = evidence._hits(spark, DATA).collect()
    edges = evidence._relation(spark, DATA).collect()
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    best = {}
    for h in sorted(hits, key=lambda h: (-h.score, h.id)):
        best.setdefault(find(h.id) if h.id in root else h.id, h.id)
    assert {r.family: r.id for r in derived.r11_family_collapse(spark, DATA).collect()} == best
