"""The search over a small corpus: validity, scope, filters, arms, roll-up, promotion, gaps."""

import datetime as dt

import pytest

from corvane.functions.query import Options
from corvane.operators import search as search_module
from corvane.operators.retrieval import build_postings
from corvane.operators.search import Corpus, Filters, search
from corvane.plans import searching
from corvane.storage import shared_folder


def unit(k, n=8):
    return [1.0 if i == k else 0.0 for i in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    statuses = {1: "in_force", 2: "expired", 3: "partial", 4: "in_force", 5: None, 6: "expired"}
    document = spark.createDataFrame([(i, f"{i}/2020/AB", f"title {i}", "Central Bank" if i < 4 else "Ministry", "act" if i % 2 else "rule", dt.date(2010 + i, 1, 1)) for i in statuses], "id bigint, doc_number string, title string, issuer string, doc_type string, issued_at date")
    chunks = [(10, 1, "Chapter 1, Article 1", "reserve ratio of banks"), (11, 1, "Chapter 1, Article 1, Clause 1", "the reserve ratio is set"), (12, 1, "Chapter 1, Article 2", "ratio"), (13, 1, "Chapter 1, Article 3", "reserve"), (14, 1, "Chapter 1, Article 4", "reserve of ratio"), (20, 2, "Article 1", "reserve ratio of old"), (30, 3, "Article 1", "reserve ratio in part"), (40, 4, "Article 9", "lending rules"), (50, 5, "Article 1", "reserve ratio unknown"), (60, 6, "Article 1", "nothing")]
    chunk = spark.createDataFrame(chunks, "id bigint, document_id bigint, citation string, content string")
    vectors = spark.createDataFrame([(10, unit(0)), (20, unit(0)), (30, unit(0)), (40, unit(1)), (50, unit(0)), (60, [0.2] + [0.0] * 6 + [1.0]), (12, None)], "id bigint, embedding array<float>")
    validity = spark.createDataFrame([(i, s) for i, s in statuses.items() if s], "document_id bigint, status_class string")
    relation = spark.createDataFrame([(1, 2), (3, None)], "from_id bigint, to_id bigint")
    text = spark.createDataFrame([(1, True, False), (3, False, True)], "document_id bigint, is_binding boolean, needs_review boolean")
    return Corpus(document, chunk, validity, vectors, relation, text, abbreviations={"RR": "reserve ratio"}, scope=(["reserve ratio"], ["lending"], ["rules"]))


def found(result):
    return [(r.document_id, r.badge) for r in result.hits.orderBy("place").collect()]


def kinds(result):
    return {(r.kind, r.document_id) for r in result.gaps.collect()}


def test_current_law_leads_and_expired_law_is_badged(corpus):
    r = search(corpus, "reserve ratio", unit(0))
    hits = found(r)
    assert hits[0][0] in (1, 3) and {d for d, b in hits if b == ""} == {1, 3, 4}
    assert (2, "expired") in hits and hits.index((2, "expired")) > max(k for k, h in enumerate(hits) if h[1] == "")
    assert 5 not in dict(hits) and not r.abstain()
    assert 2 not in dict(found(search(corpus, "reserve ratio", unit(0), Options(other_pass=False))))
    everything = dict(found(search(corpus, "reserve ratio", unit(0), Options(in_force_only=False))))
    assert everything[2] == "expired" and everything[5] == "unknown"


def test_words_alone(corpus, spark):
    hits = search(corpus, "reserve ratio").hits.orderBy("place").collect()
    assert {h.document_id for h in hits} == {1, 3} and all(h.similarity is None for h in hits)
    path = build_postings(corpus.chunk, shared_folder(spark), "id", "content", buckets=3)
    from dataclasses import replace

    indexed = search(replace(corpus, postings=path), "reserve ratio").hits.orderBy("place").collect()
    assert [(h.id, h.score) for h in indexed] == [(h.id, h.score) for h in hits]
    assert found(search(corpus, "rr")) == found(search(corpus, "rr (reserve ratio)"))  # abbreviations are spelled out


def test_roll_up_cap_and_limit(corpus):
    hits = search(corpus, "reserve ratio", options=Options(top_k=3, doc_cap=1)).hits.orderBy("place").collect()
    of_one = [h.citation for h in hits if h.document_id == 1]
    assert hits[1].document_id == 3 and len(hits) == 3 and len(of_one) == 2  # one of each document first, then back-fill
    every = search(corpus, "reserve ratio", options=Options(top_k=8, doc_cap=8)).hits.collect()
    articles = [h.citation.split(", Clause")[0] for h in every if h.document_id == 1]
    assert len(articles) == len(set(articles)) == 4


def test_named_documents(corpus):
    r = search(corpus, "reserve ratio in 2/2020/AB", unit(0))
    assert found(r) == [(2, "expired")]
    assert found(search(corpus, "reserve ratio in 2/2020/AB", unit(0), Options(in_force_only=True))) == []
    assert {d for d, _ in found(search(corpus, "reserve ratio in 99/2020/XY", unit(0)))} >= {1, 3}  # a number that nobody has


def test_filters(corpus):
    def documents(**f):
        return {d for d, _ in found(search(corpus, "reserve ratio lending", unit(0), Options(in_force_only=False), Filters(**f)))}

    assert documents(issuers=("central",)) == {1, 2, 3} and documents(excluded_issuers=("Central Bank",)) <= {4, 5, 6}
    assert documents(doc_types=("ACT",)) == {1, 3, 5} and documents(numbers=("3/2020/ab",)) == {3}
    assert documents(issued_from="2012-06-01", issued_to="2013-06-01") == {3}
    assert documents(citation="article 9") == {4} and documents(issuers=("100%",)) == set()


def test_gaps(corpus):
    r = search(corpus, "reserve ratio", unit(0))
    assert {("partial_uncertain", 3), ("needs_review", 3), ("no_binding_text", 3), ("unresolved_relation", 3), ("no_binding_text", 2)} <= kinds(r)
    assert ("no_binding_text", 1) not in kinds(r)
    nothing = search(corpus, "reserve ratio zebra", None, filters=Filters(issuers=("none",)))
    assert ("no_evidence", None) in kinds(nothing) and nothing.abstain()
    outside = search(corpus, "weather lending", unit(0))
    assert ("out_of_domain", None) in kinds(outside) and outside.abstain()
    assert ("out_of_domain", None) not in kinds(search(corpus, "lending rules", unit(1)))
    weak = search(corpus, "reserve ratio zebra", [0.1] + [0.0] * 4 + [1.0, 0.0, 0.0])
    assert ("low_confidence", None) in kinds(weak) and weak.abstain()
    unknown = search(corpus, "reserve ratio", unit(0), Options(in_force_only=False))
    assert ("validity_unknown", 5) in kinds(unknown)


def test_lists_that_are_cut_are_completed(corpus, monkeypatch):
    from corvane.operators import search as module

    small = Options(top_k=2, pool=2)
    asked = [module.Question(0, "reserve ratio", unit(0), small), module.Question(1, "reserve ratio", unit(1), small, Filters(issuers=("ministry",))), module.Question(2, "ratio in 2/2020/AB", unit(0), small)]
    monkeypatch.setattr(module, "OVERFETCH", 1)
    found = []
    for wide in (1, 1000):
        monkeypatch.setattr(module, "WIDE", wide)
        found.append(sorted(tuple(r) for r in module.search_many(corpus, asked).hits.drop("content").collect()))
    assert found[0] == found[1] and {r[3] for r in found[0] if r[0] == 2} == {2}


def test_many_questions_equal_each_alone(corpus):
    from corvane.operators.search import Question, search_many

    questions = [
        Question(1, "reserve ratio", unit(0)),
        Question(2, "lending rules", unit(1), Options(top_k=1)),
        Question(3, "reserve ratio in 2/2020/AB", unit(0)),
        Question(4, "reserve", None, Options(in_force_only=False), Filters(issuers=("central",))),
        Question(5, "zebra"),
        Question(6, "reserve ratio", unit(0), Options(mode="vector", roll_up="none")),
        Question(7, "reserve ratio", unit(0), Options(mode="bm25", roll_up="clause", in_force_only=True)),
    ]
    r = search_many(corpus, questions)
    hits, missing = r.hits.collect(), r.gaps.collect()
    for q in questions[1:5]:
        alone = search(corpus, q.text, q.vector, q.options, q.filters)
        assert sorted(tuple(h)[1:] for h in hits if h.query_id == q.id) == sorted(tuple(h) for h in alone.hits.collect()), q
        assert sorted((tuple(g)[1:] for g in missing if g.query_id == q.id), key=str) == sorted((tuple(g) for g in alone.gaps.collect()), key=str), q
    with pytest.raises(ValueError):
        search_many(corpus, [questions[0], questions[0]])


def test_when_other_validity_is_shown(corpus):
    from corvane.operators.search import Question, search_many

    ways = [Options(), Options(in_force_only=True), Options(in_force_only=False), Options(mode="vector"), Options(other_pass=False)]
    filters = [Filters(issuers=("central",)), Filters(doc_types=("rule", "act")), Filters(issued_from="2000-01-01"), Filters(excluded_issuers=("ministry",)), Filters(citation="article")]
    r = search_many(corpus, [Question(i, "reserve ratio", unit(0), o, f) for i, (o, f) in enumerate([*((o, Filters()) for o in ways), *((Options(), f) for f in filters)])])
    expired = {h.query_id for h in r.hits.collect() if h.badge == "expired"}
    assert expired == {0, 2, 8, 9}


def test_as_of_a_date_and_sections(spark, corpus):
    from dataclasses import replace

    day = dt.date
    rows = [(1, "in_force", day(2020, 1, 1), None), (2, "expired", day(2010, 1, 1), day(2019, 1, 1)), (3, "partial", None, None), (4, "not_yet", day(2030, 1, 1), None)]
    dated = replace(corpus, validity=spark.createDataFrame(rows, "document_id bigint, status_class string, eff_from date, eff_to date"))

    from corvane.operators.search import Question, search_many

    days = ["2015-06-01", "2019-01-01", "2020-01-01", "2031-01-01"]
    hits = search_many(dated, [Question(k, "reserve ratio lending", unit(0), Options(as_of=d)) for k, d in enumerate(days)]).hits.collect()
    assert [{h.document_id for h in hits if h.query_id == k} for k in range(4)] == [{2}, set(), {1}, {1, 4}]
    from pyspark.sql import functions as F

    parts = replace(corpus, chunk=corpus.chunk.withColumn("section_id", F.when(F.col("id") == 30, 7)), sections=spark.createDataFrame([(7,)], "section_id int"))
    assert ("partial_uncertain", 3) not in kinds(search(parts, "reserve ratio", unit(0)))


def test_gaps_of_relations_and_texts(spark, corpus):
    from dataclasses import replace

    relation = spark.createDataFrame([(100, 1, None), (101, 1, None), (102, 1, 2), (103, 1, 8), (104, 1, 9)], "id bigint, from_id bigint, to_id bigint")
    text = spark.createDataFrame([(1, True, False, "x"), (8, True, False, "y"), (7, False, True, "on the Reserve Ratio"), (6, False, True, "reserve ratio, but indexed"), (11, False, False, "nothing")], "document_id bigint, is_binding boolean, needs_review boolean, markdown string")
    more = corpus.document.unionByName(corpus.document.where("id < 3").selectExpr("id + 6 as id", "concat(id + 6, '/1999/ZZ') as doc_number", "title", "issuer", "doc_type", "issued_at"))
    r = search(replace(corpus, relation=relation, text=text, document=more), "reserve ratio", unit(0))
    gaps = {(g.kind, g.document_id, g.relation_id) for g in r.gaps.collect()}
    assert {("unresolved_relation", 1, 100), ("unresolved_relation", 1, 101), ("relation_target_text_gap", 9, 104), ("known_binding_text_gap", 7, None)} <= gaps
    assert not any(k == "relation_target_text_gap" and d != 9 for k, d, _ in gaps) and ("known_binding_text_gap", 6, None) not in gaps


def test_gaps_wait_until_asked_for(spark, sf_dir, monkeypatch):
    """Hits alone read no relations and no texts for gaps."""
    looked = []
    monkeypatch.setattr(search_module._Search, "gaps", lambda self, hits: looked.append(1) or hits)
    assert searching.search_as_of(spark, sf_dir).count() and not looked
