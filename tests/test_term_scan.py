"""Terms found by the automaton against a plain search, and the rules of the scope gate."""

import random
import time

from corvane.operators import term_scan
from corvane.operators.term_scan import Vocabulary, matched, query_scope


def gate(terms, number="", title="", body=""):
    v = Vocabulary.of(terms)
    return matched(v, v.compiled(), *map(term_scan.normal, (number, title, body)))


def plain(terms, text):
    out = {}
    for k, t in enumerate(terms):
        if t and t not in terms[:k]:
            at = [i for i in range(len(text)) if text.startswith(t, i)]
            if at:
                out[k] = at
    return out


def test_five_thousand_terms_equal_a_plain_search():
    rng = random.Random(1)
    terms = ["".join(rng.choice("abcđ ") for _ in range(rng.randint(0, 7))) for _ in range(5000)]
    a = term_scan.automaton(terms)
    for _ in range(6):
        text = "".join(rng.choice("abcđ ") for _ in range(120))
        got = {}
        for k, at in term_scan.found(a, text):
            got.setdefault(k, []).append(at)
        assert {k: sorted(v) for k, v in got.items()} == plain(terms, text)
    assert list(term_scan.found(term_scan.automaton([]), "abc")) == []


def test_time_does_not_grow_with_the_terms():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghij") for _ in range(400_000))

    def took(n):
        a = term_scan.automaton("".join(rng.choice("klmnop") + "abc" for _ in range(3)) + str(k) for k in range(n))
        began = time.process_time()
        assert not list(term_scan.found(a, text))
        return time.process_time() - began

    assert took(20_000) < 8 * took(20) + 0.2


TERMS = [("Ngân hàng", "strong"), ("tiền gửi", "strong_title"), ("phí", "weak"), ("tổ chức", "signal"), ("other", "unknown"), ("", "strong")]


def test_classes_and_places():
    assert gate(TERMS, body="về  NGÂN HÀNG nhà nước") == [("ngân hàng", "body")]
    assert gate(TERMS, title="Tiền gửi của ngân hàng", body="ngân hàng") == [("ngân hàng", "title"), ("tiền gửi", "title")]
    assert gate(TERMS, body="tiền gửi") == [] and gate(TERMS, number="tiền gửi/2020") == [("tiền gửi", "number")]
    assert gate(TERMS, title="phí") == [] and gate(TERMS, title="phí của tổ chức") == [("phí", "title")]
    assert gate(TERMS, title="phí", body="tổ chức") == [] and gate(TERMS, title="other") == [] and gate([], title="x") == []
    both = [("a b", "strong"), ("a b", "signal"), ("c", "weak")]
    assert gate(both, title="a b c") == [("a b", "title"), ("c", "title")]


def test_questions_without_accents():
    v = Vocabulary.of(TERMS)
    assert query_scope(v, "lãi suất ngân hàng") == ["ngân hàng"] == query_scope(v, "lai suat NGAN HANG")
    assert query_scope(v, "lãi suất ngan hang") == [] and query_scope(v, "phi cua to chuc") == ["phí"] and query_scope(v, "weather") == []


def test_tables(spark):
    docs = spark.createDataFrame([(1, "1/NH", "Phi cua to chuc", None), (2, None, None, "ngân hàng"), (2, None, None, "ngân hàng"), (None, "x", "", "")], "id bigint, doc_number string, title string, body string")
    v = Vocabulary.of(TERMS)
    got = sorted(((r.id, r.in_scope, tuple(r.matched), tuple(r.places)) for r in term_scan.scoped(docs, v).collect()), key=str)
    assert got == sorted([(1, False, (), ()), (2, True, ("ngân hàng",), ("body",)), (2, True, ("ngân hàng",), ("body",)), (None, False, (), ())], key=str)
    assert {r.id: r.in_scope for r in term_scan.scoped(docs, v, rescue=True).collect()}[1]
    texts = spark.createDataFrame([(1, "Aba aba"), (2, None), (3, "")], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in term_scan.occurrences(texts, ["ABA", "aba", "ba a", ""]).collect()) == [(1, "aba", 0, 2), (1, "ba a", 1, 1)]
    assert term_scan.occurrences(texts, []).count() == 0 and term_scan.scoped(docs.where("id > 9"), v).count() == 0
