"""Runs against a plain search of every period and start, and the documents' contract."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from corvane.llm import periodic
from corvane.llm.queries import QUERIES
from tests.llm.helpers import documents


def plain_runs(words):
    """Every maximal stretch of each period, straight from the definition."""
    n, out = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                out.setdefault((i, j + q - i), q)  # periods ascend, so the least stays
            i = j + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    dropped = {k for s, m, q in found for k in range(s + q, s + m)}
    top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    sha = [hashlib.sha256(x).hexdigest() for x in ("".join(f"{s},{m},{q}\n" for s, m, q in found).encode(), b" ".join(w for i, w in enumerate(words) if i not in dropped))]
    return (len(found), *top, 1000 * top[1] // top[2] if found else None, *sha)


def test_runs_equal_a_plain_search():
    rnd = random.Random(5)
    for trial in range(300):
        words = []
        for _ in range(rnd.randint(1, 6)):
            unit = [rnd.randrange(rnd.choice((2, 3, 30))) for _ in range(rnd.randint(1, 14))]
            words += unit * rnd.randint(1, 9) + unit[: rnd.randint(0, len(unit))] + [rnd.randrange(40) for _ in range(rnd.randint(0, 9))]
        got = periodic.runs(periodic.numbered([[b"%d" % w for w in words]]), len(words))
        assert [tuple(r) for r in got.tolist()] == plain_runs(words), trial


def test_texts_named_together_stay_apart():
    rnd = random.Random(6)
    texts = [[b"%d" % rnd.randrange(2) for _ in range(rnd.randint(0, 90))] for _ in range(60)] + [[b"0"] * 30] * 4
    ends = np.cumsum([0, *map(len, texts)])
    got = periodic.runs(periodic.numbered(texts), 90).tolist()
    assert got == [[s + int(at), n, q] for at, t in zip(ends, texts) for s, n, q in plain_runs(t)]


def test_names_are_equal_where_stretches_are():
    words = np.array([random.Random(k).randrange(3) for k in range(200)])
    for k, name in enumerate(periodic.named(words)):
        stretches = [tuple(words[i : i + 2**k]) for i in range(len(words) - 2**k + 1)]
        assert len(name) == len(stretches) and all((name[i] == name[j]) == (stretches[i] == stretches[j]) for i in range(0, len(name), 3) for j in range(len(name)))


def test_shorter_rules_are_refused():
    for least, times in ((24, 2), (12, 3)):
        with pytest.raises(ValueError):
            periodic.runs(np.zeros(5, np.int64), 5, least, times)


def test_long_text_of_one_word_and_of_nested_periods():
    assert periodic.runs(np.zeros(300_000, np.int64), 300_000).tolist() == [[0, 300_000, 1]]
    nested = ([1] * 30 + [2]) * 2000
    got = periodic.runs(np.array(nested), len(nested)).tolist()
    assert [0, len(nested), 31] in got and len(got) == 2001


def test_documents(spark):
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10 == 0][:40]
    rnd = random.Random(9)
    texts = [None, "", " \n\t ", "a", "a " * 24, "a " * 23, "A a " * 30, "x y z " * 8 + "x y", "\x1ca b " * 20, "é ü " * 13, "w " * 9000 + "v " * 9000]
    rows = [(None, "a b " * 30), (7, "a b " * 30), (7, "a b " * 30), (None, None), *((i, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 300)))) for i in ids), *((100_000 + k, t) for k, t in enumerate(texts))]
    got = periodic.periodic_runs(documents(spark, rows, extra=True), change=periodic.planted, texts=True).collect()
    want = [(i, *plain_row(i, t)) for i, t in rows if not (t and len(t) > 20_000)]
    assert sorted((tuple(r)[:8] for r in got if r.words < 18_000), key=str) == sorted(want, key=str)
    assert [r.n_runs for r in got if r.words == 18_000] == [2] and [r.text for r in got if r.words == 18_000] == ["w v"]
    assert periodic.periodic_runs(documents(spark, [])).count() == 0


def test_query_equals_a_plain_search(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: tuple(r)[1:8] for r in QUERIES["op12_periodic_runs"](spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    few = sorted(docs, key=lambda i: len(docs[i] or ""))[:150]
    assert all(got[i] == plain_row(i, docs[i]) for i in few) and sum(got[i][0] > 0 for i in few) >= 5
