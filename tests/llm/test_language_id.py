"""Profiles against vectors added one stretch at a time, held-out accuracy, and the documents' contract."""

import functools
import math
from collections import Counter

import numpy as np

from corvane.llm import language_id
from corvane.llm.queries import QUERIES
from tests.llm.helpers import crc, documents

ODD = [None, "", " \n", "12 34 -- ;", "é", "İstanbul ǅ ß", "漢字 かな", "a" * 5000, "ab " * 60_000, "\U0001f600 x", "under_score", "naïvé"]


@functools.cache
def sign(x, turns):
    return np.roll(language_id.letter_vector(0 if x == " " else ord(x)).astype(float), turns)


@functools.cache
def plain_vector(text):
    """The definition: letters in lower case, words between boundaries, each stretch bound and added."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    marked = " " + " ".join(words) + " " if words else ""
    total = np.zeros(language_id.SIZE)
    for stretch, n in Counter(marked[i : i + 3] for i in range(len(marked) - 2)).items():
        total += n * sign(stretch[0], 2) * sign(stretch[1], 1) * sign(stretch[2], 0)
    return total


def plain_model(rows):
    sums = {}
    for i, text, lang in rows:
        if text is not None and lang is not None and (i is None or crc(i, 4) != 2):
            v = plain_vector(text)
            n = math.sqrt((v * v).sum())
            sums[lang] = sums.get(lang, 0) + np.rint(2**20 * v / (n or 1))
    p = {k: v / np.linalg.norm(v) for k, v in sums.items() if v.any()}
    if len(p) > 1:
        mean = sum(p.values()) / len(p)
        p = {k: (v - mean) / np.linalg.norm(v - mean) for k, v in p.items()}
    return p


def plain_answer(model, text):
    v = plain_vector(text)
    if not v.any() or not model:
        return "und", 0.0
    score, lang = max(((v @ p / np.linalg.norm(v), k) for k, p in model.items()), key=lambda x: (x[0], [-ord(c) for c in x[1]]))
    return lang, min(1.0, max(0.0, score))


def same(got, model, rows):
    for r, (i, text, _) in zip(got, rows, strict=True):
        lang, score = plain_answer(model, text)
        assert (r.doc_id, r.lang_pred) == (i, lang) and abs(r.score - score) < 1e-6, (r, lang, score)


def test_vectors_are_bundles_of_bound_stretches():
    bundler = language_id.Bundler()
    got = bundler.bundle([t or "" for t in ODD])
    assert all(np.array_equal(g, plain_vector(t)) for g, t in zip(got, ODD, strict=True))


def test_bounds_of_memory_change_nothing(monkeypatch):
    texts = ["".join(chr(97 + (k * j * j) % 26) for j in range(300)) for k in range(40)]
    whole = language_id.Bundler().bundle(texts)
    monkeypatch.setattr(language_id, "REMEMBERED", 50)
    monkeypatch.setattr(language_id, "LETTERS", 3)
    monkeypatch.setattr(language_id, "ROWS", 7)
    small = language_id.Bundler()
    assert np.array_equal(small.bundle(texts), whole) and np.array_equal(small.bundle(texts), whole) and len(small.keys) <= 50


def test_documents(spark):
    samples = {"en": "the cat and the dog were walking through this town", "fr": "le chat et le chien marchaient dans cette ville", "de": "die katze und der hund gingen durch diese stadt"}
    rows = [(i, " ".join([samples[lang]] * (1 + i % 3)) + f" {chr(97 + i % 26) * 3}", lang) for i, lang in enumerate(list(samples) * 20)]
    rows += [(None, "the end of this", "en"), (200, None, "en"), (201, "chat chien", None), (202, "le chat", "fr"), (202, "le chat", "fr"), *((300 + k, t, "en" if k % 2 else None) for k, t in enumerate(ODD))]
    df = spark.createDataFrame([(i, t, lang, "s", 1, "x", "y", 0.5) for i, t, lang in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, lang_pred string, vector string, score double")
    model = plain_model(rows)
    for parts in (1, 7):
        got = language_id.predict_language(df.repartition(parts)).collect()
        order = sorted(rows, key=lambda r: (str(r[0]), plain_answer(model, r[1])))
        same(sorted(got, key=lambda r: (str(r.doc_id), (r.lang_pred, r.score))), model, order)
        assert all(r.held_out == (r.doc_id is not None and crc(r.doc_id, 4) == 2) for r in got)
    empty = language_id.predict_language(documents(spark, []))
    assert empty.count() == 0
    nothing = language_id.predict_language(spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string")).collect()
    assert [tuple(r) for r in nothing] == [(1, False, "und", 0.0)]


def test_one_language_is_learned(spark):
    rows = [(1, "abc abd", "xx"), (3, "zzz", None), (4, "42", None)]
    got = {r.doc_id: r.lang_pred for r in language_id.predict_language(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert got == {1: "xx", 3: "xx", 4: "und"}


def test_query(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op13_language_id"](spark, sf_dir).collect()}
    model = plain_model([(r.doc_id, r.text, r.lang) for r in docs.values()])
    ids = sorted(docs)
    assert got.keys() == docs.keys()
    same([got[i] for i in ids], model, [(i, docs[i].text, None) for i in ids])
    held = [i for i in ids if crc(i, 4) == 2 and docs[i].lang and any(c.isalpha() for c in docs[i].text or "")]
    assert sum(got[i].lang_pred == docs[i].lang for i in held) >= 0.97 * len(held)
