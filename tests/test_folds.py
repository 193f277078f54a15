"""Upserts of many rows at once against the same rows applied one by one."""

import random

from pyspark.sql import functions as F

from corvane.operators import folds


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_documents_equal_a_loop(spark):
    rng = random.Random(1)
    fields = "doc_key string, title string, issuer string, markdown string, source_document_id bigint, metadata_priority int"

    def row(k):
        return (f"d{k}", rng.choice((None, "t1", "t2", "t3")), rng.choice((None, "i1", "i2")), rng.choice((None, None, "m1", "m2")), rng.choice((None, *range(9))), rng.choice((5, 7, 10)))

    stored = [row(k) for k in range(25)]
    incoming = [(*row(rng.choice((3, *range(60)))), n) for n in range(500)]
    state = {r[0]: list(r) for r in stored}
    for key, title, issuer, text, link, priority, _ in incoming:
        if key not in state:
            state[key] = [key, title, issuer, text, link, priority]
            continue
        s = state[key]
        if priority > s[5] or (priority >= s[5] and text is not None):
            s[4] = link
        if priority >= s[5]:
            s[1:3] = title, issuer
        s[3] = text if text is not None else s[3]
        s[5] = max(s[5], priority)
    got = folds.documents(spark.createDataFrame(stored, fields), spark.createDataFrame(incoming, fields + ", seq int").repartition(5), ["title", "issuer"])
    assert table(got) == sorted((tuple(s) for s in state.values()), key=str)


def test_references_equal_a_loop(spark):
    rng = random.Random(2)
    fields = "ref_key string, document_id bigint, label string, source string, target string, src_ref string"

    def row(k, n):
        if rng.random() < 0.25:
            return (f"r{k}", rng.choice((None, n)), rng.choice((None, f"l{n}")), None, None, None)
        source, target = rng.choice((None, "", "vb", "cb")), rng.choice((None, "", "1", "2"))
        return (f"r{k}", rng.choice((None, None, n)), rng.choice((None, f"l{n}")), source, target, f"v{n}")

    stored = [row(k, 1000 + k) for k in range(30)]
    incoming = [(*row(rng.choice((5, *range(60))), n), n) for n in range(600)]
    state = {r[0]: list(r) for r in stored}
    for key, document, label, source, target, ref, _ in incoming:
        if key not in state:
            state[key] = [key, document, label, source, target, ref]
            continue
        s = state[key]
        s[1] = s[1] if s[1] is not None else document
        s[2] = label if label is not None else s[2]
        same = (s[3] or "") == (source or "") and (s[4] or "") != "" and (s[4] or "") == (target or "")
        if same or ((s[4] or "") == "" and (target or "") != "") or s[5] is None:
            if ref is not None or same:
                s[3:] = source, target, ref
    got = folds.references(spark.createDataFrame(stored, fields), spark.createDataFrame(incoming, fields + ", seq int").repartition(5))
    assert table(got) == sorted((tuple(s) for s in state.values()), key=str)


def test_discoveries_equal_a_loop(spark):
    rng = random.Random(3)
    fields = "source string, external_id bigint, in_scope boolean, provenance string, content_hash string, detail_url string"
    more = ", created string, state string, artifacts_done int"

    def row(k):
        return ("s", k, rng.random() < 0.2, rng.choice(("", "relation", "relation", "listing", "seed")), rng.choice((None, None, "h1", "h2")), rng.choice((None, "u1", "u2")))

    stored = [(*row(k), f"c{k}", rng.choice(("complete", "fetching")), rng.randrange(5)) for k in range(40)]
    incoming = [(*row(rng.choice((3, *range(70)))), None, None, None, n) for n in range(400)]
    state = {r[1]: [*r, False] for r in stored}
    for source, key, scope, provenance, h, url, *_ in incoming:
        if key not in state:
            state[key] = [source, key, scope, provenance, h, url, None, "discovered", 0, False]
            continue
        s = state[key]
        s[2] = s[2] or scope
        if s[3] == "" or (s[3] == "relation" and provenance != "relation"):
            s[3] = provenance
        if h is not None and h != s[4]:
            s[7:10] = "discovered", 0, True
        s[4], s[5] = h if h is not None else s[4], url if url is not None else s[5]
    got = folds.discoveries(spark.createDataFrame(stored, fields + more), spark.createDataFrame(incoming, fields + more + ", seq int").repartition(5), ["source", "external_id"], kept=["created"], reset={"state": F.lit("discovered"), "artifacts_done": F.lit(0)})
    assert table(got) == sorted((tuple(s) for s in state.values()), key=str)


def test_empty_tables(spark):
    fields = "doc_key string, title string, markdown string, source_document_id bigint, metadata_priority int"
    empty, one = spark.createDataFrame([], fields), spark.createDataFrame([("a", "t", None, 1, 5)], fields)
    assert folds.documents(empty, empty.withColumn("seq", F.lit(1)), ["title"]).count() == 0
    assert table(folds.documents(one, empty.withColumn("seq", F.lit(1)), ["title"])) == [("a", "t", None, 1, 5)] == table(folds.documents(empty, one.withColumn("seq", F.lit(1)), ["title"]))
